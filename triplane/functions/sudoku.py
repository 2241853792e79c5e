"""A worked example of a user function: solves a Sudoku given as 81 characters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def solved(puzzle: str | None) -> str | None:
    """The first solution ('' if there is none), or null if the text is no puzzle or contradicts itself."""
    cells = "".join((puzzle or "").split()).replace(".", "0").replace("_", "0")
    if len(cells) != 81 or not cells.isdigit():
        return None
    rows, columns, boxes = ([set() for _ in range(9)] for _ in range(3))
    groups = lambda i: (rows[i // 9], columns[i % 9], boxes[i // 27 * 3 + i % 9 // 3])
    grid = list(cells)
    for i, d in enumerate(grid):
        if d != "0":
            if any(d in g for g in groups(i)):
                return None
            for g in groups(i):
                g.add(d)

    def fill() -> bool:
        choices = [(len(free), i, free) for i, d in enumerate(grid) if d == "0" for free in [set("123456789").difference(*groups(i))]]
        if not choices:
            return True
        _, i, free = min(choices, key=lambda x: x[:2])
        for d in sorted(free):
            grid[i] = d
            for g in groups(i):
                g.add(d)
            if fill():
                return True
            for g in groups(i):
                g.discard(d)
        grid[i] = "0"
        return False

    return "".join(grid) if fill() else ""


def sudoku(text: Column) -> Column:
    @F.arrow_udf(T.StringType())
    def solve(column: pa.Array) -> pa.Array:
        return pa.array([solved(x) for x in column.to_pylist()], pa.string())

    return solve(text)
