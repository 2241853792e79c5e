"""Rules over a stream of new facts: one micro-batch at a time joins the static graph (monotone rules only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.body import solve
from ..operators.heads import head_view
from ..rules import Not, Rule
from ..sources.graph import Graph, View


def derived_stream(graph: Graph, rule: Rule, predicate: str, arriving: DataFrame, s: str | None = None, o: str | None = None) -> list[DataFrame]:
    """The facts that a rule makes from streaming facts ``arriving(s, o)`` of ``predicate`` and the static graph: one
    streaming DataFrame (s, o) for each template of the head. A rule with NOT isn't monotone and is refused; state
    (distinct over time) is left to the sink."""
    if any(isinstance(x, Not) for x in rule.body):
        raise ValueError("a rule with NOT can't run over a stream: a later fact could take its result back")
    found = solve(rule.body, graph, lambda i, p: View(arriving.select("s", "o"), s, o) if p == predicate else None)
    views = [head_view(t, found, graph) for t in rule.head]
    return [v.rows for v in views if v is not None]


def write_stream(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append derived facts to a Parquet folder until what is there has been read."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
