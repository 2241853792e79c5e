"""Results as text lines: terms with prefixes, one triple or solution a line, in Unicode order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import terms


def compact(t: Column, prefixes: dict[str, str]) -> Column:
    """An IRI term as prefix:name where a prefix fits (the longest first); rdf:type is not special here."""
    out = t
    for prefix, namespace in sorted(prefixes.items(), key=lambda x: len(x[1])):
        n = len(namespace)
        local = F.substring(t, F.lit(n + 2), F.length(t) - n - 2)
        out = F.when(t.startswith(f"<{namespace}") & local.rlike("^[A-Za-z0-9_-]+$"), F.concat(F.lit(f"{prefix}:"), local)).otherwise(out)
    return out


def lines(triples: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """``line``: one ``s p o .`` for each triple, sorted as people sort text."""
    prefixes = prefixes or {}
    predicate = F.when(F.col("p") == terms.TYPE, "a").when(F.col("p").rlike("^[A-Za-z_][A-Za-z0-9_-]*$"), F.concat(F.lit(":"), "p")).otherwise(compact(F.concat(F.lit("<"), "p", F.lit(">")), prefixes))
    line = F.concat_ws(" ", compact(F.col("s"), prefixes), predicate, compact(F.col("o"), prefixes), F.lit("."))
    return triples.select(line.alias("line")).distinct().orderBy(F.collate("line", "UNICODE"))


def solution_lines(solutions: DataFrame) -> DataFrame:
    """``line``: ``?x = value; ?y = value`` for each solution."""
    cells = [F.concat(F.lit(f"?{c} = "), F.coalesce(F.col(c).cast("string"), F.lit("UNDEF"))) for c in sorted(solutions.columns)]
    line = F.concat_ws("; ", *cells) if cells else F.lit("true")
    return solutions.select(line.alias("line")).distinct().orderBy(F.collate("line", "UNICODE"))
