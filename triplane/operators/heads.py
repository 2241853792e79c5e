"""Heads of rules: each solution makes the facts of every template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rules import Pattern, is_variable, name
from ..sources.graph import Graph, View, as_term, constant
from .body import Solutions


def _place(x: object, found: Solutions) -> tuple[Column, str | None] | None:
    if not is_variable(x):
        return F.lit(constant(x)), "term"
    if name(x) not in found.kinds:
        return None  # an unbound variable: the template makes nothing
    return F.col(name(x)), found.kinds[name(x)]


def head_view(template: Pattern, found: Solutions, graph: Graph) -> View | None:
    """The facts of a template with a constant predicate."""
    s, o = _place(template.s, found), _place(template.o, found)
    if s is None or o is None:
        return None
    rows = found.rows if found.rows is not None else graph.spark.range(1)
    return View(rows.select(s[0].alias("s"), o[0].alias("o")).distinct(), s[1], o[1])


def loose_triples(template: Pattern, found: Solutions, graph: Graph) -> DataFrame | None:
    """The facts of a template with a variable predicate, as term triples; only IRIs can be predicates."""
    view = head_view(template, found, graph)
    if view is None or name(template.p) not in found.kinds:
        return None
    rows = Solutions(found.rows, found.kinds)
    s, o = _place(template.s, rows), _place(template.o, rows)
    p = F.col(name(template.p))
    picked = found.rows.select(s[0].alias("s"), p.alias("p"), o[0].alias("o")).where(p.cast("string").startswith("<"))
    types = {f.name: f.dataType for f in picked.schema.fields}
    if not isinstance(types["p"], T.StringType):
        return None
    return picked.select(as_term(F.col("s"), s[1], types["s"]).alias("s"), F.expr("substring(p, 2, length(p) - 2)").alias("p"), as_term(F.col("o"), o[1], types["o"]).alias("o")).distinct()
