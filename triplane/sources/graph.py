"""Facts by predicate: each is a DataFrame of subject and object, lazily read from tables or given as triples."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms


@dataclass(frozen=True, eq=False)
class Origin:
    """A mapped table: patterns about one subject read it once, without a join (see operators.body.star_rows)."""

    table: DataFrame
    mapping: Mapping


@dataclass(frozen=True)
class View:
    """``rows(s, o)``. The kind of a column: an entity (its values are keys of that entity), None for plain values,
    or ``term`` for term text. ``origin``: the mapped table and column it reads, if it is just that."""

    rows: DataFrame
    s: str | None = "term"
    o: str | None = "term"
    origin: tuple[Origin, str] | None = field(default=None, compare=False)

    def as_terms(self) -> View:
        """Both columns as term text."""
        if self.s == self.o == "term":
            return self
        kind = {f.name: f.dataType for f in self.rows.schema.fields}
        text = {c: as_term(F.col(c), k, kind[c]) for c, k in (("s", self.s), ("o", self.o))}
        return View(self.rows.select(text["s"].alias("s"), text["o"].alias("o")))


def as_term(c: Column, kind: str | None, data_type: object) -> Column:
    """A native value as a term: a key becomes the IRI <entity/key>."""
    if kind == "term":
        return c
    if kind is None:
        return terms.of_value(c, data_type)
    return F.when(c.isNotNull(), F.concat(F.lit(f"<{kind}/"), c.cast("string"), F.lit(">")))


def alike(a: View, b: View) -> bool:
    types = [[f.dataType for f in v.rows.select("s", "o").schema.fields] for v in (a, b)]
    return (a.s, a.o) == (b.s, b.o) and types[0] == types[1]


def together(views: Sequence[View]) -> View:
    """Union of views of one predicate; views of different kinds meet as term text."""
    if not all(alike(views[0], v) for v in views[1:]):
        views = [v.as_terms() for v in views]
    if len(views) == 1:
        return views[0]
    return replace(views[0], origin=None, rows=reduce(DataFrame.unionByName, (v.rows.select("s", "o") for v in views)))


@dataclass(frozen=True)
class Mapping:
    """A table as virtual triples: ``entity`` names what its ``key`` columns identify, ``columns`` gives the predicate
    of a column, ``references`` the entity of a foreign key. A null cell makes no triple. Several key columns
    become one text with / between. The key identifies a row; a table without one takes all its columns."""

    entity: str
    key: str | Sequence[str]
    columns: dict[str, str]
    references: dict[str, str] | None = None

    def subject(self) -> Column:
        keys = [self.key] if isinstance(self.key, str) else list(self.key)
        return F.col(keys[0]) if len(keys) == 1 else F.concat_ws("/", *(F.col(k).cast("string") for k in keys))

    def kind(self, column: str) -> str | None:
        return (self.references or {}).get(column)

    def views(self, table: DataFrame) -> dict[str, View]:
        out, origin = {}, Origin(table, self)
        for column, predicate in self.columns.items():
            rows = table.select(self.subject().alias("s"), F.col(column).alias("o")).where("s IS NOT NULL AND o IS NOT NULL")
            out[predicate] = View(rows, self.entity, self.kind(column), (origin, column))
        return out


class Graph:
    """An immutable set of facts; ``with_`` methods give a new one. Facts are sets: a view that may hold equal
    rows is made distinct where rules need it."""

    def __init__(self, spark: SparkSession, views: dict[str, list[View]] | None = None, loose: DataFrame | None = None) -> None:
        self.spark, self._views, self._loose = spark, views or {}, loose

    def with_view(self, predicate: str, view: View) -> Graph:
        return Graph(self.spark, self._views | {predicate: [*self._views.get(predicate, []), view]}, self._loose)

    def with_table(self, table: DataFrame, mapping: Mapping) -> Graph:
        out = self
        for predicate, view in mapping.views(table).items():
            out = out.with_view(predicate, view)
        return out

    def with_facts(self, facts: Iterable[tuple]) -> Graph:
        """Constant facts (s, p, o): texts that begin like a term are terms, others literals of their type."""
        by: dict[str, list[tuple[str, str]]] = {}
        for s, p, o in facts:
            by.setdefault(p, []).append((constant(s), constant(o)))
        out = self
        for p, rows in by.items():
            out = out.with_view(p, View(self.spark.createDataFrame(rows, "s string, o string")))
        return out

    def with_triples(self, triples: DataFrame) -> Graph:
        """Term triples (s, p, o) of any predicates, p without brackets."""
        triples = triples.select("s", "p", "o")
        return Graph(self.spark, self._views, triples if self._loose is None else self._loose.union(triples))

    def with_graph(self, other: Graph) -> Graph:
        """The union of two graphs, as for imports."""
        out = self
        for p, views in other._views.items():
            for v in views:
                out = out.with_view(p, v)
        return out if other._loose is None else out.with_triples(other._loose)

    @property
    def predicates(self) -> list[str]:
        return sorted(self._views)

    def knows(self, body: Sequence) -> bool:
        """False if a pattern or path of a body reads a predicate without any facts, so that it has no solution."""
        if self._loose is not None:
            return True
        steps = [s.lstrip("^") for x in body for s in (getattr(x, "steps", None) or ([x.p] if hasattr(x, "p") else []))]
        return all(s in self._views or s.startswith(("?", "$")) for s in steps)

    def view(self, predicate: str) -> View:
        """All facts of a predicate; an unknown one has none."""
        views = list(self._views.get(predicate, []))
        if self._loose is not None:
            views.append(View(self._loose.where(F.col("p") == predicate).select("s", "o")))
        return together(views) if views else View(self.spark.createDataFrame([], "s string, o string"))

    def triples(self, predicates: Sequence[str] | None = None, narrow: Callable[[View], View] = lambda v: v) -> DataFrame:
        """Everything as term triples (s, p, o), for patterns with a variable predicate and for output. ``narrow``
        takes from each view what it is asked for while the values are native. Predicates share no triples, so
        each view is made distinct alone, before its values become text."""
        parts = []
        for p in self._views if predicates is None else predicates:
            view = narrow(self.view(p))
            view = replace(view, rows=view.rows.select("s", "o").distinct()) if view.origin is None else view
            parts.append(view.as_terms().rows.withColumn("p", F.lit(p)).select("s", "p", "o"))
        if self._loose is not None and predicates is None:
            loose = self._loose.where(~F.col("p").isin(list(self._views))) if self._views else self._loose
            rows = narrow(View(loose.select("s", "o", "p"))).rows
            parts.append(rows.select("s", "p", "o").distinct())
        if not parts:
            return self.spark.createDataFrame([], "s string, p string, o string")
        return reduce(DataFrame.union, parts)


def constant(x: object) -> str:
    """A constant as term text. Texts that begin with < _: " [ are terms already; true and numbers are literals."""
    if isinstance(x, str):
        return x if x.startswith(("<", "_:", '"', "[")) else terms.literal(x)
    return terms.literal(x)


def list_facts(head: str, items: Sequence[object]) -> list[tuple]:
    """A collection as first/rest facts; its cells are blank nodes named after the head."""
    cells = [head, *(terms.blank(f"{head.strip('<>_:')}.{i}") for i in range(1, len(items)))]
    out: list[tuple] = []
    for i, (cell, item) in enumerate(zip(cells, items, strict=True)):
        out += [(cell, terms.FIRST, item), (cell, terms.REST, cells[i + 1] if i + 1 < len(cells) else terms.iri(terms.NIL))]
    return out


def reified(reifier: str, s: str, p: str, o: object, **about: object) -> list[tuple]:
    """A reifier of a triple that isn't itself stated, with facts about it."""
    triple = json.dumps([constant(s), terms.iri(p), constant(o)], separators=(",", ":"), ensure_ascii=False)
    return [(reifier, terms.REIFIES, triple), *((reifier, p2, x) for p2, x in about.items())]


def annotated(reifier: str, s: str, p: str, o: object, **about: object) -> list[tuple]:
    """A stated triple and its reifier."""
    return [(s, p, o), *reified(reifier, s, p, o, **about)]
