"""Bodies of rules and queries as DataFrame algebra: joins, anti-joins, filters and computed columns.

A solution is a row whose columns are variables. Every prefix of a body has a fixed schema, so what is bound is known
while the plan is built, and Catalyst orders the joins and pushes the filters down.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..rules import Filter, Not, Path, Pattern, Set, Variables, clause, is_variable, name, used
from ..sources.graph import Graph, Origin, View, as_term, constant


@dataclass
class Solutions:
    """``rows``: None stands for the one empty solution. ``kinds``: of each variable, as in View. ``key``: the subject
    whose table row gave the solution. ``sides``: what was joined last, ``tests``: the filters since. ``once``: no solution
    comes twice."""

    rows: DataFrame | None = None
    kinds: dict[str, str | None] = field(default_factory=dict)
    key: str | None = None
    sides: tuple[Solutions, Solutions] | None = None
    tests: tuple[Filter, ...] = ()
    once: bool = False

    def type_of(self, variable: str) -> T.DataType:
        return self.rows.schema[variable].dataType


#: Gives the view of a body position's predicate (the position counts clauses), so that recursion can put a delta there.
Views = Callable[[int, str], View]


def _constant_test(c: Column, kind: str | None, data_type: T.DataType, value: object) -> Column:
    """Equality of a column with a constant; a native column meets a constant of its own kind natively."""
    if kind == "term":
        return c == constant(value)
    text = str(value)
    if kind is not None and isinstance(value, str) and text.startswith(f"<{kind}/"):
        return c == F.lit(text[len(kind) + 2 : -1]).cast(data_type)
    if isinstance(value, str) and text.startswith(("<", "_:", "[")):
        return F.lit(False)
    if isinstance(value, str) != isinstance(data_type, T.StringType) or isinstance(value, bool) != isinstance(data_type, T.BooleanType):
        return F.lit(False)
    return c == F.lit(value)


def _narrowed(view: View, p: Pattern) -> View:
    """A view's facts that meet a pattern's constant subject and object, tested on native values."""
    types = {f.name: f.dataType for f in view.rows.schema.fields}
    for c, kind, x in (("s", view.s, p.s), ("o", view.o, p.o)):
        if not is_variable(x):
            view = replace(view, rows=view.rows.where(_constant_test(F.col(c), kind, types[c], x)), origin=None)
    return view


def pattern_rows(p: Pattern, graph: Graph, view: View | None = None) -> Solutions:
    """Solutions of one triple pattern."""
    if is_variable(p.p):
        rows = graph.triples(narrow=lambda v: _narrowed(v, p)).withColumn("p", F.concat(F.lit("<"), "p", F.lit(">")))
        kinds = {"s": "term", "p": "term", "o": "term"}
        places = (("s", p.s), ("p", p.p), ("o", p.o))
    else:
        view = view or graph.view(p.p)
        rows, kinds, places = view.rows, {"s": view.s, "o": view.o}, (("s", p.s), ("o", p.o))
    types = {f.name: f.dataType for f in rows.schema.fields}
    out: dict[str, str] = {}
    for column, x in places:
        if not is_variable(x):
            rows = rows.where(_constant_test(F.col(column), kinds[column], types[column], x))
        elif name(x) in out:
            first = out[name(x)]
            a, b = F.col(first), F.col(column)
            if kinds[first] != kinds[column] or types[first] != types[column]:
                a, b = as_term(a, kinds[first], types[first]), as_term(b, kinds[column], types[column])
            rows = rows.where(a == b)
        else:
            out[name(x)] = column
    picked = rows.select(*(F.col(c).alias(v) for v, c in out.items())) if out else rows.select(F.lit(1).alias("_any"))
    key = name(p.s) if view is not None and view.origin is not None and is_variable(p.s) else None
    return Solutions(picked, {v: kinds[c] for v, c in out.items()}, key)


def star_rows(patterns: Sequence[Pattern], columns: Sequence[str], origin: Origin) -> Solutions:
    """Patterns about one subject that all read columns of one mapped table: one scan, no join. Sound because the
    mapping's key identifies a row."""
    mapping, table = origin.mapping, origin.table
    subject = name(patterns[0].s)
    types = {f.name: f.dataType for f in table.schema.fields}
    rows = table.where(mapping.subject().isNotNull())
    out: dict[str, Column] = {subject: mapping.subject()}
    kinds: dict[str, str | None] = {subject: mapping.entity}
    for p, c in zip(patterns, columns, strict=True):
        rows = rows.where(F.col(c).isNotNull())
        if not is_variable(p.o):
            rows = rows.where(_constant_test(F.col(c), mapping.kind(c), types[c], p.o))
        elif name(p.o) in out:
            same = kinds[name(p.o)] == mapping.kind(c)
            rows = rows.where((out[name(p.o)] == F.col(c)) if same else F.lit(False))
        else:
            out[name(p.o)], kinds[name(p.o)] = F.col(c), mapping.kind(c)
    return Solutions(rows.select(*(c.alias(v) for v, c in out.items())), kinds, subject)


def path_rows(path: Path, graph: Graph) -> Solutions:
    """A path as a chain of joins; equal ends count once, however many ways lead there."""
    steps = []
    for i, step in enumerate(path.steps):
        a, b = f"?_{i}", f"?_{i + 1}"
        steps.append(Pattern(b, step[1:], a) if step.startswith("^") else Pattern(a, step, b))
    found = solve(steps, graph)
    first, last = "_0", f"_{len(path.steps)}"
    pairs = distinct_rows(found, [first, last]).select(F.col(first).alias("s"), F.col(last).alias("o"))
    return replace(pattern_rows(Pattern(path.s, "", path.o), graph, View(pairs, found.kinds[first], found.kinds[last])), once=True)


def _aligned(left: Solutions, right: Solutions, shared: Sequence[str]) -> tuple[Solutions, Solutions]:
    """Shared variables of different kinds or types become term text on both sides (numbers just widen)."""
    l, r = left, right
    for v in shared:
        a, b = l.type_of(v), r.type_of(v)
        numbers = isinstance(a, T.NumericType) and isinstance(b, T.NumericType)
        if l.kinds[v] == r.kinds[v] and (a == b or numbers):
            continue
        l, r = (Solutions(x.rows.withColumn(v, as_term(F.col(v), x.kinds[v], x.type_of(v))), x.kinds | {v: "term"}, x.key) for x in (l, r))
    return l, r


def join(left: Solutions, right: Solutions) -> Solutions:
    if left.rows is None:
        return right
    shared = [v for v in right.kinds if v in left.kinds]
    left, right = _aligned(left, right, shared)
    if "_any" in right.rows.columns:
        # a pattern of constants only: keep the rows if it holds
        return Solutions(left.rows.join(right.rows.limit(1).select(F.lit(1).alias("_holds")), how="left_semi"), left.kinds)
    rows = left.rows.join(right.rows, shared, "inner") if shared else left.rows.crossJoin(right.rows)
    return Solutions(rows, left.kinds | right.kinds, sides=(left, right))


def _filtered(found: Solutions, tests: Sequence[Filter]) -> Solutions:
    for x in tests:
        found = replace(found, rows=found.rows.where(F.coalesce(x.test(Variables()), F.lit(False))), tests=(*found.tests, x))
    return found


#: About how many solutions a list holds at most.
LIST = 256


def _lists(found: Solutions, compared: set[str], names: tuple[str, str]) -> Solutions:
    """The values of rows that are compared by equal values, as lists of bounded length with numbers."""
    own = [v for v in found.kinds if v not in compared]
    rest = [v for v in found.kinds if v in compared]
    sizes = found.rows.groupBy(*rest).agg(F.ceil(F.count(F.lit(1)) / LIST).alias("_lists"))
    dealt = found.rows.join(sizes, rest).withColumn(names[1], F.pmod(F.xxhash64(*own), F.col("_lists")))
    rows = dealt.groupBy(*rest, names[1]).agg(F.collect_list(F.struct(*own)).alias(names[0]))
    return Solutions(rows, {v: found.kinds[v] for v in rest})


def _by_lists(left: Solutions, right: Solutions, tests: Sequence[Filter], compared: set[str]) -> DataFrame:
    """Filtered rows of a join whose sides have values that aren't compared: lists of these are joined and dealt
    anew, so a frequent value is no task of its own, and then written out in full."""
    if any(set(x.kinds) <= compared or not set(x.kinds) & compared for x in (left, right)):
        return _filtered(join(left, right), tests).rows
    found = _filtered(join(_lists(left, compared, ("_l", "_i")), _lists(right, compared, ("_r", "_j"))), tests).rows
    rest = [c for c in found.columns if not c.startswith("_")]
    return found.repartition(*rest, "_i", "_j").select(*rest, "_r", F.inline("_l")).select("*", F.inline("_r"))


def distinct_rows(found: Solutions, names: Sequence[str]) -> DataFrame:
    """The distinct solutions by some variables.

    A join of two tables by what isn't the key of either makes far more rows than it reads, and making these distinct
    would shuffle and keep them all. So the sides are made distinct instead: a row with both keys comes once
    if each key has one row. Only the rows of keys with several are made distinct after the join."""
    if found.once and set(found.kinds) <= set(names):
        return found.rows.select(*names)
    plain = found.rows.select(*names).distinct()
    if found.sides is None:
        return plain
    shared = set(found.sides[0].kinds) & set(found.sides[1].kinds)
    tested = set().union(*(used(x.test) for x in found.tests))
    ones, many, whole = [], [], True
    for x in found.sides:
        if x.key is None or x.key in shared:
            return plain
        own = [v for v in x.kinds if v in names]
        rest = [v for v in x.kinds if v in shared | tested and v not in names]
        if not rest:
            ones.append(replace(x, rows=x.rows.select(*own).distinct(), kinds={v: x.kinds[v] for v in own}))
            many.append(None)
            continue
        if x.key not in names:
            return plain
        kinds, whole = {v: x.kinds[v] for v in (*own, *rest)}, False
        values = F.struct(*rest)
        known = x.rows.groupBy(*own).agg(F.min(values).alias("_least"), F.max(values).alias("_most"))
        one = known.where(F.col("_least").eqNullSafe(F.col("_most"))).select(*own, "_least.*")
        several = known.where(~F.col("_least").eqNullSafe(F.col("_most"))).select(*(F.col(v).alias(f"_of_{v}") for v in own))
        same = reduce(Column.__and__, (F.col(v).eqNullSafe(F.col(f"_of_{v}")) for v in own))
        ones.append(replace(x, rows=one, kinds=kinds))
        many.append(replace(x, rows=x.rows.select(*own, *rest).join(several, same, "left_semi"), kinds=kinds))
    joined = lambda a, b: _filtered(join(a, b), found.tests).rows.select(*names)
    once = _by_lists(*ones, found.tests, shared | tested).select(*names)
    if whole:
        return once
    again = [joined(a, b) for a, b in ((many[0], ones[1]), (ones[0], many[1]), (many[0], many[1])) if a is not None and b is not None]
    return once.union(reduce(DataFrame.union, again).distinct())


def anti(left: Solutions, inner: Not, graph: Graph) -> Solutions:
    """Rows without a solution of the inner body. Inner filters on inner variables run inside; those that also
    name outer ones become part of the join condition."""
    parts = [x for x in inner.body if isinstance(x, Pattern | Path)]
    if not graph.knows(parts):
        return left
    found = solve(parts, graph)
    mixed = []
    for x in inner.body:
        if isinstance(x, Filter):
            if used(x.test) <= set(found.kinds):
                found = Solutions(found.rows.where(F.coalesce(x.test(Variables()), F.lit(False))), found.kinds)
            else:
                mixed.append(x)
        elif isinstance(x, Not | Set):
            raise ValueError("NOT holds patterns, paths and filters only")
    if left.rows is None:
        rows = graph.spark.range(1).select(F.lit(1).alias("_any"))
        left = Solutions(rows, {})
    shared = [v for v in found.kinds if v in left.kinds]
    left, found = _aligned(left, found, shared)
    need = set(shared) | {v for x in mixed for v in used(x.test) if v in found.kinds}
    inside = found.rows.select(*(F.col(v).alias(f"_in_{v}") for v in sorted(need)), *([F.lit(1).alias("_one")] if not need else []))
    inside = inside.distinct() if need else inside.limit(1)
    on = [F.col(v) == F.col(f"_in_{v}") for v in shared]
    for x in mixed:
        place = lambda v: F.col(v) if v in left.kinds else F.col(f"_in_{v}")
        on.append(F.coalesce(x.test(Variables(place)), F.lit(False)))
    condition = on[0] if on else F.lit(True)
    for c in on[1:]:
        condition = condition & c
    return Solutions(left.rows.join(inside, condition, "left_anti"), left.kinds)


def assign(left: Solutions, sets: Sequence[Set], graph: Graph) -> Solutions:
    """Binds variables by values that don't use each other; if one is bound, keeps the rows where the value is equal.

    New values come as a generated row: it is made once, where a projection would be worked out again in
    each filter on it."""
    rows = left.rows if left.rows is not None else graph.spark.range(1).select(F.lit(1).alias("_any"))
    kinds, new = dict(left.kinds), []
    for x in sets:
        v, value = x.name.lstrip("?"), x.value(Variables())
        if v in left.kinds:
            rows = rows.where(F.coalesce(F.col(v) == value, F.lit(False)))
        else:
            new.append(value.alias(v))
            kinds[v] = "term" if x.term else None
    if new:
        made = rows.select("*", F.inline(F.array(F.struct(*new))))
        for x in sets:
            made = made.where(F.col(x.name.lstrip("?")).isNotNull())
        rows = made
    return Solutions(rows, kinds)


def _sets(clauses: list, i: int, bound: dict[str, str | None]) -> list[Set]:
    """The assignments from i on whose values use what is bound before them all."""
    out: list[Set] = []
    for x in clauses[i:]:
        if not isinstance(x, Set) or (out and (not used(x.value) <= set(bound) or x.name.lstrip("?") in bound or any(x.name == y.name for y in out))):
            break
        out.append(x)
        if x.name.lstrip("?") in bound:
            break
    return out


def _star(clauses: list, i: int, done: set[int], graph: Graph, views: Views | None) -> list:
    """Patterns from i on, up to the next clause of another sort (patterns commute), about i's subject and table."""
    first = graph.view(clauses[i].p).origin
    found = []
    for j in range(i, len(clauses)):
        x = clauses[j]
        if not isinstance(x, Pattern):
            break
        if first is None or j in done or x.s != clauses[i].s or is_variable(x.p) or (views and views(j, x.p) is not None):
            continue
        origin = graph.view(x.p).origin
        if origin is not None and origin[0] is first[0] and x.o != x.s:
            found.append((j, origin))
    return found


def solve(body: Sequence, graph: Graph, views: Views | None = None) -> Solutions:
    """Solutions of a body, left to right as written: a filter, an assignment or a NOT sees what is bound before it."""
    out, clauses, done = Solutions(), [clause(x) for x in body], set()
    for i, x in enumerate(clauses):
        if i in done:
            continue
        if isinstance(x, Pattern):
            own = views(i, x.p) if views and not is_variable(x.p) else None
            star = _star(clauses, i, done, graph, views) if own is None and is_variable(x.s) and not is_variable(x.p) else []
            if len(star) > 1:
                done.update(j for j, _ in star)
                out = join(out, star_rows([clauses[j] for j, _ in star], [c for _, (_, c) in star], star[0][1][0]))
            else:
                out = join(out, pattern_rows(x, graph, own))
        elif isinstance(x, Path):
            out = join(out, path_rows(x, graph))
        elif isinstance(x, Filter):
            out = out if out.rows is not None else Solutions(graph.spark.range(1).select(F.lit(1).alias("_any")), out.kinds)
            out = _filtered(out, [x])
        elif isinstance(x, Not):
            out = anti(out, x, graph)
        elif isinstance(x, Set):
            run = _sets(clauses, i, out.kinds)
            done.update(range(i, i + len(run)))
            out = assign(out, run, graph)
        else:
            raise TypeError(f"no clause: {x!r}")
    return out


def select(body: Sequence, graph: Graph, *variables: str) -> DataFrame:
    """The distinct solutions of a body query, all variables in the order of their names unless some are given."""
    found = solve(body, graph)
    names = [v.lstrip("?") for v in variables] or sorted(found.kinds)
    if found.rows is None:
        return graph.spark.range(1).select()
    return distinct_rows(found, names)
