"""Evaluation of rules: a pass for what isn't recursive, a semi-naive loop of DataFrame deltas for what is."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.body import Solutions, select, solve
from ..operators.heads import head_view, loose_triples
from ..rules import Not, Path, Pattern, Rule, Transitive, is_variable
from ..sources.graph import Graph, View, together
from .strata import Edge, components, dependencies, findings, may_feed, reads, strata


class RuleError(ValueError):
    pass


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder of spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.match("local", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join("/tmp", "checkpoints", str(uuid.uuid4()))
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@dataclass
class Result:
    """``graph``: input and everything inferred; ``made``: inferred facts by predicate, without the input's."""

    graph: Graph
    made: dict[str, View] = field(default_factory=dict)
    passes: int = 0

    def select(self, body: Sequence, *variables: str) -> DataFrame:
        return select(body, self.graph, *variables)

    def inferred(self) -> DataFrame:
        """The inferred term triples (s, p, o)."""
        g = Graph(self.graph.spark)
        for p, v in self.made.items():
            g = g.with_view(p, v)
        return g.triples()


def _new(view: View, known: View | None) -> View:
    """Distinct facts that aren't known yet."""
    rows = view.rows.distinct()
    if known is None:
        return replace(view, rows=rows)
    if (view.s, view.o) != (known.s, known.o) or rows.dtypes != known.rows.select("s", "o").dtypes:
        view, known = view.as_terms(), known.as_terms()
        rows = view.rows.distinct()
    return replace(view, rows=rows.join(known.rows.select("s", "o"), ["s", "o"], "left_anti"))


def _first_wins(rule: Rule, found: Solutions) -> Solutions:
    """Of a run-once rule whose facts its own NOT would see: the first solution for each binding that NOT looks at."""
    for x in rule.body:
        if isinstance(x, Not):
            inner = [p for p in x.body if isinstance(p, Pattern)]
            if any(may_feed(t, p) for t in rule.head for p in inner) and found.rows is not None:
                shared = sorted({v for p in inner for v in p.variables()} & set(found.kinds))
                if not shared:  # the first of all
                    found = Solutions(found.rows.orderBy(*sorted(found.kinds)).limit(1), found.kinds)
                    continue
                order = W.partitionBy(*shared).orderBy(*sorted(found.kinds))
                found = Solutions(found.rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n"), found.kinds)
    return found


def transitive_closure(view: View, max_rounds: int = 64) -> View:
    """All pairs joined by one or more steps: what a round found is joined with all there is, on either side, so paths
    double in length and a path of length n takes about log2(n) rounds, without joining old pairs again."""
    rows = new = cut(view.rows.select("s", "o").distinct())
    for _ in range(max_rounds):
        ahead = new.join(rows.select(F.col("s").alias("o"), F.col("o").alias("to")), "o").select("s", F.col("to").alias("o"))
        back = rows.join(new.select(F.col("s").alias("o"), F.col("o").alias("to")), "o").select("s", F.col("to").alias("o"))
        new = cut(ahead.union(back).distinct().join(rows, ["s", "o"], "left_anti"))
        if new.limit(1).count() == 0:
            return replace(view, rows=rows)
        rows = cut(rows.union(new))
    raise RuleError("transitive closure did not settle")


def run(graph: Graph, rules: Sequence[Rule | Transitive], max_passes: int = 10_000, strict: bool = False, checked: bool = True) -> Result:
    """Everything that the rules infer. Errors in the rules, and with ``strict`` warnings, raise RuleError."""
    closures = [r for r in rules if isinstance(r, Transitive)]
    plain = [r for r in rules if isinstance(r, Rule)]
    for c in closures:  # alone a closure is squared; where rules feed it, it is a rule like any other
        if any(is_variable(t.p) or t.p == c.predicate for r in plain for t in r.head):
            plain.append(Rule(("?x", c.predicate, "?z"), [("?x", c.predicate, "?y"), ("?y", c.predicate, "?z")], f"transitive {c.predicate}"))
    if checked:
        wrong = [f for f in findings(plain) if f.severity == "error" or strict]
        if wrong:
            raise RuleError("; ".join(f"{f.code}: rule {f.rule}: {f.message}" for f in wrong))
    out = Result(graph)
    for c in closures:
        if not any(is_variable(t.p) or t.p == c.predicate for r in plain for t in r.head):
            view = graph.view(c.predicate)
            _add(out, {c.predicate: _new(transitive_closure(view), view)})
    edges = dependencies(plain)
    for level in strata(plain):
        ordinary = [i for i in level if not plain[i].run_once]
        inside = set(ordinary)
        looping = [e for e in edges if e.user in inside and e.maker in inside]
        # a rule that nothing in a loop reaches runs once, in the order of its needs
        order = _ordered(ordinary, looping)
        for group in order:
            members = set(group)
            if any(e.user in members and e.maker in members for e in looping):
                _loop(out, [plain[i] for i in group], max_passes)
            else:
                _add(out, _evaluate(out.graph, [plain[i] for i in group]))
                out.passes += 1
        for i in level:
            if plain[i].run_once:
                _add(out, _evaluate(out.graph, [plain[i]]))
    return out


def _ordered(rules: list[int], edges: list) -> list[list[int]]:
    """Components in the order of their needs; components without needs among each other run together."""
    place = {r: k for k, r in enumerate(rules)}
    of = components(len(rules), [Edge(place[e.user], place[e.maker], "", False) for e in edges])
    level = [0] * len(rules)
    for _ in rules:
        for e in edges:
            a, b = place[e.user], place[e.maker]
            if of[a] != of[b]:
                level[of[a]] = max(level[of[a]], level[of[b]] + 1)
    groups: dict[tuple, list[int]] = {}
    looping = {of[place[e.user]] for e in edges if of[place[e.user]] == of[place[e.maker]]}
    for k, r in enumerate(rules):
        c = of[k]
        groups.setdefault((level[c], c if c in looping else -1), []).append(r)
    return [groups[k] for k in sorted(groups)]


def _evaluate(graph: Graph, rules: Sequence[Rule], views=None) -> dict[str, View]:
    """Facts of all rules over the graph, with each rule's body solved once."""
    made: dict[str, list[View]] = {}
    for rule in rules:
        if not graph.knows([x for x in rule.body if isinstance(x, Pattern | Path)]):
            continue
        found = solve(rule.body, graph, views)
        if rule.run_once:
            found = _first_wins(rule, found)
            if any(getattr(x, "volatile", False) for x in rule.body):
                found = Solutions(cut(found.rows), found.kinds)  # new values are made once
        for t in rule.head:
            if is_variable(t.p):
                loose = loose_triples(t, found, graph)
                if loose is not None:
                    for (p,) in loose.select("p").distinct().collect():
                        made.setdefault(p, []).append(View(loose.where(F.col("p") == p).select("s", "o")))
            elif (view := head_view(t, found, graph)) is not None:
                made.setdefault(t.p, []).append(view)
    return {p: together(v) for p, v in made.items()}


def _add(out: Result, made: dict[str, View]) -> None:
    for p, view in made.items():
        known = out.graph.view(p) if p in out.graph.predicates or out.graph._loose is not None else None
        fresh = _new(view, known)
        out.graph = out.graph.with_view(p, fresh)
        out.made[p] = together([out.made[p], fresh]) if p in out.made else fresh


def _loop(out: Result, rules: Sequence[Rule], max_passes: int) -> None:
    """Semi-naive: after the first pass, each recursive pattern of a body in turn reads only what the last pass
    made. Every delta is cut by checkpoint; the facts so far are folded into one checkpoint as they grow."""
    start = out.graph
    heads = {t.p for r in rules for t in r.head}
    if any(is_variable(p) for p in heads):  # what they make isn't known beforehand: every pass reads everything
        for _ in range(max_passes):
            out.passes += 1
            before = dict(out.made)
            made = _evaluate(out.graph, rules)
            fresh = {p: _new(v, out.graph.view(p)) for p, v in made.items()}
            fresh = {p: replace(v, rows=cut(v.rows)) for p, v in fresh.items()}
            fresh = {p: v for p, v in fresh.items() if v.rows.limit(1).count()}
            if not fresh:
                out.made = before
                return
            _add(out, fresh)
        raise RuleError(f"a recursive stratum did not settle in {max_passes} passes")
    first = _evaluate(start, rules)
    delta = {p: replace(v, rows=cut(v.rows)) for p, v in ((p, _new(v, start.view(p) if p in start.predicates else None)) for p, v in first.items())}
    made = dict(delta)
    for n in range(max_passes):
        out.passes += 1
        live = {p: v for p, v in delta.items() if v.rows.limit(1).count()}
        if not live:
            break
        now = start
        for p, v in made.items():
            now = now.with_view(p, v)
        parts: dict[str, list[View]] = {}
        for r in rules:
            for i, x in enumerate(r.body):
                if isinstance(x, Pattern) and x.p in live:
                    one = lambda k, p, i=i: live[p] if k == i else None
                    for p, v in _evaluate(now, [r], one).items():
                        parts.setdefault(p, []).append(v)
                elif not isinstance(x, Pattern) and any(q.p in live for q, neg in reads([x]) if not neg):
                    for p, v in _evaluate(now, [r]).items():
                        parts.setdefault(p, []).append(v)
                elif isinstance(x, Pattern) and is_variable(x.p):
                    for p, v in _evaluate(now, [r]).items():
                        parts.setdefault(p, []).append(v)
        fresh = {p: _new(together(v), now.view(p) if p in now.predicates else None) for p, v in parts.items()}
        delta = {p: replace(v, rows=cut(v.rows)) for p, v in fresh.items()}
        for p, v in delta.items():
            made[p] = together([made[p], v]) if p in made else v
            if n % 8 == 7:
                made[p] = replace(made[p], rows=cut(made[p].rows))
    else:
        raise RuleError(f"a recursive stratum did not settle in {max_passes} passes")
    for p, v in made.items():
        out.graph = out.graph.with_view(p, v)
        out.made[p] = together([out.made[p], v]) if p in out.made else v


__all__ = ["Result", "RuleError", "cut", "run", "transitive_closure"]
