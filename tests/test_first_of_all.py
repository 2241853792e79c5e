"""A run-once rule whose NOT shares no variable with the rest keeps one solution, without one task that sorts all."""

from __future__ import annotations

from triplane.operators.body import solve
from triplane.plans.fixpoint import _first_wins, run
from triplane.rules import Not, Rule, Set
from triplane.sources.graph import Graph, View


def test_first_of_all(spark):
    n = View(spark.createDataFrame([(f"x{i}", i) for i in range(50)], "s string, o int"), None, None)
    found = View(spark.createDataFrame([], "s string, o int"), None, None)
    g = Graph(spark).with_view("n", n).with_view("found", found)
    rule = Rule(("?x", "found", "?w"), [("?x", "n", "?v"), Not(("?any", "found", "?other")), Set("w", lambda v: v.v + 1)])
    assert rule.run_once
    kept = _first_wins(rule, solve(rule.body, g)).rows
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "TakeOrdered" in plan
    assert [tuple(r) for r in run(g, [rule]).select([("?x", "found", "?w")], "x", "w").collect()] == [("x0", 1)]
