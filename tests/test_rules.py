"""Rules, patterns, negation, recursion and analysis."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from triplane import output, terms
from triplane.functions import builtins as B
from triplane.operators.body import select, solve
from triplane.plans.fixpoint import RuleError, run
from triplane.output import solution_lines
from triplane.plans.strata import components, dependencies, findings, strata
from triplane.rules import Filter, Not, Path, Rule, Set, Transitive, inverse, symmetric
from triplane.sources.graph import Graph, Mapping, View, annotated, list_facts, reified
from triplane.streaming.incremental import derived_stream, write_stream


@pytest.fixture
def family(spark):
    return Graph(spark).with_facts([("<A>", "fatherOf", "<X>"), ("<B>", "motherOf", "<X>"), ("<C>", "motherOf", "<A>")])


ANCESTORS = [
    Rule(("?x", "childOf", "?y"), [("?y", "fatherOf", "?x")]),
    Rule(("?x", "childOf", "?y"), [("?y", "motherOf", "?x")]),
    Rule(("?x", "descendedFrom", "?y"), [("?x", "childOf", "?y")]),
    Rule(("?x", "descendedFrom", "?y"), [("?x", "childOf", "?z"), ("?z", "descendedFrom", "?y")]),
]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_recursion(family):
    out = run(family, ANCESTORS)
    assert rows(out.select([("?x", "descendedFrom", "?y")])) == [("<A>", "<C>"), ("<X>", "<A>"), ("<X>", "<B>"), ("<X>", "<C>")]
    assert out.inferred().count() == 7
    assert out.graph.triples().count() == 10
    assert [r.line for r in output.lines(out.inferred()).collect()][:2] == ["<A> :childOf <C> .", "<A> :descendedFrom <C> ."]


def test_negation_theta_and_assignment(spark):
    path = lambda n, a, b, **c: [(n, terms.TYPE, "<Path>"), (n, "from", a), (n, "to", b), *((n, k, v) for k, v in c.items())]
    g = Graph(spark).with_facts([*path("<ac>", "<A>", "<C>", cost=5), *path("<abc>", "<A>", "<C>", left=2, right=1), *path("<ab>", "<A>", "<B>", cost=2)])
    number = terms.number
    rules = [
        Rule(("?p", "best", True), [("?p", terms.TYPE, "<Path>"), Not(("?p", "dominated", True))]),
        Rule(("?p", "cost", "?total"), [("?p", "left", "?l"), ("?p", "right", "?r"), Set("total", lambda v: terms.number_term(number(v.l) + number(v.r)), term=True)]),
        Rule(("?p", "dominated", True), [("?p", "from", "?a"), ("?p", "to", "?b"), ("?p", "cost", "?c"), ("?q", "from", "?a"), ("?q", "to", "?b"), ("?q", "cost", "?d"), Filter(lambda v: number(v.d) < number(v.c))]),
    ]
    out = run(g, rules)
    assert rows(out.select([("?p", "best", True)])) == [("<ab>",), ("<abc>",)]
    assert rows(out.select([("?p", "dominated", True)])) == [("<ac>",)]
    assert [r for level in strata(rules) for r in level][-1] == 0


def test_variable_predicates_and_heads(spark, family):
    out = run(family, [Rule(("?y", "?p", "?x"), [("?x", "?p", "?y"), Filter(lambda v: v.p == "<motherOf>")])])
    assert rows(out.select([("<X>", "motherOf", "?o")])) == [("<B>",)]
    assert out.graph.triples().count() == 5
    # a template with an unbound variable makes nothing, the others do
    out = run(family, [Rule([("?x", "a", "?nothing"), ("?x", "b", "?y")], [("?x", "fatherOf", "?y")])])
    assert set(out.made) == {"b"}


def test_paths_lists_and_reifiers(spark):
    g = Graph(spark).with_facts([("<x>", "has", "<l>"), *list_facts("<l>", [1, "two", True]), *annotated("<r>", "<a>", "knows", "<b>", by="<c>"), *reified("<q>", "<a>", "likes", "<d>")])
    assert rows(select([Path("<x>", ("has", terms.REST, terms.REST, terms.FIRST), "?v")], g)) == [("true",)]
    assert rows(select([Path("?v", (f"^{terms.FIRST}", "^has"), "?x")], g)) == [("1", "<x>")]
    who = [("?r", terms.REIFIES, "?t"), Set("o", lambda v: terms.part(v.t, 2), term=True)]
    assert rows(select([*who, ("<a>", "knows", "?o")], g, "r")) == [("<r>",)]
    assert rows(select(who, g, "r", "o")) == [("<q>", "<d>"), ("<r>", "<b>")]
    assert select([("?a", "likes", "?b")], g.with_facts([("<z>", "likes", "<y>")])).count() == 1


def test_declarations(spark):
    g = Graph(spark).with_view("next", View(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2)], "s int, o int"), None, None))
    closed = run(g, [Transitive("next")]).select([("?x", "next", "?y")])
    assert rows(closed) == sorted([(1, 2), (1, 3), (1, 4)] + [(a, b) for a in (2, 3, 4) for b in (2, 3, 4)])
    fed = run(g, [Transitive("next"), Rule(("?y", "next", "?x"), [("?x", "back", "?y")])])
    assert fed.select([("?x", "next", "?y")]).count() == closed.count()
    assert run(g, symmetric("next")).select([("?x", "next", "?y")]).count() == 8
    assert rows(run(g, inverse("next", "prev")).select([("?x", "prev", "?y")])) == [(2, 1), (2, 4), (3, 2), (4, 3)]


def test_run_once(spark):
    miles = View(spark.createDataFrame([("a", 10.0), ("b", 5.0)], "s string, o double"), None, None)
    km = View(spark.createDataFrame([("b", 8.0)], "s string, o double"), None, None)
    g = Graph(spark).with_view("miles", miles).with_view("km", km)
    rule = Rule(("?x", "km", "?k"), [("?x", "miles", "?m"), Not(("?x", "km", "?any")), Set("k", lambda v: v.m * 1.6)])
    assert rule.run_once and not findings([rule])
    assert rows(run(g, [rule]).select([("?x", "km", "?k")], "x", "k")) == [("a", 16.0), ("b", 8.0)]
    several = g.with_view("miles", View(spark.createDataFrame([("a", 20.0)], "s string, o double"), None, None))
    assert run(several, [rule]).select([("?x", "km", "?k")]).count() == 2  # the first value wins


def test_value_inventing_recursion(spark):
    g = Graph(spark).with_view("n", View(spark.createDataFrame([(0, 0)], "s int, o int"), None, None))
    rule = lambda top: Rule(("?m", "n", "?m"), [("?x", "n", "?n"), Filter(lambda v: v.n < top), Set("m", lambda v: v.n + 1)])
    assert run(g, [rule(4)]).select([("?x", "n", "?n")]).count() == 5
    with pytest.raises(RuleError, match="did not settle"):
        run(g, [rule(10**6)], max_passes=3)
    with pytest.raises(RuleError, match="recursive-assignment-rule"):
        run(g, [rule(4)], strict=True)


def test_findings():
    bad = [
        Rule(("?x", "p", "?z"), [("?x", "q", "?y"), Filter(lambda v: v.u > 1)]),
        Rule(("?x", "p", "?y"), [("?x", "q", "?y"), Set("y", lambda v: v.x)]),
        Rule(("?x", "p", "?v"), [("?x", "q", "?y"), Set("v", lambda v: v.w)]),
        Rule(("?x", '"text"', "?y"), [("?x", "q", "?y")]),
        Rule(("?x", "s", True), [("?x", "q", "?y"), Not(("?x", "t", True))]),
        Rule(("?x", "t", True), [("?x", "q", "?y"), Not(("?x", "s", True))]),
    ]
    assert {(f.rule, f.code) for f in findings(bad)} == {
        (0, "unbound-filter-variable"), (0, "unsafe-head-variable"), (1, "assignment-variable-already-bound"), (2, "unbound-assignment-variable"),
        (3, "invalid-head-predicate"), (4, "unstratified-negation"), (5, "unstratified-negation"),
    }
    # constants that differ, or a repeated variable that would meet two, make no dependency
    assert not dependencies([Rule(("?x", "p", "<a>"), []), Rule(("?x", "r", "?x"), [("?x", "p", "<b>")])])[0:]
    assert not [e for e in dependencies([Rule(("?x", "p", "?x"), []), Rule(("<z>", "r", "<z>"), [("<a>", "p", "<b>")])]) if e.user == 1]


def test_empty_and_unknown(spark, family):
    assert rows(run(family, [Rule(("<a>", "is", 1), [])]).select([("?x", "is", "?y")])) == [("<a>", "1")]
    assert select([("?x", "nobody", "?y")], family).count() == 0
    assert rows(select([("?x", "fatherOf", "?y"), Not(("?x", "nobody", "?z"))], family)) == [("<A>", "<X>")]
    assert rows(select([("?x", "fatherOf", "?x")], family)) == []
    assert select([("<A>", "fatherOf", "<X>"), ("?x", "motherOf", "?y")], family).count() == 2
    assert select([("<A>", "fatherOf", "<Q>"), ("?x", "motherOf", "?y")], family).count() == 0


def test_tables_are_read_once(spark, sf_dir):
    """Patterns about one subject become one scan with pruned columns and pushed filters."""
    orders = Mapping("order", "o_orderkey", {"o_orderstatus": "status", "o_totalprice": "price", "o_custkey": "by"}, {"o_custkey": "customer"})
    g = Graph(spark).with_table(spark.read.parquet(f"{sf_dir}/orders.parquet"), orders)
    body = [("?o", "status", "F"), ("?o", "price", "?p"), ("?o", "by", "<customer/7>"), Filter(lambda v: v.p > 1000)]
    plan = solve(body, g).rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert "EqualTo(o_orderstatus,F)" in plan and "EqualTo(o_custkey,7)" in plan and "o_orderdate" not in plan
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet")
    assert select(body, g).count() == raw.where("o_orderstatus = 'F' and o_custkey = 7 and o_totalprice > 1000").count()


def test_merged_sources(spark, family):
    other = Graph(spark).with_facts([("<X>", "fatherOf", "<Y>")]).with_triples(spark.createDataFrame([("<Y>", "likes", '"tea"')], "s string, p string, o string"))
    both = family.with_graph(other)
    assert select([("?x", "fatherOf", "?y")], both).count() == 2
    assert rows(select([("?x", "likes", "?y")], both)) == [("<Y>", '"tea"')]


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: B.round_half_up(F.lit(-3.5)), -3.0), (lambda: B.ceil(F.lit(-3.7)), -3.0), (lambda: B.floor(F.lit(-3.7)), -4.0), (lambda: B.divide(F.lit(1), F.lit(0)), float("inf")),
        (lambda: B.substr(F.lit("Hello"), F.lit(2), F.lit(3)), "ell"), (lambda: B.substr(F.lit("Hello"), F.lit(0), F.lit(2)), "He"), (lambda: B.substr(F.lit("Hello"), F.lit(3)), "llo"),
        (lambda: B.strlen(F.lit("a😀")), 3), (lambda: B.encode_for_uri(F.lit("a b/é!~*'()")), "a%20b%2F%C3%A9!~*'()"), (lambda: B.before(F.lit("a-b"), F.lit("-")), "a"), (lambda: B.after(F.lit("a-b"), F.lit("x")), ""),
        (lambda: B.replace(F.lit("aXbx"), "x", "-", "i"), "a-b-"), (lambda: B.replace(F.lit("a1b2"), "([a-z])([0-9])", "$2$1$3$$$&\\"), "1a$3$a1\\2b$3$b2\\"), (lambda: B.replace(F.lit("a"), "(", "b"), None),
        (lambda: B.absolute(F.lit("x")), None), (lambda: B.ceil(F.lit("x")), None), (lambda: B.ceil(F.lit(1e300)), 1e300), (lambda: B.divide(F.lit("x"), F.lit(1)), None), (lambda: B.substr(F.lit("Hello"), F.lit("x")), None),
        (lambda: B.substr(F.lit("Hello"), F.lit(1e30)), ""), (lambda: B.multiply(F.lit("3"), F.lit(2)), 6.0), (lambda: B.add(F.lit("a"), F.lit("b")), "ab"), (lambda: B.add(F.lit("1"), F.lit(2)), "3"), (lambda: B.subtract(F.lit("y"), F.lit(2)), None),
        (lambda: B.tz(F.lit("2026-05-15Z")), ""), (lambda: B.hours(F.lit("2026-05-15T10:20")), 0.0), (lambda: B.year(F.lit("2026-05-15 and on")), 2026.0), (lambda: B.timezone(F.lit("2026-05-15T10:20:30-0000")), "-PT0S"),
        (lambda: terms.number_term(F.lit(1234.56)), "1234.56"), (lambda: terms.number_term(F.lit(0.1) + F.lit(0.2)), "0.30000000000000004"), (lambda: terms.number_term(F.lit(-0.000001)), "-0.000001"), (lambda: terms.same_term(F.lit("1"), F.lit("1.0")), False),
        (lambda: terms.str_lang_dir(F.lit("x"), F.lit("EN"), F.lit("up")), None), (lambda: B.regex(F.lit("Hello"), "^hel", "i"), True), (lambda: B.concat(), ""), (lambda: B.lang_matches(F.lit("en-GB"), F.lit("EN")), True),
        (lambda: B.hours(F.lit("2026-05-15T10:20:30+02:30")), 10.0), (lambda: B.hours(F.lit("2026-05-15")), 0.0), (lambda: B.year(F.lit("no")), None), (lambda: B.seconds(F.lit("2026-05-15T10:20:30.5Z")), 30.5),
        (lambda: B.timezone(F.lit("2026-05-15T10:20:30+02:30")), "PT2H30M"), (lambda: B.timezone(F.lit("2026-05-15T10:20:30Z")), "PT0S"), (lambda: B.timezone(F.lit("2026-05-15T10:20:30")), None), (lambda: B.tz(F.lit("2026-05-15T10:20:30-05:00")), "-05:00"),
        (lambda: B.resolve(F.lit("local"), "http://example/base/"), "http://example/base/local"), (lambda: B.resolve(F.lit("urn:x"), "http://e/"), "urn:x"), (lambda: B.less(F.lit("10"), F.lit("9")), False), (lambda: B.truth(F.lit("false"), "string"), False),
        (lambda: terms.lang(F.lit('"x"@fr--ltr')), "fr"), (lambda: terms.lang_dir(F.lit('"x"@fr--ltr')), "ltr"), (lambda: terms.string(F.lit('"x"@en-GB')), "x"), (lambda: terms.string(F.lit("<urn:a>")), "urn:a"),
        (lambda: terms.datatype(F.lit("42")), f"{terms.XSD}integer"), (lambda: terms.datatype(F.lit('"x"')), f"{terms.XSD}string"), (lambda: terms.datatype(F.lit("<a>")), None), (lambda: terms.number(F.lit("-3.7")), -3.7),
        (lambda: terms.number_term(F.lit(72.0)), "72"), (lambda: terms.number_term(F.lit(7.500000000000003e-7)), "7.500000000000003e-7"), (lambda: terms.part(terms.triple(F.lit("<a>"), F.lit("<p>"), F.lit('"q\\"')), 2), '"q\\"'),
    ],
)
def test_functions(spark, column, want):
    assert value(spark, column()) == want


def test_number_text():
    cases = {1e21: "1e+21", 1e20: "100000000000000000000", 0.00004788: "0.00004788", 1e-7: "1e-7", 1.5e-7: "1.5e-7", -0.0: "0", 0.1 + 0.2: "0.30000000000000004", 123456.789: "123456.789", 1e23: "1e+23", 2.5e20: "250000000000000000000"}
    assert {x: terms.number_text(x) for x in cases} == cases


def test_stream(spark, tmp_path):
    g = Graph(spark).with_view("home", View(spark.createDataFrame([(1, "here")], "s long, o string"), "user", None))
    spark.createDataFrame([(7, 1), (8, 2)], "s long, o long").write.parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema("s long, o long").parquet(str(tmp_path / "in"))
    rule = Rule(("?e", "at", "?h"), [("?e", "by", "?u"), ("?u", "home", "?h")])
    (out,) = derived_stream(g, rule, "by", arriving, "event", "user")
    write_stream(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(7, "here")]
    with pytest.raises(ValueError, match="NOT"):
        derived_stream(g, Rule(("?e", "x", 1), [("?e", "by", "?u"), Not(("?u", "home", "?h"))]), "by", arriving)


def test_components_of_many_rules():
    """Thousands of rules: heads are looked up by predicate, and cycles found in one walk."""
    rules = [Rule(("?x", f"p{i + 1}", "?y"), [("?x", f"p{i}", "?y")]) for i in range(3000)] + [Rule(("?x", "p500", "?y"), [("?x", "p900", "?y")])]
    edges = dependencies(rules)
    of = components(len(rules), edges)
    assert len(edges) == 3001 and len(set(of)) == 3001 - 400 and of[500] == of[899] == of[3000] == 500 and of[499] == 499


def test_solution_lines(spark):
    rows = spark.createDataFrame([("b", None), ("a", "1")], "y string, x string")
    assert [r.line for r in solution_lines(rows).collect()] == ["?x = 1; ?y = a", "?x = UNDEF; ?y = b"]
