"""The queries of the rule engine over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import terms
from .functions import builtins as B
from .functions.sudoku import sudoku
from .operators.body import select
from .plans.fixpoint import run
from .plans.strata import dependencies
from .rules import Filter, Not, Path, Rule, Set, Transitive, inverse, symmetric
from .sources.graph import Graph, Mapping, View, annotated, list_facts

LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
#: How the driver's tables are seen as facts: entity, key, column -> predicate, foreign key -> entity.
MAPPINGS = {
    "region": Mapping("region", "r_regionkey", {"r_name": "regionName"}),
    "nation": Mapping("nation", "n_nationkey", {"n_name": "nationName", "n_regionkey": "inRegion"}, {"n_regionkey": "region"}),
    "customer": Mapping("customer", "c_custkey", {"c_name": "customerName", "c_nationkey": "customerNation", "c_acctbal": "balance", "c_mktsegment": "segment"}, {"c_nationkey": "nation"}),
    "supplier": Mapping("supplier", "s_suppkey", {"s_name": "supplierName", "s_nationkey": "supplierNation", "s_acctbal": "supplierBalance"}, {"s_nationkey": "nation"}),
    "part": Mapping("part", "p_partkey", {"p_name": "partName", "p_brand": "brand", "p_type": "partType", "p_size": "size", "p_retailprice": "retailPrice"}),
    "orders": Mapping("order", "o_orderkey", {"o_custkey": "orderedBy", "o_orderstatus": "status", "o_totalprice": "totalPrice", "o_orderdate": "orderDate", "o_orderpriority": "priority"}, {"o_custkey": "customer"}),
    "lineitem": Mapping("lineitem", LINEITEM, {"l_orderkey": "ofOrder", "l_partkey": "ofPart", "l_suppkey": "suppliedBy", "l_quantity": "quantity", "l_extendedprice": "extendedPrice", "l_discount": "discount", "l_tax": "tax", "l_returnflag": "returnFlag", "l_shipdate": "shipDate"}, {"l_orderkey": "order", "l_partkey": "part", "l_suppkey": "supplier"}),
    "events": Mapping("event", "event_id", {"user_id": "user", "event_type": "eventType", "value": "eventValue", "ts": "eventTime"}),
    "documents": Mapping("document", "doc_id", {"lang": "language", "source": "source", "n_chars": "characters"}),
    "conversations": Mapping("message", ("conv_id", "turn"), {"conv_id": "conversation", "turn": "turn", "role": "role"}),
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def facts(spark: SparkSession, sf_dir: str, *tables: str) -> Graph:
    graph = Graph(spark)
    for t in tables:
        graph = graph.with_table(spark.read.parquet(f"{sf_dir}/{t}.parquet"), MAPPINGS[t])
    return graph


def query(sql: str | None, *tables: str) -> Callable[[Callable[[Graph], DataFrame]], Query]:
    """Registers a query over the facts of some tables, with its SQL."""

    def register(f: Callable[[Graph], DataFrame]) -> Query:
        def over(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(facts(spark, sf_dir, *tables))

        over.__doc__, over.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = over
        if sql:
            ORACLES[f.__name__] = sql
        return over

    return register


# Patterns and joins


@query("SELECT DISTINCT n_nationkey AS n, n_name AS name FROM nation", "nation")
def scan_pattern(g: Graph) -> DataFrame:
    return select([("?n", "nationName", "?name")], g)


@query("SELECT DISTINCT o_orderkey AS o FROM orders WHERE o_orderstatus = 'F'", "orders")
def const_object(g: Graph) -> DataFrame:
    return select([("?o", "status", "F")], g)


@query("SELECT DISTINCT n_name AS name FROM nation WHERE n_nationkey = 7", "nation")
def const_subject(g: Graph) -> DataFrame:
    return select([("<nation/7>", "nationName", "?name")], g)


@query("SELECT DISTINCT n_nationkey AS x FROM nation WHERE n_nationkey = n_regionkey", "nation")
def repeated_variable(g: Graph) -> DataFrame:
    near = g.view("inRegion").rows
    return select([("?x", "near", "?x")], g.with_view("near", View(near, None, None)))


@query("SELECT DISTINCT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey", "customer", "nation")
def join_two(g: Graph) -> DataFrame:
    return select([("?c", "customerName", "?customer"), ("?c", "customerNation", "?n"), ("?n", "nationName", "?nation")], g, "customer", "nation")


@query("SELECT DISTINCT c_custkey AS c, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer", "customer")
def join_star(g: Graph) -> DataFrame:
    return select([("?c", "customerName", "?name"), ("?c", "balance", "?balance"), ("?c", "segment", "?segment")], g)


CHAIN = "SELECT DISTINCT c_custkey AS c, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(CHAIN, "customer", "nation", "region")
def join_chain(g: Graph) -> DataFrame:
    return select([("?c", "customerNation", "?n"), ("?n", "inRegion", "?r"), ("?r", "regionName", "?region")], g, "c", "region")


@query("SELECT DISTINCT l_orderkey AS o, c_name AS customer, l_quantity AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 45", "lineitem", "orders", "customer")
def join_large(g: Graph) -> DataFrame:
    return select([("?l", "ofOrder", "?o"), ("?l", "quantity", "?quantity"), ("?o", "orderedBy", "?c"), ("?c", "customerName", "?customer"), Filter(lambda v: v.quantity >= 45)], g, "o", "customer", "quantity")


@query("SELECT DISTINCT a.p_partkey AS p, b.p_partkey AS q FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size > b.p_size", "part")
def cross_filter_theta(g: Graph) -> DataFrame:
    body = [("?p", "brand", "?b"), ("?p", "partType", "?t"), ("?p", "size", "?s"), ("?q", "brand", "?b"), ("?q", "partType", "?t"), ("?q", "size", "?s2")]
    return select([*body, Filter(lambda v: v.s > v.s2)], g, "p", "q")


VARIABLE = """
SELECT '<nation/' || n_nationkey || '>' AS s, '<nationName>' AS p, '"' || n_name || '"' AS o FROM nation
UNION SELECT '<nation/' || n_nationkey || '>', '<inRegion>', '<region/' || n_regionkey || '>' FROM nation
UNION SELECT '<region/' || r_regionkey || '>', '<regionName>', '"' || r_name || '"' FROM region"""


@query(VARIABLE, "nation", "region")
def variable_predicate(g: Graph) -> DataFrame:
    return select([("?s", "?p", "?o")], g)


# Filters


@query("SELECT DISTINCT o_orderkey AS o, o_totalprice AS price FROM orders WHERE o_totalprice > 250000", "orders")
def filter_numeric(g: Graph) -> DataFrame:
    return select([("?o", "totalPrice", "?price"), Filter(lambda v: v.price > 250000)], g)


@query("SELECT DISTINCT p_partkey AS p, p_name AS name FROM part WHERE contains(p_name, 'e') AND starts_with(p_brand, 'Brand#1')", "part")
def filter_string(g: Graph) -> DataFrame:
    return select([("?p", "partName", "?name"), ("?p", "brand", "?b"), Filter(lambda v: v.name.contains("e") & v.b.startswith("Brand#1"))], g, "p", "name")


@query("SELECT DISTINCT o_orderkey AS o FROM orders WHERE o_orderstatus IN ('F', 'P')", "orders")
def filter_in(g: Graph) -> DataFrame:
    return select([("?o", "status", "?s"), Filter(lambda v: v.s.isin("F", "P"))], g, "o")


@query("SELECT DISTINCT o_orderkey AS o FROM orders WHERE o_orderstatus NOT IN ('F', 'P')", "orders")
def filter_notin(g: Graph) -> DataFrame:
    return select([("?o", "status", "?s"), Filter(lambda v: ~v.s.isin("F", "P"))], g, "o")


@query("SELECT DISTINCT o_orderkey AS o FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice < 50000) AND NOT (o_totalprice > 300000)", "orders")
def filter_logic(g: Graph) -> DataFrame:
    test = Filter(lambda v: ((v.s == "F") | (v.p < 50000)) & ~(v.p > 300000))
    return select([("?o", "status", "?s"), ("?o", "totalPrice", "?p"), test], g, "o")


@query("SELECT DISTINCT p_partkey AS p FROM part WHERE regexp_matches(p_name, '(?i)^[a-m].*[aeiou]')", "part")
def filter_regex(g: Graph) -> DataFrame:
    return select([("?p", "partName", "?n"), Filter(lambda v: B.regex(v.n, "^[a-m].*[aeiou]", "i"))], g, "p")


# Negation


@query("SELECT DISTINCT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')", "customer", "orders")
def not_anti_join(g: Graph) -> DataFrame:
    return select([("?c", "customerName", "?n"), Not(("?o", "orderedBy", "?c"), ("?o", "priority", "1-URGENT"))], g, "c")


@query("SELECT DISTINCT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", "customer", "orders")
def not_with_filter(g: Graph) -> DataFrame:
    return select([("?c", "customerName", "?n"), Not(("?o", "orderedBy", "?c"), ("?o", "totalPrice", "?p"), Filter(lambda v: v.p > 400000))], g, "c")


@query("SELECT DISTINCT a.o_orderkey AS o FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_totalprice > a.o_totalprice)", "orders")
def not_with_outer_filter(g: Graph) -> DataFrame:
    """Each customer's dearest order: the inner filter names an outer variable."""
    better = Not(("?b", "orderedBy", "?c"), ("?b", "totalPrice", "?q"), Filter(lambda v: v.q > v.p))
    return select([("?o", "orderedBy", "?c"), ("?o", "totalPrice", "?p"), better], g, "o")


@query("SELECT DISTINCT r_name AS name FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_name = 'ATLANTIS')", "nation", "region")
def not_uncorrelated(g: Graph) -> DataFrame:
    return select([Not(("?n", "nationName", "ATLANTIS")), ("?r", "regionName", "?name")], g, "name")


# Assignment and paths


@query("SELECT DISTINCT l_extendedprice AS price, l_discount AS discount, l_extendedprice * (1 - l_discount) AS net FROM lineitem", "lineitem")
def set_arith(g: Graph) -> DataFrame:
    return select([("?l", "extendedPrice", "?price"), ("?l", "discount", "?discount"), Set("net", lambda v: v.price * (1 - v.discount))], g, "price", "discount", "net")


NEXT = "SELECT DISTINCT a.conv_id AS c, a.turn AS t, b.turn AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


@query(NEXT, "conversations")
def set_then_join(g: Graph) -> DataFrame:
    body = [("?m", "conversation", "?c"), ("?m", "turn", "?t"), Set("n", lambda v: v.t + 1), ("?k", "conversation", "?c"), ("?k", "turn", "?n")]
    return select(body, g, "c", "t", "n")


@query(CHAIN, "customer", "nation", "region")
def path_sequence(g: Graph) -> DataFrame:
    return select([Path("?c", ("customerNation", "inRegion", "regionName"), "?region")], g)


@query("SELECT DISTINCT n_nationkey AS n, c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey", "customer", "nation")
def path_inverse(g: Graph) -> DataFrame:
    return select([Path("?n", ("^customerNation",), "?c")], g)


@query("SELECT DISTINCT s_suppkey AS s, c_custkey AS c FROM supplier JOIN customer ON s_nationkey = c_nationkey", "customer", "supplier")
def path_group(g: Graph) -> DataFrame:
    return select([Path("?s", ("supplierNation", "^customerNation"), "?c")], g)


# Rules


@query("SELECT DISTINCT n_name AS nation, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", "customer", "supplier", "nation")
def union_by_rules(g: Graph) -> DataFrame:
    rules = [
        Rule(("?n", "home", "?x"), [("?c", "customerNation", "?n"), ("?c", "customerName", "?x")]),
        Rule(("?n", "home", "?x"), [("?s", "supplierNation", "?n"), ("?s", "supplierName", "?x")]),
    ]
    return run(g, rules).select([("?n", "home", "?name"), ("?n", "nationName", "?nation")], "nation", "name")


@query("SELECT DISTINCT c_custkey AS c, r_name AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 5000", "customer", "nation", "region")
def rule_then_query(g: Graph) -> DataFrame:
    rule = Rule(("?c", "customerRegion", "?r"), [("?c", "customerNation", "?n"), ("?n", "inRegion", "?r"), ("?c", "balance", "?b"), Filter(lambda v: v.b > 5000)])
    return run(g, [rule]).select([("?c", "customerRegion", "?r"), ("?r", "regionName", "?rn")], "c", "rn")


@query("SELECT DISTINCT o_orderkey AS o, c_name AS name, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey", "orders", "customer")
def head_multi(g: Graph) -> DataFrame:
    rule = Rule([("?o", "buyer", "?n"), ("?o", "state", "?s")], [("?o", "orderedBy", "?c"), ("?c", "customerName", "?n"), ("?o", "status", "?s")])
    return run(g, [rule]).select([("?o", "buyer", "?name"), ("?o", "state", "?status")])


@query("SELECT '<world>' AS s, '\"round\"' AS o")
def empty_body_fact(g: Graph) -> DataFrame:
    return run(g, [Rule(("<world>", "shape", "round"), [])]).select([("?s", "shape", "?o")])


STEPS = "SELECT DISTINCT a.conv_id || '/' || a.turn AS x, b.conv_id || '/' || b.turn AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
REACH = f"WITH RECURSIVE e AS ({STEPS}), r AS (SELECT x, y FROM e UNION SELECT e.x, r.y FROM e JOIN r ON e.y = r.x) SELECT x, y FROM r"
NEXT_TURN = Rule(("?m", "next", "?k"), [("?m", "conversation", "?c"), ("?m", "turn", "?t"), Set("n", lambda v: v.t + 1), ("?k", "conversation", "?c"), ("?k", "turn", "?n")])


def with_next(g: Graph) -> Graph:
    return run(g, [NEXT_TURN]).graph


@query(REACH, "conversations")
def transitive_declaration(g: Graph) -> DataFrame:
    return run(with_next(g), [Transitive("next")]).select([("?x", "next", "?y")])


@query(f"WITH e AS ({STEPS}) SELECT x, y FROM e UNION SELECT y, x FROM e", "conversations")
def symmetric_declaration(g: Graph) -> DataFrame:
    return run(with_next(g), symmetric("next")).select([("?x", "next", "?y")])


@query(f"WITH e AS ({STEPS}) SELECT y AS x, x AS y FROM e", "conversations")
def inverse_declaration(g: Graph) -> DataFrame:
    return run(with_next(g), inverse("next", "previous")).select([("?x", "previous", "?y")])


@query(REACH, "conversations")
def recursion_linear(g: Graph) -> DataFrame:
    rules = [Rule(("?x", "after", "?y"), [("?x", "next", "?y")]), Rule(("?x", "after", "?z"), [("?x", "next", "?y"), ("?y", "after", "?z")])]
    return run(with_next(g), rules).select([("?x", "after", "?y")])


PARITY = f"WITH RECURSIVE e AS ({STEPS}), r AS (SELECT x, y, 1 AS k FROM e UNION SELECT e.x, r.y, 1 - r.k FROM e JOIN r ON e.y = r.x) SELECT x, y FROM r WHERE k = 0"


@query(PARITY, "conversations")
def recursion_mutual(g: Graph) -> DataFrame:
    """Pairs an even number of turns apart, by two rules that need each other."""
    rules = [
        Rule(("?x", "odd", "?y"), [("?x", "next", "?y")]),
        Rule(("?x", "even", "?z"), [("?x", "next", "?y"), ("?y", "odd", "?z")]),
        Rule(("?x", "odd", "?z"), [("?x", "next", "?y"), ("?y", "even", "?z")]),
    ]
    return run(with_next(g), rules).select([("?x", "even", "?y")])


@query("SELECT DISTINCT conv_id || '/' || turn AS m FROM conversations a WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1)", "conversations")
def strata_negation(g: Graph) -> DataFrame:
    rules = [Rule(("?m", "isLast", True), [("?m", "turn", "?t"), Not(("?m", "next", "?k"))]), NEXT_TURN]
    return run(g, rules).select([("?m", "isLast", True)])


@query("WITH RECURSIVE r(n) AS (SELECT 0 UNION SELECT n + 1 FROM r WHERE n < 10) SELECT CAST(n AS BIGINT) AS n FROM r")
def value_inventing_recursion(g: Graph) -> DataFrame:
    start = g.with_view("depth", View(g.spark.sql("SELECT 0L AS s, 0L AS o"), None, None))
    rule = Rule(("?m", "depth", "?m"), [("?x", "depth", "?n"), Filter(lambda v: v.n < 10), Set("m", lambda v: v.n + 1)])
    return run(start, [rule]).select([("?x", "depth", "?n")], "n")


RUN_ONCE = "SELECT DISTINCT o_orderkey AS o, o_totalprice * 0.5 AS half FROM orders WHERE o_orderstatus <> 'F' UNION SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'"


@query(RUN_ONCE, "orders")
def run_once_assign_not(g: Graph) -> DataFrame:
    """An assigned default where a value isn't stated yet: the rule's NOT looks at what the rule itself makes."""
    stated = Rule(("?o", "fee", "?p"), [("?o", "status", "F"), ("?o", "totalPrice", "?p")])
    default = Rule(("?o", "fee", "?half"), [("?o", "totalPrice", "?p"), Not(("?o", "fee", "?any")), Set("half", lambda v: v.p * 0.5)])
    return run(g, [stated, default]).select([("?o", "fee", "?half")])


@query("SELECT DISTINCT c_custkey AS c, n_regionkey AS r, false AS made FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 UNION ALL SELECT DISTINCT c_custkey, n_regionkey, true FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal <= 0", "customer", "nation")
def equal_after_derivation(g: Graph) -> DataFrame:
    """A rule that repeats what is known adds nothing: only what isn't known yet is made."""
    body = [("?c", "customerNation", "?n"), ("?n", "inRegion", "?r")]
    known = run(g, [Rule(("?c", "customerRegion", "?r"), [*body, ("?c", "balance", "?b"), Filter(lambda v: v.b > 0)])]).graph
    out = run(known, [Rule(("?c", "customerRegion", "?r"), body)])
    made = out.made["customerRegion"].rows.select(F.col("s").alias("c"), F.col("o").alias("r"), F.lit(True).alias("made"))
    return out.select([("?c", "customerRegion", "?r")]).join(made, ["c", "r"], "left").select("c", "r", F.coalesce("made", F.lit(False)).alias("made"))


@query(f"WITH e AS ({STEPS}), r AS ({REACH}) SELECT x, y FROM r EXCEPT SELECT x, y FROM e", "conversations")
def inferred_vs_closure(g: Graph) -> DataFrame:
    out = run(with_next(g), [Transitive("next")])
    return out.made["next"].rows.select(F.col("s").alias("x"), F.col("o").alias("y"))


@query("SELECT DISTINCT c_mktsegment AS segment, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey", "customer", "nation")
def query_projection(g: Graph) -> DataFrame:
    out = run(g, [Rule(("?c", "livesIn", "?nn"), [("?c", "customerNation", "?n"), ("?n", "nationName", "?nn")])])
    return out.select([("?c", "livesIn", "?nation"), ("?c", "segment", "?segment")], "segment", "nation")


@query("SELECT * FROM (VALUES (1, 0, 'a', false), (2, 1, 'b', true)) t(rule, needs, predicate, negative)")
def rule_dependencies(g: Graph) -> DataFrame:
    rules = [Rule(("?x", "a", "?y"), [("?x", "base", "?y")]), Rule(("?x", "b", "?y"), [("?x", "a", "?y")]), Rule(("?x", "c", True), [("?x", "base", "?y"), Not(("?x", "b", "?y"))])]
    rows = [(e.user, e.maker, e.predicate, e.negative) for e in dependencies(rules)]
    return g.spark.createDataFrame(rows, "rule int, needs int, predicate string, negative boolean")


@query("SELECT DISTINCT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey", "nation", "region")
def imports_merge(g: Graph) -> DataFrame:
    """Two sources, each with its own facts, merged."""
    own, other = (Graph(g.spark).with_view(p, g.view(p)) for p in ("nationName", "regionName"))
    own = own.with_view("inRegion", g.view("inRegion"))
    g = own
    rules = [Rule(("?n", "regionOf", "?rn"), [("?n", "inRegion", "?r"), ("?r", "regionName", "?rn")])]
    return run(g.with_graph(other), rules).select([("?n", "nationName", "?nation"), ("?n", "regionOf", "?region")], "nation", "region")


# Functions

STRINGS = """SELECT DISTINCT p_partkey AS p, 'part ' || p_name AS joined, CAST(length(p_name) AS INTEGER) AS n, substr(p_name, 2, 3) AS part,
    regexp_replace(p_name, '[aeiou]', '*', 'g') AS replaced, upper(p_name) AS up, lower(p_brand) AS low,
    replace(replace(p_brand, '#', '%23'), ' ', '%20') AS encoded, contains(p_name, 'a') AS has, starts_with(p_brand, 'Brand') AS starts, ends_with(p_brand, '1') AS ends,
    CASE WHEN strpos(p_brand, '#') > 0 THEN split_part(p_brand, '#', 1) ELSE '' END AS before, CASE WHEN strpos(p_brand, '#') > 0 THEN split_part(p_brand, '#', 2) ELSE '' END AS after FROM part"""


@query(STRINGS, "part")
def string_functions(g: Graph) -> DataFrame:
    body = [
        ("?p", "partName", "?name"), ("?p", "brand", "?b"),
        Set("joined", lambda v: B.concat(F.lit("part "), v.name)), Set("n", lambda v: B.strlen(v.name)), Set("part", lambda v: B.substr(v.name, F.lit(2), F.lit(3))),
        Set("replaced", lambda v: B.replace(v.name, "[aeiou]", "*")), Set("up", lambda v: F.upper(v.name)), Set("low", lambda v: F.lower(v.b)),
        Set("encoded", lambda v: B.encode_for_uri(v.b)), Set("has", lambda v: v.name.contains("a")), Set("starts", lambda v: v.b.startswith("Brand")), Set("ends", lambda v: v.b.endswith("1")),
        Set("before", lambda v: B.before(v.b, F.lit("#"))), Set("after", lambda v: B.after(v.b, F.lit("#"))),
    ]
    return select(body, g, "p", "joined", "n", "part", "replaced", "up", "low", "encoded", "has", "starts", "ends", "before", "after")


@query("SELECT DISTINCT c_custkey AS c, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS DOUBLE) AS up, CAST(floor(c_acctbal) AS DOUBLE) AS down, floor(c_acctbal + 0.5) AS near, -c_acctbal AS neg, c_acctbal / 2 AS half FROM customer", "customer")
def number_functions(g: Graph) -> DataFrame:
    body = [
        ("?c", "balance", "?b"), Set("a", lambda v: B.absolute(v.b)), Set("up", lambda v: B.ceil(v.b)), Set("down", lambda v: B.floor(v.b)),
        Set("near", lambda v: B.round_half_up(v.b)), Set("neg", lambda v: -v.b), Set("half", lambda v: B.divide(v.b, F.lit(2))),
    ]
    return select(body, g, "c", "a", "up", "down", "near", "neg", "half")


DATES = """SELECT DISTINCT o_orderkey AS o, CAST(year(o_orderdate) AS DOUBLE) AS y, CAST(month(o_orderdate) AS DOUBLE) AS m, CAST(day(o_orderdate) AS DOUBLE) AS d,
    CAST(hour(o_orderdate) AS DOUBLE) AS h, CAST(minute(o_orderdate) AS DOUBLE) AS mi, CAST(second(o_orderdate) AS DOUBLE) AS s, '+02:30' AS zone, 'PT2H30M' AS duration FROM orders"""


@query(DATES, "orders")
def date_functions(g: Graph) -> DataFrame:
    """Fields of the lexical form, in the time's own zone."""
    parts = {"y": B.year, "m": B.month, "d": B.day, "h": B.hours, "mi": B.minutes, "s": B.seconds, "zone": B.tz, "duration": B.timezone}
    text = Set("text", lambda v: F.concat(F.date_format(v.at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:30")))
    body = [("?o", "orderDate", "?at"), text, *(Set(k, lambda v, f=f: f(v.text)) for k, f in parts.items())]
    return select(body, g, "o", *parts)


TERMS = """SELECT DISTINCT doc_id AS d, lang AS tag, 'hello' AS text, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' AS type, lang = 'en' AS english, true AS lit, false AS num, false AS isiri, false AS isblank FROM documents"""


@query(TERMS, "documents")
def term_functions(g: Graph) -> DataFrame:
    term = Set("t", lambda v: F.concat(F.lit('"hello"@'), v.lang))
    fields = {
        "tag": lambda v: terms.lang(v.t), "text": lambda v: terms.string(v.t), "type": lambda v: terms.datatype(v.t), "english": lambda v: B.lang_matches(terms.lang(v.t), F.lit("EN")),
        "lit": lambda v: terms.is_literal(v.t), "num": lambda v: terms.is_numeric(v.t), "isiri": lambda v: terms.is_iri(v.t), "isblank": lambda v: terms.is_blank(v.t),
    }
    return select([("?d", "language", "?lang"), term, *(Set(k, f) for k, f in fields.items())], g, "d", *fields)


@query("SELECT DISTINCT n_nationkey AS n, '<nation/' || n_nationkey || '>' AS s, '<inRegion>' AS p, '<region/' || n_regionkey || '>' AS o, true AS is_triple FROM nation", "nation")
def triple_term(g: Graph) -> DataFrame:
    """A triple term built from parts and taken apart again."""
    iri = lambda entity, c: F.concat(F.lit(f"<{entity}/"), c.cast("string"), F.lit(">"))
    body = [
        ("?n", "inRegion", "?r"), Set("t", lambda v: terms.triple(iri("nation", v.n), F.lit("<inRegion>"), iri("region", v.r))),
        Set("s", lambda v: terms.part(v.t, 0)), Set("p", lambda v: terms.part(v.t, 1)), Set("o", lambda v: terms.part(v.t, 2)), Set("is_triple", lambda v: terms.is_triple(v.t)),
    ]
    return select(body, g, "n", "s", "p", "o", "is_triple")


@query("SELECT '<r1>' AS r, '<alice>' AS who, '<bob>' AS whom, '\"2026-01-01\"' AS seen")
def annotation(g: Graph) -> DataFrame:
    g = g.with_facts(annotated("<r1>", "<alice>", "knows", "<bob>", recorded="2026-01-01"))
    body = [("?r", terms.REIFIES, "?t"), ("?r", "recorded", "?seen"), Set("who", lambda v: terms.part(v.t, 0), term=True), Set("whom", lambda v: terms.part(v.t, 2), term=True), ("?who", "knows", "?whom")]
    return select(body, g, "r", "who", "whom", "seen")


@query("SELECT * FROM (VALUES ('\"b\"')) t(second)")
def collection_list(g: Graph) -> DataFrame:
    g = g.with_facts([("<x>", "members", "<list>"), *list_facts("<list>", ["a", "b", "c"])])
    return select([Path("<x>", ("members", terms.REST, terms.FIRST), "?second")], g)


MALFORMED = """SELECT DISTINCT o_orderkey AS o, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS q, CAST(NULL AS VARCHAR) AS cut, CAST(NULL AS BOOLEAN) AS bad,
    replace(o_orderpriority, '-', '$9') AS marked, CAST(NULL AS DOUBLE) AS y, CAST(year(o_orderdate) AS DOUBLE) AS y2, CAST(0 AS DOUBLE) AS h, '' AS none, '+0230' AS zone, 'PT2H30M' AS duration FROM orders"""


@query(MALFORMED, "orders")
def malformed_values(g: Graph) -> DataFrame:
    """What is no number, expression or date gives null, not an error; dates may go on, zones lack a colon."""
    rows = select([("?o", "priority", "?p"), ("?o", "orderDate", "?at")], g, "o", "p", "at")
    date, p = F.date_format("at", "yyyy-MM-dd"), F.col("p")
    time = F.concat(date, F.lit("T10:00:00+0230"))
    return rows.select(
        "o", B.absolute(p).alias("a"), B.divide(p, F.lit(2)).alias("q"), B.substr(p, p).alias("cut"), B.regex(p, "(").alias("bad"), B.replace(p, "-", "$9").alias("marked"), B.year(p).alias("y"),
        B.year(F.concat(date, F.lit(" and more"))).alias("y2"), B.hours(date).alias("h"), B.tz(F.concat(date, F.lit("Z"))).alias("none"), B.tz(time).alias("zone"), B.timezone(time).alias("duration"),
    )


MADE = """SELECT DISTINCT doc_id AS d, '"' || source || '"@' || lang AS tagged, '"' || source || '"@' || lang || '--ltr' AS directed, '"' || n_chars || '"^^<http://www.w3.org/2001/XMLSchema#long>' AS typed,
    '_:' || source AS node, true AS tag, true AS dir, false AS untagged, lang = 'en' AS same, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS size FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL"""


@query(MADE, "documents")
def made_terms(g: Graph) -> DataFrame:
    """Literals with a language, a direction or a datatype, and blank nodes, made from values."""
    fields = {
        "tagged": lambda v: terms.str_lang(v.source, v.lang), "directed": lambda v: terms.str_lang_dir(v.source, v.lang, F.lit("LTR")), "typed": lambda v: terms.str_datatype(v.n.cast("string"), F.lit(f"<{terms.XSD}long>")),
        "node": lambda v: terms.blank_node(v.source), "tag": lambda v: terms.has_lang(terms.str_lang(v.source, v.lang)), "dir": lambda v: terms.has_lang_dir(terms.str_lang_dir(v.source, v.lang, F.lit("rtl"))),
        "untagged": lambda v: terms.has_lang_dir(terms.str_lang(v.source, v.lang)), "same": lambda v: terms.same_term(terms.str_lang(v.source, v.lang), terms.str_lang(v.source, F.lit("EN"))),
        "size": lambda v: B.if_(v.n > 1000, "boolean", F.lit("long"), F.lit("short")),
    }
    return select([("?d", "language", "?lang"), ("?d", "source", "?source"), ("?d", "characters", "?n"), *(Set(k, f) for k, f in fields.items())], g, "d", *fields)


@query("SELECT DISTINCT p_partkey AS p, reverse(p_name) AS back FROM part", "part")
def custom_function(g: Graph) -> DataFrame:
    return select([("?p", "partName", "?n"), Set("back", lambda v: F.reverse(v.n))], g, "p", "back")


PUZZLE = "530070000600195000098000060800060003400803001700020006060000280000419005000080079"


@query("SELECT '534678912672195348198342567859761423426853791713924856961537284287419635345286179' AS solution")
def sudoku_function(g: Graph) -> DataFrame:
    g = g.with_view("puzzle", View(g.spark.createDataFrame([(1, PUZZLE)], "s int, o string"), None, None))
    return select([("?x", "puzzle", "?p"), Set("solution", lambda v: sudoku(v.p))], g, "solution")


@query("SELECT '2026-05-15T12:34:56.000Z' AS at, '00000000-0000-4000-8000-000000000001' AS id, 'urn:uuid:00000000-0000-4000-8000-000000000001' AS iri, 'http://example/base/local' AS resolved")
def clock_and_ids(g: Graph) -> DataFrame:
    body = [
        Set("at", lambda v: B.now(datetime(2026, 5, 15, 12, 34, 56, tzinfo=UTC))), Set("id", lambda v: B.uuid_text(F.lit(1)), volatile=True), Set("iri", lambda v: B.uuid_iri(F.lit(1)), volatile=True),
        Set("resolved", lambda v: B.resolve(F.lit("local"), "http://example/base/")),
    ]
    return select(body, g, "at", "id", "iri", "resolved")


FLAGSHIP = "rule_then_query"
