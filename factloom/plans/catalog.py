"""The registered queries over the driver's tables, and the same in SQL.

Tables are lifted: a row is an entity, a column an attribute. History for the temporal queries is made from orders by
fixed arithmetic, the same on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.functions.basis import Basis
from factloom.plans.page import condition, decoded, keyset, wrapped
from factloom.sources.facts import CHANGES, FactBase, JournalFacts, StoredFacts, lift, millis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lifted(spark: SparkSession, sf_dir: str, *names: str) -> FactBase:
    t = lambda n: table(spark, sf_dir, n)
    # The keys of lineitem repeat; these columns together don't.
    line = lambda: F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", millis(t("lineitem"), "l_shipdate"), "l_quantity", "l_extendedprice")
    known = {
        "region": lambda: lift(t("region"), "region", F.col("r_regionkey"), name="r_name:string"),
        "nation": lambda: lift(t("nation"), "nation", F.col("n_nationkey"), name="n_name:string", region="n_regionkey:ref:region"),
        "customer": lambda: lift(t("customer"), "customer", F.col("c_custkey"), name="c_name:string", nation="c_nationkey:ref:nation", balance="c_acctbal:number", segment="c_mktsegment:string"),
        "supplier": lambda: lift(t("supplier"), "supplier", F.col("s_suppkey"), name="s_name:string", nation="s_nationkey:ref:nation", balance="s_acctbal:number"),
        "part": lambda: lift(t("part"), "part", F.col("p_partkey"), name="p_name:string", brand="p_brand:string", type="p_type:string", size="p_size:number", price="p_retailprice:number"),
        "orders": lambda: lift(t("orders"), "order", F.col("o_orderkey"), customer="o_custkey:ref:customer", status="o_orderstatus:string", total="o_totalprice:number", date="o_orderdate:datetime", priority="o_orderpriority:string"),
        "lineitem": lambda: lift(t("lineitem"), "line", line(), order="l_orderkey:ref:order", part="l_partkey:ref:part", supplier="l_suppkey:ref:supplier", quantity="l_quantity:number", price="l_extendedprice:number", discount="l_discount:number", flag="l_returnflag:string", status="l_linestatus:string", shipped="l_shipdate:datetime"),
        "events": lambda: lift(t("events"), "event", F.col("event_id"), at="ts:datetime", user="user_id:ref:user", type="event_type:string", value="value:number", props="props:string"),
    }
    return FactBase(spark, [known[n]() for n in names])


def register(name: str, tables: str, query: dict, sql: str, decode: dict | None = None, basis: Basis | None = None, digits: dict[str, int] | None = None) -> None:
    """``digits``: sums of doubles are rounded, as their order differs between engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = lifted(spark, sf_dir, *tables.split()).query(query, basis, decode)
        return out.withColumns({c: F.round(c, n) for c, n in (digits or {}).items()})

    run.__name__ = name
    QUERIES[name], SQL[name] = run, sql


def register_wrapped(name: str, tables: str, query: dict, sql: str, count: bool = False, decode: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rel, _ = wrapped(lifted(spark, sf_dir, *tables.split()), query, Basis())
        out = decoded(rel, decode)
        return out.agg(F.count("*").alias("total")) if count else out

    run.__name__ = name
    QUERIES[name], SQL[name] = run, sql


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Scans and projection.

register("scan_attribute", "customer", {"find": ["?c", "?b"], "where": [["?c", ":customer/balance", "?b"]]}, "SELECT DISTINCT 'customer:' || c_custkey AS c, c_acctbal AS b FROM customer WHERE c_acctbal IS NOT NULL")
register(
    "scan_entity", "customer", {"find": ["?a", "?v"], "where": [["customer:7", "?a", "?v"]]},
    """SELECT ':customer/name' AS a, c_name AS v FROM customer WHERE c_custkey = 7 UNION ALL SELECT ':customer/nation', 'nation:' || c_nationkey FROM customer WHERE c_custkey = 7
    UNION ALL SELECT ':customer/segment', c_mktsegment FROM customer WHERE c_custkey = 7 UNION ALL SELECT ':customer/balance', NULL FROM customer WHERE c_custkey = 7""",
    {"v": "string"},
)
register("match_typed", "customer", {"find": ["?c"], "where": [["?c", ":customer/nation", {"type": "ref", "value": "nation:3"}]]}, "SELECT 'customer:' || c_custkey AS c FROM customer WHERE c_nationkey = 3")
register("match_bare", "orders", {"find": ["?o", "?t"], "where": [["?o", ":order/status", "F"], ["?o", ":order/total", "?t"]]}, "SELECT 'order:' || o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_orderstatus = 'F'")
register("find_distinct", "customer", {"find": ["?s"], "where": [["?c", ":customer/segment", "?s"]]}, "SELECT DISTINCT c_mktsegment AS s FROM customer")
register("const_projection", "customer", {"find": ["customer", "?s"], "where": [["?c", ":customer/segment", "?s"]]}, "SELECT DISTINCT 'customer' AS customer, c_mktsegment AS s FROM customer")
register("const_only", "customer", {"find": ["yes"], "where": [["?c", ":customer/segment", "BUILDING"]]}, "SELECT DISTINCT 'yes' AS yes FROM customer WHERE c_mktsegment = 'BUILDING'")
register("variable_attribute", "nation region", {"find": ["?a", "?n"], "where": [["?e", "?a", "?v"]], "aggregate": [["count", "?e", "?n"]]}, "SELECT ':nation/name' AS a, count(*) AS n FROM nation UNION ALL SELECT ':nation/region', count(*) FROM nation UNION ALL SELECT ':region/name', count(*) FROM region")

# Predicates.

register("pred_eq", "customer", {"find": ["?c"], "where": [["?c", ":customer/segment", "?s"], ["=", "?s", "BUILDING"]]}, "SELECT 'customer:' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
register("pred_ne_cross_family", "part", {"find": ["?p"], "where": [["?p", ":part/size", "?s"], ["!=", "?s", "7"]]}, "SELECT 'part:' || p_partkey AS p FROM part")
register("pred_range", "orders", {"find": ["?o", "?t"], "where": [["?o", ":order/total", "?t"], [">=", "?t", 1000], ["<", "?t", 50000]]}, "SELECT 'order:' || o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000")
register("pred_text_ordered", "customer", {"find": ["?c"], "where": [["?c", ":customer/segment", "?s"], ["or", [[">", "?s", 0], ["=", "?s", "BUILDING"]]]]}, "SELECT 'customer:' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
register("pred_const", "region", {"find": ["?r"], "where": [["?r", ":region/name", "?n"], ["!=", 1, "1"], ["<", 1, 2]]}, "SELECT 'region:' || r_regionkey AS r FROM region")

# Joins.

_TWO_HOP = {"find": ["?c", "?name", "?o", "?t"], "where": [["?o", ":order/customer", "?c"], ["?o", ":order/total", "?t"], ["?c", ":customer/segment", "BUILDING"], ["?c", ":customer/name", "?name"], [">=", "?t", 100000]]}
register("join_two_hop", "orders customer", _TWO_HOP, "SELECT 'customer:' || c_custkey AS c, c_name AS name, 'order:' || o_orderkey AS o, o_totalprice AS t FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice >= 100000")
register(
    "join_many_hops", "orders customer nation region", {"find": ["?rn", "?n"], "where": [["?o", ":order/customer", "?c"], ["?c", ":customer/nation", "?na"], ["?na", ":nation/region", "?r"], ["?r", ":region/name", "?rn"]], "aggregate": [["count", "?o", "?n"]]},
    "SELECT r_name AS rn, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
register("join_value_value", "customer supplier", {"find": ["?c", "?s"], "where": [["?c", ":customer/nation", "?n"], ["?s", ":supplier/nation", "?n"]]}, "SELECT 'customer:' || c_custkey AS c, 'supplier:' || s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey")
register("join_self", "nation", {"find": ["?a", "?b"], "where": [["?a", ":nation/region", "?r"], ["?b", ":nation/region", "?r"], ["!=", "?a", "?b"]]}, "SELECT 'nation:' || a.n_nationkey AS a, 'nation:' || b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
register("theta_join", "customer supplier", {"find": ["?c", "?s"], "where": [["?c", ":customer/nation", "?n"], ["?s", ":supplier/nation", "?n"], ["?c", ":customer/balance", "?a"], ["?s", ":supplier/balance", "?b"], ["<", "?a", "?b"]]}, "SELECT 'customer:' || c_custkey AS c, 'supplier:' || s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal")
register("cross_product", "region nation", {"find": ["?a", "?b"], "where": [["?a", ":region/name", "?x"], ["?b", ":nation/name", "?y"]]}, "SELECT 'region:' || r_regionkey AS a, 'nation:' || n_nationkey AS b FROM region, nation")
register(
    "star_lineitem", "lineitem", {"find": ["?f", "?s", "?q", "?p", "?d", "?n"], "where": [["?l", ":line/flag", "?f"], ["?l", ":line/status", "?s"], ["?l", ":line/quantity", "?x"], ["?l", ":line/price", "?y"], ["?l", ":line/discount", "?z"], ["?l", ":line/shipped", "?t"], ["<=", "?t", 904694400000]], "aggregate": [["sum", "?x", "?q"], ["sum", "?y", "?p"], ["avg", "?z", "?d"], ["count", "?l", "?n"]]},
    "SELECT l_returnflag AS f, l_linestatus AS s, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice), 2) AS p, round(avg(l_discount), 6) AS d, count(*) AS n FROM lineitem WHERE epoch_ms(l_shipdate) <= 904694400000 GROUP BY ALL",
    digits={"q": 2, "p": 2, "d": 6},
)
register(
    "optional_projection", "orders customer", {"find": ["?o", "?seg"], "where": [["?o", ":order/status", "P"], ["?o", ":order/customer", "?c"]], "optionalProjection": {"rowBinding": "?c", "fields": [{"attribute": ":customer/segment", "variable": "?seg"}]}},
    "SELECT 'order:' || o_orderkey AS o, c_mktsegment AS seg FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'",
)

# Negation and disjunction.

register(
    "not_conjunctive", "customer orders", {"find": ["?c"], "where": [["?c", ":customer/name", "?n"], ["not", ["?o", ":order/customer", "?c"], ["?o", ":order/status", "P"], ["?o", ":order/total", "?t"], [">", "?t", 50000]]]},
    "SELECT 'customer:' || c_custkey AS c FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus = 'P' AND o_totalprice > 50000)",
)
register(
    "not_with_outer_predicate", "customer orders", {"find": ["?c"], "where": [["?c", ":customer/balance", "?b"], ["not", ["?o", ":order/customer", "?c"], ["?o", ":order/total", "?t"], ["<", "?t", "?b"]]]},
    "SELECT 'customer:' || c_custkey AS c FROM customer c WHERE c_acctbal IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice < c.c_acctbal)",
)
register("not_predicates", "part", {"find": ["?p"], "where": [["?p", ":part/size", "?s"], ["not", [">", "?s", 10], ["<", "?s", 40]]]}, "SELECT 'part:' || p_partkey AS p FROM part WHERE NOT (p_size > 10 AND p_size < 40)")
register("or_predicates", "part", {"find": ["?p", "?s"], "where": [["?p", ":part/size", "?s"], ["or", [["<", "?s", 5], ["=", "?s", 20], [">", "?s", 45]]]]}, "SELECT 'part:' || p_partkey AS p, p_size::DOUBLE AS s FROM part WHERE p_size < 5 OR p_size = 20 OR p_size > 45")
register(
    "or_pattern", "customer orders", {"find": ["?c"], "where": [["?c", ":customer/segment", "?s"], ["or", [["=", "?s", "MACHINERY"], ["?o", ":order/customer", "?c"]]]]},
    "SELECT 'customer:' || c_custkey AS c FROM customer WHERE c_mktsegment = 'MACHINERY' OR c_custkey IN (SELECT o_custkey FROM orders)",
)
register(
    "or_not", "customer orders", {"find": ["?c"], "where": [["?c", ":customer/segment", "?s"], ["or", [["=", "?s", "MACHINERY"], ["not", ["?o", ":order/customer", "?c"], ["?o", ":order/status", "F"]]]]]},
    "SELECT 'customer:' || c_custkey AS c FROM customer c WHERE c_mktsegment = 'MACHINERY' OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus = 'F')",
)

# Rules.

_CHAIN = [{"name": "within", "body": [["?x", ":customer/nation", "?n"], ["?n", ":nation/region", "?y"]]}]
register("rule_nonrecursive", "customer nation", {"find": ["?c", "?r"], "where": [["within", "?c", "?r"]], "rules": _CHAIN}, "SELECT 'customer:' || c_custkey AS c, 'region:' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey")
_NEXT = "SELECT 'customer:' || c_custkey AS a, 'customer:' || (CASE WHEN c_custkey % 50 = 0 THEN c_custkey - 49 ELSE c_custkey + 1 + c_custkey % 3 END) AS b FROM customer"


def _rings(spark: SparkSession, sf_dir: str) -> FactBase:
    """Customers point onward in steps of 1 to 3, and back by 49 at every fiftieth: cycles and merging paths."""
    t = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    t = t.withColumn("next", F.when(k % 50 == 0, k - 49).otherwise(k + 1 + k % 3))
    return FactBase(spark, [lift(t, "customer", k, next="next:ref:customer")])


_REACH = [{"name": "reach", "maxDepth": 20, "body": [["?x", ":customer/next", "?y"]]}, {"name": "reach", "maxDepth": 20, "body": [["?x", ":customer/next", "?z"], ["reach", "?z", "?y"]]}]
_CLOSURE = f"WITH RECURSIVE e AS ({_NEXT}), r(a, b, d) AS (SELECT a, b, 0 FROM e{{seed}} UNION SELECT r.a, e.b, r.d + 1 FROM r JOIN e ON r.b = e.a WHERE r.d < 20) SELECT DISTINCT a AS x, b AS y FROM r"


@query(f"WITH e AS ({_NEXT}) SELECT a AS c FROM e WHERE a NOT IN (SELECT b FROM e)")
def not_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that none points to."""
    return _rings(spark, sf_dir).query({"find": ["?c"], "where": [["?c", ":customer/next", "?n"], ["not", ["?x", ":customer/next", "?c"]]]})


@query(_CLOSURE.format(seed=""))
def rule_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(spark, sf_dir).query({"find": ["?x", "?y"], "where": [["reach", "?x", "?y"]], "rules": _REACH})


@query(f"SELECT y FROM ({_CLOSURE.format(seed=' WHERE a = ' + chr(39) + 'customer:1' + chr(39))})")
def rule_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(spark, sf_dir).query({"find": ["?y"], "where": [["reach", "customer:1", "?y"]], "rules": _REACH})


@query(f"SELECT x, y FROM ({_CLOSURE.format(seed=' WHERE a IN (SELECT ' + chr(39) + 'customer:' + chr(39) + ' || c_custkey FROM customer WHERE c_custkey % 100 = 1)')})")
def rule_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every hundredth customer only."""
    few = lift(table(spark, sf_dir, "customer").where("c_custkey % 100 = 1"), "few", F.col("c_custkey"), of="c_custkey:ref:customer")
    base = _rings(spark, sf_dir)
    return FactBase(spark, [*base.sources, few]).query({"find": ["?x", "?y"], "where": [["?f", ":few/of", "?x"], ["reach", "?x", "?y"]], "rules": _REACH})


@query(f"SELECT x FROM ({_CLOSURE.format(seed='')}) WHERE y = 'customer:40'")
def rule_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(spark, sf_dir).query({"find": ["?x"], "where": [["reach", "?x", "customer:40"]], "rules": _REACH})


# Aggregates.

register("agg_count_distinct", "orders", {"find": ["?s", "?n"], "where": [["?o", ":order/status", "?s"], ["?o", ":order/customer", "?c"]], "aggregate": [["count", "?c", "?n"]]}, "SELECT o_orderstatus AS s, count(DISTINCT o_custkey) AS n FROM orders GROUP BY ALL")
register(
    "agg_sum_avg_min_max", "customer", {"find": ["?s", "?a", "?b", "?c", "?d"], "where": [["?k", ":customer/segment", "?s"], ["?k", ":customer/balance", "?x"]], "aggregate": [["sum", "?x", "?a"], ["avg", "?x", "?b"], ["min", "?x", "?c"], ["max", "?x", "?d"]]},
    "SELECT c_mktsegment AS s, round(sum(c_acctbal), 2) AS a, round(avg(c_acctbal), 6) AS b, min(c_acctbal) AS c, max(c_acctbal) AS d FROM customer GROUP BY ALL",
    digits={"a": 2, "b": 6},
)
register("agg_empty", "customer", {"find": ["?n", "?x"], "where": [["?k", ":customer/segment", "none"], ["?k", ":customer/balance", "?b"]], "aggregate": [["count", "?k", "?n"], ["sum", "?b", "?x"]]}, "SELECT count(*) AS n, sum(c_acctbal) AS x FROM customer WHERE false")
register("agg_nonnumeric", "customer", {"find": ["?n", "?x"], "where": [["?k", ":customer/segment", "?s"]], "aggregate": [["count", "?k", "?n"], ["sum", "?s", "?x"]]}, "SELECT count(*) AS n, NULL::DOUBLE AS x FROM customer")
register("having_agg", "orders", {"find": ["?c", "?n"], "where": [["?o", ":order/customer", "?c"]], "aggregate": [["count", "?o", "?n"]], "having": [[">=", "?n", 20]]}, "SELECT 'customer:' || o_custkey AS c, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 20")
register("having_group_eq", "customer", {"find": ["?s", "?n"], "where": [["?k", ":customer/segment", "?s"]], "aggregate": [["count", "?k", "?n"]], "having": [["=", "?s", "BUILDING"]]}, "SELECT c_mktsegment AS s, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY ALL")

# Order, slices, wrappers, pages.

register("topk", "orders", {"find": ["?o", "?t"], "where": [["?o", ":order/total", "?t"]], "orderBy": [{"variable": "?t", "direction": "desc"}], "limit": 25}, "SELECT 'order:' || o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY t DESC, o LIMIT 25")
register("offset_limit", "orders", {"find": ["?o", "?t"], "where": [["?o", ":order/total", "?t"]], "orderBy": [{"variable": "?t"}], "limit": 25, "offset": 100}, "SELECT 'order:' || o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY t, o LIMIT 25 OFFSET 100")
register(
    "order_mixed", "customer", {"find": ["?c", "?v"], "where": [["?c", "?a", "?v"]], "orderBy": [{"variable": "?v", "direction": "desc"}], "limit": 40},
    "SELECT 'customer:' || c_custkey AS c, c_acctbal AS v FROM customer ORDER BY v DESC, c LIMIT 40", {"v": "double"},
)
_NAMES = {"find": ["?p", "?n"], "where": [["?p", ":part/name", "?n"]]}
_PART = "SELECT 'part:' || p_partkey AS p, p_name AS n FROM part"
register_wrapped("wrap_like", "part", {"inner": _NAMES, "filters": [{"column": "?n", "op": "like", "value": "s%_g"}]}, f"{_PART} WHERE p_name LIKE 's%_g'")
register_wrapped("wrap_ilike", "part", {"inner": _NAMES, "filters": [{"column": "?n", "op": "ilike", "value": "S%RING"}]}, f"{_PART} WHERE p_name ILIKE 'S%RING'")
register_wrapped("wrap_not_like", "part", {"inner": _NAMES, "filters": [{"column": "?n", "op": "not-like", "value": "%red%"}]}, f"{_PART} WHERE p_name NOT LIKE '%red%'")
register_wrapped("wrap_not_ilike", "part", {"inner": _NAMES, "filters": [{"column": "?n", "op": "not-ilike", "value": "%A%"}]}, f"{_PART} WHERE p_name NOT ILIKE '%A%'")
register_wrapped("wrap_compare", "part", {"inner": _NAMES, "filters": [{"column": "?n", "op": ">=", "value": "m"}, {"column": "?n", "op": "!=", "value": "small ring"}]}, f"{_PART} WHERE p_name >= 'm' AND p_name <> 'small ring'")
register_wrapped("wrap_compare_families", "part", {"inner": {"find": ["?p", "?v"], "where": [["?p", "?a", "?v"]]}, "filters": [{"column": "?v", "op": "!=", "value": 7}, {"column": "?v", "op": "<", "value": 20}]}, "SELECT 'part:' || p_partkey AS p, p_size::DOUBLE AS v FROM part WHERE p_size <> 7 AND p_size < 20 UNION SELECT 'part:' || p_partkey, p_retailprice FROM part WHERE p_retailprice <> 7 AND p_retailprice < 20", decode={"v": "double"})
register_wrapped("wrap_count", "part", {"inner": _NAMES, "filters": [{"column": "?n", "op": "like", "value": "s%_g"}]}, "SELECT count(*) AS total FROM part WHERE p_name LIKE 's%_g'", count=True)


def _vip(op: str):
    """Orders with a mark of their customer that only rich ones have."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = table(spark, sf_dir, "customer").withColumn("vip", F.when(F.col("c_acctbal") > 5000, F.lit("yes")))
        base = FactBase(spark, [*lifted(spark, sf_dir, "orders").sources, lift(c, "customer", F.col("c_custkey"), vip="vip:string")])
        inner = {"find": ["?o", "?vip"], "where": [["?o", ":order/total", "?t"], ["?o", ":order/customer", "?c"], [">", "?t", 200000]], "optionalProjection": {"rowBinding": "?c", "fields": [{"attribute": ":customer/vip", "variable": "?vip"}]}}
        return decoded(wrapped(base, {"inner": inner, "filters": [{"column": "?vip", "op": op}]}, Basis())[0])

    return run


_RICH = "SELECT 'order:' || o_orderkey AS o, CASE WHEN c_acctbal > 5000 THEN 'yes' END AS vip FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 AND "
QUERIES["wrap_is_null"], SQL["wrap_is_null"] = _vip("is-null"), _RICH + "NOT coalesce(c_acctbal > 5000, false)"
QUERIES["wrap_is_not_null"], SQL["wrap_is_not_null"] = _vip("is-not-null"), _RICH + "c_acctbal > 5000"


@query("SELECT 'order:' || o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_totalprice < 90000 OR o_totalprice = 90000 AND 'order:' || o_orderkey > 'order:5' ORDER BY t DESC, o LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = {"find": ["?o", "?t"], "where": [["?o", ":order/total", "?t"]]}
    return keyset(lifted(spark, sf_dir, "orders"), {"inner": inner, "orderBy": [{"variable": "?t", "direction": "desc"}], "limit": 50}, [90000, "order:5"])


# Time. Order k is recorded at position k % 97 + 1; every seventh is retracted 40 positions on. Status facts hold for 30 days
# from the order's date, those of every third order for ever.

_DAY = 86_400_000


def history(spark: SparkSession, sf_dir: str) -> FactBase:
    o = table(spark, sf_dir, "orders")
    k, at = F.col("o_orderkey"), millis(o, "o_orderdate")
    position = k % 97 + 1
    gone = F.when(k % 7 == 0, position + 40)
    none = F.lit(None).cast("string")
    moment = lambda p: p * 1000
    facts = o.select(
        F.concat(F.lit("fact:"), k.cast("string")).alias("id"), F.concat(F.lit("order:"), k.cast("string")).alias("entity"), F.lit(":order/status").alias("attribute"), F.lit("order").alias("entity_type"), F.lit("string").alias("vtype"),
        V.struct(F.col("o_orderstatus"), V.TEXT).alias("v"), none.alias("blind"), at.alias("valid_from"), F.when(k % 3 != 0, at + 30 * _DAY).alias("valid_to"), moment(position).alias("recorded_at"), position.alias("recorded_position"),
        moment(gone).alias("retracted_at"), gone.alias("retracted_position"), F.concat(F.lit("tx:"), position.cast("string")).alias("tx_id"),
    )
    tx = spark.range(1, 138).select(F.concat(F.lit("tx:"), F.col("id").cast("string")).alias("tx_id"), F.col("id").alias("position"), moment(F.col("id")).alias("instant"), F.concat(F.lit("user:"), (F.col("id") % 5).cast("string")).alias("actor"), none.alias("command_id"), none.alias("correlation_id"), none.alias("causation_id"), none.alias("config_snapshot"))
    changes = facts.select(F.col("recorded_position").alias("position"), F.lit(0).alias("ord"), F.col("id").alias("triple_id"), F.lit("assert").alias("op"), "entity", "attribute")
    changes = changes.unionByName(facts.where("retracted_position IS NOT NULL").select(F.col("retracted_position").alias("position"), F.lit(1).alias("ord"), F.col("id").alias("triple_id"), F.lit("retract").alias("op"), "entity", "attribute"))
    return FactBase(spark, [StoredFacts(facts), JournalFacts(tx, changes.select(*CHANGES.names))])


_HISTORY = f"""WITH f AS (SELECT 'order:' || o_orderkey AS e, o_orderstatus AS s, epoch_ms(o_orderdate) AS vf, CASE WHEN o_orderkey % 3 <> 0 THEN epoch_ms(o_orderdate) + {30 * _DAY} END AS vt,
o_orderkey % 97 + 1 AS p, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 97 + 41 END AS g FROM orders) """
_MID = 830_000_000_000


def _temporal(name: str, q: dict, basis: Basis, sql: str, decode: dict | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return history(spark, sf_dir).query(q, basis, decode)

    run.__name__ = name
    QUERIES[name], SQL[name] = run, _HISTORY + sql


_STATUS = {"find": ["?e", "?s"], "where": [["?e", ":order/status", "?s"]]}
_temporal("as_of_position", {**_STATUS, "validTime": "all"}, Basis.of(position=60), "SELECT e, s FROM f WHERE p <= 60 AND (g IS NULL OR g > 60)", {"s": "string"})
_temporal("as_of_recorded", {**_STATUS, "validTime": "all"}, Basis.of(recorded_at=60_500), "SELECT e, s FROM f WHERE p * 1000 <= 60500 AND (g IS NULL OR g * 1000 > 60500)", {"s": "string"})
_temporal("as_of_valid", _STATUS, Basis.of(valid_at=_MID), f"SELECT e, s FROM f WHERE g IS NULL AND vf <= {_MID} AND (vt IS NULL OR vt > {_MID})", {"s": "string"})
_temporal("as_of_both", _STATUS, Basis.of(position=80, valid_at=_MID), f"SELECT e, s FROM f WHERE p <= 80 AND (g IS NULL OR g > 80) AND vf <= {_MID} AND (vt IS NULL OR vt > {_MID})", {"s": "string"})
_temporal("interval_bounds", {"find": ["?e", "?a", "?b"], "where": [{"pattern": ["?e", ":order/status", "?s"], "valid": {"from": "?a", "to": "?b"}}], "validTime": "all"}, Basis(), "SELECT e, vf::DOUBLE AS a, vt::DOUBLE AS b FROM f WHERE g IS NULL")
_temporal(
    "interval_expiring", {"find": ["?e", "?b"], "where": [{"pattern": ["?e", ":order/status", "?s"], "valid": {"to": "?b"}}, [">", "?b", _MID], ["<=", "?b", _MID + 10 * _DAY]]}, Basis.of(valid_at=_MID),
    f"SELECT e, vt::DOUBLE AS b FROM f WHERE g IS NULL AND vf <= {_MID} AND vt > {_MID} AND vt <= {_MID + 10 * _DAY}",
)
_temporal("interval_open", {"find": ["?e"], "where": [{"pattern": ["?e", ":order/status", "F"], "valid": {"to": None}}], "validTime": "all"}, Basis(), "SELECT e FROM f WHERE g IS NULL AND vt IS NULL AND s = 'F'")
_temporal("tx_metadata_join", {"find": ["?e", "?who"], "where": [["?e", ":order/status", "P", "?tx"], ["?tx", ":_tx/actor", "?who"]], "validTime": "all"}, Basis.of(position=50), "SELECT e, 'user:' || (p % 5) AS who FROM f WHERE p <= 50 AND (g IS NULL OR g > 50) AND s = 'P'")
_temporal("tx_range", {"find": ["?p", "?n"], "where": [["?tx", ":_tx/position", "?p"], ["?tx", ":_tx/changed-entity", "?e"], [">", "?p", 90]], "aggregate": [["count", "?e", "?n"]]}, Basis(), "SELECT p::DOUBLE AS p, count(DISTINCT e) AS n FROM (SELECT p, e FROM f UNION ALL SELECT g, e FROM f WHERE g IS NOT NULL) WHERE p > 90 GROUP BY p")
_temporal("not_over_time", {"find": ["?e"], "where": [["?e", ":order/status", "?s"], ["not", ["?tx", ":_tx/changed-entity", "?e"], ["?tx", ":_tx/position", "?p"], [">", "?p", 70]]], "validTime": "all"}, Basis(), "SELECT e FROM f WHERE g IS NULL AND p <= 70")


__all__ = ["QUERIES", "SQL", "Column", "Window", "condition", "history", "lifted", "table"]
