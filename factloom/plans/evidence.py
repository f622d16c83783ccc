"""Registered queries over stores, and the same in SQL: reads, journal, commits, constraints, derivations, rules of three
values, types, snapshots, sealed values and live queries.

A ledger holds all customers and orders of the driver's tables as stored facts, and a few further commits. It is built
once for each session and table folder. What has no rows in the tables (errors, receipts, reasons) is held against lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.functions.basis import Basis, visible
from factloom.functions.lineage import Folder
from factloom.operators import config as G
from factloom.operators import constraints as C
from factloom.operators import derive as D
from factloom.operators import kleene as K
from factloom.operators import runner as R
from factloom.operators import sealed as X
from factloom.operators import snapshots as N
from factloom.operators import store as S
from factloom.operators import types as T
from factloom.plans import ast as A
from factloom.plans import explain as E
from factloom.plans.catalog import lifted, table
from factloom.plans.errors import QueryError
from factloom.sources.facts import FactBase, lift, millis
from factloom.streaming.live import Reactor, Registry, Watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY, MID = 86_400_000, 830_000_000_000
_KINDS = {"string": "VARCHAR", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
CODEC = X.Codec("k1", lambda t: t[::-1], lambda t: t[::-1], b"ledger")
SEALING = X.Sealing(CODEC, {":customer/secret": "string"})


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def rows_of(schema: str, rows: list[tuple]) -> str:
    """SQL of a list of rows."""
    cols = [c.split() for c in schema.split(", ")]
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    values = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    names = [f'"{c}"' for c, _ in cols]
    return f"SELECT {', '.join(f'CAST({c} AS {_KINDS[t]}) AS {c}' for c, (_, t) in zip(names, cols, strict=True))} FROM (VALUES {values}) t({', '.join(names)})"


def listed(schema: str, rows: list[tuple]):
    """Register a function that returns rows of a list, to be held against the list here."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.createDataFrame(f(spark, sf_dir), schema)

        run.__name__ = f.__name__
        QUERIES[f.__name__], SQL[f.__name__] = run, rows_of(schema, rows)
        return f

    return add


def code_of(f: Callable) -> str:
    try:
        f()
    except QueryError as e:
        return e.code
    return "ok"


_LEDGERS: dict[tuple, S.Store] = {}


def facts_of(df: DataFrame, entity, kind: str, start, end, **columns) -> DataFrame:
    """Rows for Store.load(): each given column (value, stored type) as an attribute."""
    out = None
    for name, (value, vtype) in columns.items():
        family = V.FAMILY[vtype]
        one = df.where(value.isNotNull()).select(entity.alias("entity"), F.lit(f":{kind}/{name}").alias("attribute"), F.lit(kind).alias("entity_type"), F.lit(vtype).alias("vtype"), V.struct(value.cast(V.NATIVE[family]), family).alias("v"), start.cast("long").alias("valid_from"), end.cast("long").alias("valid_to"))
        out = one if out is None else out.unionByName(one)
    return out


def ledger(spark: SparkSession, sf_dir: str) -> S.Store:
    """All customers and orders at position 1, then commits 2 to 5, a second apart."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _LEDGERS:
        return _LEDGERS[key]
    now = [1000]
    s = S.Store(spark, Folder(spark, "ledger").root, clock=lambda: now[0])
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    name = lambda kind, k: F.concat(F.lit(f"{kind}:"), F.col(k).cast("string"))
    ever, none, at = F.lit(0), F.lit(None), millis(o, "o_orderdate")
    rows = facts_of(c, name("customer", "c_custkey"), "customer", ever, none, name=(F.col("c_name"), "string"), segment=(F.col("c_mktsegment"), "string"), balance=(F.col("c_acctbal"), "number"), nation=(name("nation", "c_nationkey"), "ref"))
    seen = o.select("o_custkey", "o_orderstatus").distinct()
    rows = rows.unionByName(facts_of(seen, name("customer", "o_custkey"), "customer", ever, none, seen=(F.col("o_orderstatus"), "string")))
    rows = rows.unionByName(facts_of(c.where("c_custkey % 5 = 0"), name("customer", "c_custkey"), "customer", ever, none, seen=(F.col("c_custkey"), "number")))
    end = F.when(F.col("o_orderkey") % 3 != 0, at + 30 * DAY)
    rows = rows.unionByName(facts_of(o, name("order", "o_orderkey"), "order", at, end, customer=(name("customer", "o_custkey"), "ref"), status=(F.col("o_orderstatus"), "string"), total=(F.col("o_totalprice"), "number")))
    # A sealed attribute: ciphertext and token of each segment.
    segments = sorted(r[0] for r in c.select("c_mktsegment").distinct().collect())  # five
    sealed = {x: SEALING.value(":customer/secret", x) for x in segments}
    pick = lambda part: F.element_at(F.create_map(*[F.lit(y) for x in segments for y in (x, part(sealed[x]))]), F.col("c_mktsegment"))
    secret = c.select(name("customer", "c_custkey").alias("entity"), F.lit(":customer/secret").alias("attribute"), F.lit("customer").alias("entity_type"), F.lit("sealed").alias("vtype"), V.literal(None).alias("v"), F.lit(0).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), pick(lambda z: V.canonical_json({k: z[k] for k in ("valueType", "keyId", "ciphertext")})).alias("sealed"), pick(lambda z: z["blind"]).alias("blind"))
    s.load(rows.unionByName(secret, allowMissingColumns=True), actor="user:a")
    say = lambda e, a, v: {"op": "assert", "entity": e, "attribute": a, "value": v, "validFrom": 0, "entityType": "customer"}
    now[0] = 2000
    r = s.transact([say("customer:1", ":customer/note", "first"), say("customer:2", ":customer/note", "second"), say("customer:2", ":customer/note", "also")], actor="user:b", command_id="c2")
    now[0] = 3000
    s.transact([{"op": "retract", "id": r.ids[1]}], actor="user:c", command_id="c3", causation_id="c2")
    now[0] = 4000
    s.transact([{"op": "retract-pattern", "pattern": {"entity": "customer:3", "attribute": ":customer/balance"}}, say("customer:3", ":customer/balance", 5)], actor="user:d", command_id="c4", causation_id="c3")
    now[0] = 5000
    s.transact([*[{"op": "append-entry", "scope": "mail", "key": k, "payload": {"to": k}} for k in ("x", "y", "x", "z")], {"op": "acknowledge-entry", "scope": "mail", "key": "y"}], actor="user:e")
    _LEDGERS[key] = s
    return s


def small(spark: SparkSession, now: list[int] | None = None, **more) -> S.Store:
    clock = now or [1000]
    return S.Store(spark, Folder(spark, "small").root, clock=lambda: clock[0], **more)


def person(e: str, a: str, v, **more) -> dict:
    return {"op": "assert", "entity": e, "attribute": a, "value": v, "validFrom": 0, "entityType": "person", **more}


_CUSTOMER = "SELECT c_custkey AS k, 'customer:' || c_custkey AS e, c_name, c_mktsegment, CASE WHEN c_custkey = 3 THEN 5.0 ELSE c_acctbal END AS bal, c_nationkey FROM customer"
_SEEN = "SELECT o_custkey AS k, o_orderstatus AS s, 3 AS tag FROM orders GROUP BY ALL UNION ALL SELECT c_custkey, c_custkey::VARCHAR, 2 FROM customer WHERE c_custkey % 5 = 0"
_ORDER = f"SELECT o_orderkey AS k, 'order:' || o_orderkey AS e, o_custkey, o_orderstatus AS s, o_totalprice AS t, epoch_ms(o_orderdate) AS vf, CASE WHEN o_orderkey % 3 <> 0 THEN epoch_ms(o_orderdate) + {30 * DAY} END AS vt FROM orders"

# Reads of a store.


@query("SELECT 'customer:' || c_custkey AS entity, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING'")
def store_match(spark, sf_dir):
    return ledger(spark, sf_dir).match(attribute=":customer/segment", value="BUILDING", entity_type="customer").select("entity", F.col("v.txt").alias("segment"))


@query("SELECT 'order:' || o_orderkey AS entity FROM orders WHERE o_custkey = 7")
def store_match_exact_type(spark, sf_dir):
    s, all_ = ledger(spark, sf_dir), Basis(position=5)
    hit = s.facts().where(visible(all_)).where("entity_type = 'order' AND vtype = 'ref' AND v.txt = 'customer:7'").select("entity")
    return hit.unionByName(s.match(value={"type": "string", "value": "customer:7"}).select("entity"))


@listed("read string, n long", [("get live", 1), ("get retracted", 0), ("assertion retracted", 1), ("assertion unknown", 0)])
def store_get(spark, sf_dir):
    s = ledger(spark, sf_dir)
    one, gone = "f:000000000002:000000", "f:000000000002:000001"
    return [("get live", s.get(one).count()), ("get retracted", s.get(gone).count()), ("assertion retracted", s.assertion(gone).count()), ("assertion unknown", s.assertion("f:none").count())]


@query(f"""WITH c AS ({_CUSTOMER}), s AS ({_SEEN}) SELECT ':customer/name' AS attribute, c_name AS txt, NULL::DOUBLE AS num FROM c WHERE k = 2 UNION ALL SELECT ':customer/segment', c_mktsegment, NULL FROM c WHERE k = 2
UNION ALL SELECT ':customer/balance', NULL, bal FROM c WHERE k = 2 UNION ALL SELECT ':customer/nation', 'nation:' || c_nationkey, NULL FROM c WHERE k = 2 UNION ALL SELECT ':customer/seen', s, NULL FROM s WHERE k = 2
UNION ALL SELECT ':customer/secret', NULL, NULL UNION ALL SELECT ':customer/note', 'also', NULL""")
def store_live_facts(spark, sf_dir):
    return ledger(spark, sf_dir).live_facts("customer:2").select("attribute", F.col("v.txt").alias("txt"), F.col("v.num").alias("num"))


@query("SELECT c_acctbal AS num, 1::BIGINT AS since, 4::BIGINT AS until FROM customer WHERE c_custkey = 3 UNION ALL SELECT 5.0, 4, NULL")
def store_history(spark, sf_dir):
    return ledger(spark, sf_dir).history("customer:3").where("attribute = ':customer/balance'").select(F.col("v.num").alias("num"), F.col("recorded_position").alias("since"), F.col("retracted_position").alias("until"))


@query("SELECT 3::BIGINT AS position, c_acctbal AS num FROM customer WHERE c_custkey = 3 UNION ALL SELECT 5, 5.0")
def store_entity_at(spark, sf_dir):
    s = ledger(spark, sf_dir)
    one = lambda p: s.entity("customer:3", Basis(position=p, valid_at=10)).where("attribute = ':customer/balance'").select(F.lit(p).cast("long").alias("position"), F.col("v.num").alias("num"))
    return one(3).unionByName(one(5))


@query(f"WITH s AS ({_SEEN}), n AS (SELECT k, count(*) AS n FROM s GROUP BY k) SELECT 0 AS place, 'customer:5' AS entity, 5 + coalesce((SELECT n FROM n WHERE k = 5), 0) AS n UNION ALL SELECT 1, 'customer:none', 0 UNION ALL SELECT 2, 'customer:2', 6 + coalesce((SELECT n FROM n WHERE k = 2), 0)")
def store_entities(spark, sf_dir):
    return ledger(spark, sf_dir).entities(["customer:5", "customer:none", "customer:2"], Basis(valid_at=10)).select("place", "entity", F.size("facts").cast("long").alias("n"))


@query(f"WITH s AS ({_SEEN}), n AS (SELECT k, count(*) AS n FROM s GROUP BY k) SELECT 'customer:' || c_custkey AS entity, 5 + coalesce(n, 0) + (c_custkey IN (1, 2))::INT AS n FROM customer LEFT JOIN n ON k = c_custkey WHERE 'customer:' || c_custkey > 'customer:20' ORDER BY entity LIMIT 50")
def store_entity_page(spark, sf_dir):
    return ledger(spark, sf_dir).entity_page("customer", 50, "customer:20", Basis(valid_at=10)).groupBy("entity").agg(F.count("*").alias("n"))


# The journal.


@query(f"WITH s AS ({_SEEN}) SELECT 1::BIGINT AS position, 'user:a' AS actor, (SELECT 5 * count(*) FROM customer) + (SELECT 3 * count(*) FROM orders) + (SELECT count(*) FROM s) AS n UNION ALL SELECT * FROM (VALUES (2, 'user:b', 3), (3, 'user:c', 1), (4, 'user:d', 2), (5, 'user:e', 0))")
def journal_feed(spark, sf_dir):
    return ledger(spark, sf_dir).feed().select("position", "actor", "n")


@listed("position long, n long", [(2, 3), (3, 1)])
def journal_feed_of_prefix(spark, sf_dir):
    return [(r["position"], r["n"]) for r in ledger(spark, sf_dir).feed(after=1, prefix="customer:2").collect()]


@listed("place long, position long", [(0, 3), (1, 2), (2, 1)])
def journal_of_entity(spark, sf_dir):
    return [(i, r["position"]) for i, r in enumerate(ledger(spark, sf_dir).transactions_for_entity("customer:2", at=4).collect())]


@query("SELECT 0 AS ord, 'retract' AS op, c_acctbal AS num FROM customer WHERE c_custkey = 3 UNION ALL SELECT 1, 'assert', 5.0")
def journal_by_command(spark, sf_dir):
    return ledger(spark, sf_dir).transaction(command_id="c4").select("ord", "op", F.col("v.num").alias("num"))


@listed("at long, position long", [(999, 0), (1000, 1), (3999, 3), (9000, 5)])
def journal_resolve(spark, sf_dir):
    s = ledger(spark, sf_dir)
    return [(t, s.resolve_position(t)) for t in (999, 1000, 3999, 9000)]


@query(f"WITH o AS ({_ORDER}) SELECT 1::BIGINT AS position, (SELECT min(x) FROM (SELECT vf AS x FROM o UNION ALL SELECT vt FROM o) WHERE x > {MID}) AS boundary")
def dependency_boundary(spark, sf_dir):
    d = ledger(spark, sf_dir).dependency_state([":order/status"], MID)
    return spark.createDataFrame([(d["position"], d["boundary"])], "position long, boundary long")


@query("SELECT ':customer/note' AS a, 2::BIGINT AS n UNION ALL SELECT ':_tx/actor', 5 UNION ALL SELECT ':_tx/command-id', 3 UNION ALL SELECT ':order/status', (SELECT count(*) FROM orders)")
def facts_and_journal(spark, sf_dir):
    rows = ledger(spark, sf_dir).base().query({"find": ["?a", "?n"], "where": [["?e", "?a", "?v"]], "aggregate": [["count", "?e", "?n"]], "validTime": "all"}, decode={"a": "string"})
    return rows.where(F.col("a").isin(":customer/note", ":_tx/actor", ":_tx/command-id", ":order/status"))


# Patterns.


@query(f"WITH s AS ({_SEEN}), m AS (SELECT k, min(CASE WHEN tag = 2 THEN '0' ELSE '1' || s END) AS f FROM s GROUP BY k) SELECT 'customer:' || c_custkey AS c, CASE WHEN f = '0' THEN NULL ELSE substr(f, 2) END AS txt, CASE WHEN f = '0' THEN c_custkey::DOUBLE END AS num FROM customer LEFT JOIN m ON k = c_custkey WHERE c_mktsegment = 'BUILDING'")
def first_of_many_values(spark, sf_dir):
    q = {"find": ["?c", "?s"], "where": [["?c", ":customer/segment", "BUILDING"]], "optionalProjection": {"rowBinding": "?c", "fields": [{"attribute": ":customer/seen", "variable": "?s"}]}}
    return ledger(spark, sf_dir).base().query(q, Basis(valid_at=10)).select(F.col("c").alias("c"), F.col("s.txt").alias("txt"), F.col("s.num").alias("num"))


@query(f"WITH s AS ({_SEEN}) SELECT ':customer/name' AS a, count(*) AS n FROM customer UNION ALL SELECT ':customer/segment', count(*) FROM customer UNION ALL SELECT ':customer/balance', count(*) FROM customer UNION ALL SELECT ':customer/nation', count(*) FROM customer UNION ALL SELECT ':customer/secret', count(*) FROM customer UNION ALL SELECT ':customer/note', 2 UNION ALL SELECT ':customer/seen', count(DISTINCT k) FROM s WHERE EXISTS (SELECT 1 FROM s WHERE k = 1) HAVING count(*) > 0")
def join_on_attribute(spark, sf_dir):
    q = {"find": ["?a", "?n"], "where": [["customer:1", "?a", "?x"], ["?c", "?a", "?y"]], "aggregate": [["count", "?c", "?n"]]}
    return ledger(spark, sf_dir).base().query(q, Basis(valid_at=10), {"a": "string"})


@query("SELECT 'customer:' || c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'")
def match_blind(spark, sf_dir):
    token = CODEC.token(":customer/secret", "string", "BUILDING")
    return ledger(spark, sf_dir).base().query({"find": ["?c"], "where": [["?c", ":customer/secret", {"type": "blind", "value": token}]]}, Basis(valid_at=10))


@query("SELECT 'customer:' || a.c_custkey AS a, 'customer:' || b.c_custkey AS b FROM customer a JOIN customer b ON a.c_mktsegment = b.c_mktsegment WHERE a.c_custkey <= 3 AND a.c_custkey <> b.c_custkey AND b.c_custkey % 50 = 0")
def sealed_join(spark, sf_dir):
    q = {"find": ["?a", "?b"], "where": [["?a", ":customer/secret", "?s"], ["?b", ":customer/secret", "?s"], ["!=", "?a", "?b"]]}
    rows = ledger(spark, sf_dir).base(sealing=SEALING).query(q, Basis(valid_at=10))
    few = lambda c, test: F.expr(f"CAST(substring({c}, 10) AS LONG) {test}")
    return rows.where(few("a", "<= 3") & few("b", "% 50 = 0"))


@query("SELECT 'text' AS kind, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'number', 0")
def identities_are_texts(spark, sf_dir):
    t = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_custkey AS num", "CAST(c_custkey AS STRING) AS txt")
    even = lift(t.where("k % 2 = 0"), "even", F.col("k"), mark="k:number")
    even.entity = F.col("k").cast("string")  # bare numbers as identities
    base = FactBase(spark, [lift(t, "c", F.col("k"), num="num:number", txt="txt:string"), even])
    ask = lambda a: base.query({"find": ["?n"], "where": [["?c", f":c/{a}", "?x"], ["?x", ":even/mark", "?m"]], "aggregate": [["count", "?c", "?n"]]})
    return ask("txt").select(F.lit("text").alias("kind"), "n").unionByName(ask("num").select(F.lit("number").alias("kind"), "n"))


@query("SELECT count(*) AS n FROM orders")
def bounds_meet_null_safely(spark, sf_dir):
    same = [{"pattern": ["?o", f":order/{a}", v], "valid": {"to": "?end"}} for a, v in (("status", "?s"), ("total", "?t"))]
    return ledger(spark, sf_dir).base().query({"find": ["?n"], "where": same, "aggregate": [["count", "?o", "?n"]], "validTime": "all"})


@query("SELECT 'customer:' || c_custkey AS c FROM customer WHERE c_custkey % 3 = 0")
def one_variable_twice(spark, sf_dir):
    t = table(spark, sf_dir, "customer").withColumn("peer", F.col("c_custkey") - F.col("c_custkey") % 3)
    return FactBase(spark, [lift(t, "customer", F.col("c_custkey"), peer="peer:ref:customer")]).query({"find": ["?c"], "where": [["?c", ":customer/peer", "?c"]]})


@query("SELECT 'customer:' || c_custkey AS c, 'order:' || o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY' AND o_totalprice > 150000 AND o_orderstatus <> 'F'")
def clauses_in_any_order(spark, sf_dir):
    where = [["not", ["?o", ":order/status", "F"]], [">", "?t", 150000], ["or", [["=", "?s", "MACHINERY"]]], ["?o", ":order/total", "?t"], ["?c", ":customer/segment", "?s"], ["?o", ":order/customer", "?c"]]
    return lifted(spark, sf_dir, "orders", "customer").query({"find": ["?c", "?o"], "where": where})


# Pages.


@query(f"WITH c AS ({_CUSTOMER}) SELECT (row_number() OVER (ORDER BY bal DESC, e) - 1) // 40 + 1 AS page, e AS c, (SELECT count(*) FROM c) AS total FROM c ORDER BY bal DESC, e LIMIT 120")
def cursor_pages(spark, sf_dir):
    s, cursor, out = ledger(spark, sf_dir), None, []
    q = {"inner": {"find": ["?c", "?b"], "where": [["?c", ":customer/balance", "?b"]]}, "orderBy": [{"variable": "?b", "direction": "desc"}], "limit": 40, "includeCount": True}
    for k in range(3):
        p = s.page({**q, **({"cursor": cursor} if cursor else {})})
        cursor = p.cursor
        out += [(k + 1, r["c"], p.total) for r in p.rows]
    return spark.createDataFrame(out, "page long, c string, total long")


@listed("case string, code string", [("text", "malformed"), ("query", "query_mismatch"), ("basis", "basis_mismatch"), ("scope", "scope_mismatch")])
def cursor_errors(spark, sf_dir):
    s = ledger(spark, sf_dir)
    q = {"inner": {"find": ["?c"], "where": [["?c", ":customer/segment", "?s"]]}, "limit": 5}
    cursor = s.page(q).cursor
    from factloom.plans.page import page

    return [("text", code_of(lambda: s.page({**q, "cursor": "x"}))), ("query", code_of(lambda: s.page({**q, "limit": 6, "cursor": cursor}))), ("basis", code_of(lambda: s.page({**q, "cursor": cursor}, Basis(position=1)))), ("scope", code_of(lambda: page(s.base(), {**q, "cursor": cursor}, None, "elsewhere", 5, 5000)))]


@listed("limit long, rows long, more boolean", [(1, 1, True), (100, 100, True)])
def page_sizes(spark, sf_dir):
    s = ledger(spark, sf_dir)
    inner = {"find": ["?c"], "where": [["?c", ":customer/segment", "?s"]]}
    out = [(n, s.page({"inner": inner, **({"limit": n} if n == 1 else {})})) for n in (1, 100)]
    return [(n, len(p.rows), p.cursor is not None) for n, p in out]


# Checks without data.

_BAD = {
    "literal like a variable": {"find": ["?e"], "where": [["?e", ":a", "?v"], ["=", "?v", "?9"]]},
    "and": {"find": ["?e"], "where": [["?e", ":a", "?v"], ["and", ["?e", ":b", 1]]]},
    "unbound find": {"find": ["?x"], "where": [["?e", ":a", "?v"]]},
    "unbound predicate": {"find": ["?e"], "where": [["?e", ":a", "?v"], [">", "?z", 1]]},
    "ordered text": {"find": ["?e"], "where": [["?e", ":a", "?v"], [">", "?v", "x"]]},
    "empty interval": {"find": ["?e"], "where": [{"pattern": ["?e", ":a", "?v"], "valid": {"from": 5, "to": 5}}]},
    "unknown rule": {"find": ["?e"], "where": [["?e", ":a", "?v"], ["r", "?e", "?v"]]},
    "source in find": {"find": ["?e", "?n"], "where": [["?e", ":a", "?v"]], "aggregate": [["count", "?e", "?n"]]},
    "limit": {"find": ["?e"], "where": [["?e", ":a", "?v"]], "limit": 0},
    "good": {"find": ["?e"], "where": [["?e", ":a", "?v"], ["r", "x", "?e"]], "rules": [{"name": "r", "body": [["?p", ":q", "?o"]]}]},
}


@listed("case string, code string", [("literal like a variable", "invalid_variable"), ("and", "unsupported_and"), ("unbound find", "unbound_variable"), ("unbound predicate", "unbound_variable"), ("ordered text", "nonnumeric_comparison"), ("empty interval", "empty_interval"), ("unknown rule", "unknown_rule"), ("source in find", "aggregate_source"), ("limit", "invalid_limit"), ("good", "ok")])
def validation_codes(spark, sf_dir):
    return [(k, code_of(lambda: A.parse(q))) for k, q in _BAD.items()]  # noqa: B023


@listed("kind string, name string", [("attribute", ":x"), ("attribute", ":y"), ("id", "a"), ("subject of :x", "a"), ("dynamic", "true")])
def query_dependencies(spark, sf_dir):
    d = A.dependencies({"find": ["?e"], "where": [["a", ":x", "?e"], ["not", ["?e", ":y", 1]], ["?e", "?any", 2]]})
    return [("attribute", a) for a in sorted(d["attributes"])] + [("id", i) for i in sorted(d["ids"])] + [(f"subject of {a}", x) for a, s in d["subjects"].items() if s for x in sorted(s)] + [("dynamic", str(d["dynamic"]).lower())]


@listed("asked string, hint string", [(":customer/segmnt", ":customer/segment"), (":customer/nane", ":customer/name"), (":zebra/stripes", None)])
def unknown_attributes(spark, sf_dir):
    base = lifted(spark, sf_dir, "customer")
    base.known = {a for s in base.sources for a in s.columns}
    out = []
    for a in (":customer/segmnt", ":customer/nane", ":zebra/stripes"):
        try:
            base.query({"find": ["?c"], "where": [["?c", a, "?v"]]})
        except QueryError as e:
            out.append((a, e.more["suggestion"]))
    return out


@listed("what string, n long", [("patterns", 2), ("predicates", 1), ("negations", 1), ("steps", 1), ("joins", 1)])
def explained(spark, sf_dir):
    q = {"find": ["?c", "?o"], "where": [["?o", ":order/customer", "?c"], ["?c", ":customer/segment", "?s"], ["!=", "?s", "BUILDING"], ["not", ["?o", ":order/status", "F"]]]}
    got = E.explain(lifted(spark, sf_dir, "orders", "customer"), q)
    return [(k, got["clauses"][k]) for k in ("patterns", "predicates", "negations")] + [("steps", len(got["steps"])), ("joins", int("LeftAnti" in got["steps"][0][1]))]


# Commits.


@listed("case string, code string", [("live", "ok"), ("state", "ok"), ("state", "precondition"), ("value", "ok"), ("value", "precondition"), ("absent", "precondition"), ("entity absent", "ok"), ("command", "command_already_committed"), ("reserved", "reserved"), ("fraction", "invalid_interval"), ("empty", "empty_interval"), ("nan", "nonfinite"), ("op", "unknown_op")])
def commit_guards(spark, sf_dir):
    s = ledger(spark, sf_dir)
    note = {"op": "assert", "entity": "customer:9", "attribute": ":customer/note", "value": "n"}
    ids = [r["id"] for r in s.live_facts("customer:1").select("id").collect()]
    dry = lambda op=note, **more: code_of(lambda: s.transact([op], dry_run=True, **more))
    guard = lambda kind, **more: dry(preconditions=[{"kind": kind, **more}])
    return [
        ("live", guard("TripleLive", id="f:000000000002:000000")), ("state", guard("EntityState", entity="customer:1", ids=ids)), ("state", guard("EntityState", entity="customer:1", ids=ids[1:])), ("value", guard("AttributeValue", entity="customer:3", attribute=":customer/balance", value=5)), ("value", guard("AttributeValue", entity="customer:3", attribute=":customer/balance", value=6)),
        ("absent", guard("AttributeAbsent", entity="customer:1", attribute=":customer/note")), ("entity absent", guard("EntityAbsent", entity="customer:none")), ("command", dry(command_id="c2")), ("reserved", dry(note | {"attribute": ":_tx/actor"})), ("fraction", dry(note | {"validFrom": 0.5})), ("empty", dry(note | {"validFrom": 5, "validTo": 5})), ("nan", dry(note | {"value": float("nan")})), ("op", dry({"op": "merge"})),
    ]


@listed("ord long, op string, entity string", [(0, "assert", "customer:8"), (1, "retract", "customer:1"), (2, "retract", "customer:8"), (3, "retract", "customer:2"), (4, "assert", "customer:8")])
def commit_in_order(spark, sf_dir):
    s = ledger(spark, sf_dir)
    say = lambda v: {"op": "assert", "entity": "customer:8", "attribute": ":customer/note", "value": v}
    ops = [say("x"), {"op": "retract", "id": "f:000000000002:000000"}, {"op": "retract", "id": "f:000000000006:000000"}, {"op": "retract", "id": "f:none"}, {"op": "retract-pattern", "pattern": {"attribute": ":customer/note", "value": "also"}}, say("y")]
    return [(r["ord"], r["op"], r["entity"]) for r in s.transact(ops, dry_run=True)[0].collect()]


@listed("edit string, op string, value long, validFrom long, validTo long", [("end", "retract", None, None, None), ("end", "assert", 1, 0, 5), ("replace", "retract", None, None, None), ("replace", "assert", 1, 0, 5), ("replace", "assert", 2, 5, 9), ("correct", "retract", None, None, None), ("correct", "assert", 3, 0, 9)])
def interval_edits(spark, sf_dir):
    f = {"id": "f", "entity": "e", "attribute": ":a", "value": {"type": "number", "value": 1}, "validFrom": 0, "validTo": 9}
    edits = {"end": S.end(f, 5), "replace": S.replace(f, 2, 5), "correct": S.correct(f, 3)}
    return [(k, o["op"], o.get("value", {}).get("value"), o.get("validFrom"), o.get("validTo")) for k, ops in edits.items() for o in ops]


@listed("key string, position long", [("x", 5), ("z", 5)])
def outbox_pending(spark, sf_dir):
    return [(r["key"], r["position"]) for r in ledger(spark, sf_dir).pending("mail").collect()]


@listed("step string, got string", [("new", "0"), ("move", "3"), ("again", "3"), ("stale", "checkpoint_conflict"), ("ahead", "invalid_checkpoint"), ("back", "invalid_checkpoint"), ("on", "5")])
def consumer_checkpoints(spark, sf_dir):
    s = ledger(spark, sf_dir)
    me = Folder(spark, "consumer").root  # a name of its own for each run
    return [
        ("new", str(s.consumer(me))), ("move", str(s.advance(me, 0, 3))), ("again", str(s.advance(me, 0, 3))), ("stale", code_of(lambda: s.advance(me, 0, 2))),
        ("ahead", code_of(lambda: s.advance(me, 3, 99))), ("back", code_of(lambda: s.advance(me, 3, 1))), ("on", str(s.advance(me, 3, 5))),
    ]


_RULES = [C.Required("customer", ":customer/note"), C.Cardinality("customer", ":customer/seen", 2), C.Unique("customer", ":customer/segment"), C.ReferenceTarget("order", ":order/customer", "customer")]


@query(f"""WITH s AS ({_SEEN}) SELECT 'Required' AS kind, 'customer:' || c_custkey AS key, 1::BIGINT AS size FROM customer WHERE c_custkey NOT IN (1, 2) UNION ALL SELECT 'Cardinality', 'customer:' || k, count(*) FROM s GROUP BY k HAVING count(*) > 2
UNION ALL SELECT 'Unique', c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment HAVING count(*) > 1""")
def constraint_violations(spark, sf_dir):
    live = ledger(spark, sf_dir).facts().where("retracted_position IS NULL")
    return C.violations(live, _RULES).select("kind", F.when(F.col("kind") == "Unique", F.get_json_object("key", "$.txt")).otherwise(F.col("key")).alias("key"), "size").distinct()


@query(f"WITH s AS ({_SEEN}), n AS (SELECT k, count(*) AS n FROM s GROUP BY k) SELECT 'customer:' || c_custkey AS key, coalesce(n, 0) + 1 AS size FROM customer LEFT JOIN n ON k = c_custkey WHERE c_custkey % 10 = 0 AND coalesce(n, 0) + 1 > 2")
def constraint_worsened(spark, sf_dir):
    live = ledger(spark, sf_dir).facts().where("retracted_position IS NULL")
    more = live.where("attribute = ':customer/name' AND CAST(substring(entity, 10) AS LONG) % 10 = 0").withColumn("attribute", F.lit(":customer/seen")).withColumn("id", F.concat(F.lit("new:"), "entity"))
    return C.worsened(C.violations(live, _RULES[1:2]), C.violations(live.unionByName(more), _RULES[1:2])).select("key", "size").distinct()


@query(f"WITH o AS ({_ORDER}) SELECT e AS owner, vt AS at FROM o WHERE vt IS NOT NULL AND o_custkey % 7 = 0 AND k % 2 = 0")
def constraint_at_edges(spark, sf_dir):
    """Even orders of every seventh customer outlive their status: its absence begins where the status ends."""
    s = ledger(spark, sf_dir)
    live = s.facts().where("retracted_position IS NULL AND entity_type = 'order'")
    of = live.where("attribute = ':order/customer' AND CAST(substring(v.txt, 10) AS LONG) % 7 = 0 AND CAST(substring(entity, 7) AS LONG) % 2 = 0").withColumn("valid_to", F.lit(None).cast("long"))
    status = live.where("attribute = ':order/status'").join(of.select("entity"), "entity", "left_semi").withColumn("entity_type", F.lit(None).cast("string"))
    return C.violations(of.unionByName(status), [C.Required("order", ":order/status")]).select(F.col("key").alias("owner"), "at")


@listed("case string, code string", [("ok", "ok"), ("required", "constraint"), ("validator", "validator"), ("load", "reserved"), ("target", "constraint"), ("head", "2")])
def commit_judged(spark, sf_dir):
    s = small(spark, constraints=[C.Required("person", ":p/name"), C.ReferenceTarget("person", ":p/boss", "person")])
    s.validators = [lambda before, after: "no" if after.query({"find": ["?e"], "where": [["?e", ":p/name", "Eve"]]}).take(1) else None]
    rows = spark.createDataFrame([("a", ":_tx/actor", "person", "string")], "entity string, attribute string, entity_type string, vtype string").withColumn("v", V.literal("x"))
    ref = {"type": "ref", "value": "a"}
    return [
        ("ok", code_of(lambda: [s.transact([person("a", ":p/name", "Ann")]), s.transact([person("b", ":p/name", "Bob"), person("b", ":p/boss", ref)])])), ("required", code_of(lambda: s.transact([person("c", ":p/mail", "c")]))),
        ("validator", code_of(lambda: s.transact([person("e", ":p/name", "Eve")]))), ("load", code_of(lambda: s.load(rows))), ("target", code_of(lambda: s.transact([{"op": "retract-pattern", "pattern": {"entity": "a"}}]))), ("head", str(s.head())),
    ]


@listed("what string, n long", [("changes", 2), ("changed", 1), ("head", 5)])
def commit_preview(spark, sf_dir):
    s = ledger(spark, sf_dir)
    d = D.Derivation.make("poor", {"find": ["?c"], "where": [["?c", ":customer/balance", "?b"], ["?c", ":customer/note", "?n"]]}, ["?c"], ["?b"])
    ops = [{"op": "retract-pattern", "pattern": {"entity": "customer:1", "attribute": ":customer/balance"}}, {"op": "assert", "entity": "customer:1", "attribute": ":customer/balance", "value": 1, "validFrom": 0}]
    got = D.preview(s, ops, [d], valid_at=10)
    return [("changes", got["changes"].count()), *[(r["change"], r["count"]) for r in got["derivations"]["poor"].groupBy("change").count().collect()], ("head", s.head())]


# Derivations.

_BIG = D.Derivation.make("big", {"find": ["?o"], "where": [["?o", ":order/customer", "?c"], ["?c", ":customer/segment", "?s"], ["?o", ":order/total", "?t"], [">", "?t", 200000]]}, ["?o"], ["?s"])
_STATES = D.Derivation.make("states", {"find": ["?c"], "where": [["?o", ":order/customer", "?c"], ["?o", ":order/status", "?s"]]}, ["?c"], ["?s"])


@query(f"WITH o AS ({_ORDER}) SELECT e AS o, c_mktsegment AS s, 3::BIGINT AS sources, vt AS valid_until FROM o JOIN customer ON c_custkey = o_custkey WHERE t > 200000 AND vf <= {MID} AND (vt IS NULL OR vt > {MID})")
def derived_candidates(spark, sf_dir):
    c = D.candidates(ledger(spark, sf_dir).base(), _BIG, Basis(valid_at=MID))
    return c.select(F.get_json_object("identity", "$[0].txt").alias("o"), F.get_json_object("result", "$[0].txt").alias("s"), F.size("sources").cast("long").alias("sources"), "valid_until")


@query(f"WITH o AS ({_ORDER}) SELECT 'customer:' || o_custkey AS c, count(DISTINCT s) > 1 AS conflict, 2 * count(*) AS sources FROM o WHERE vf <= {MID} AND (vt IS NULL OR vt > {MID}) GROUP BY o_custkey")
def derived_conflicts(spark, sf_dir):
    c = D.candidates(ledger(spark, sf_dir).base(), _STATES, Basis(valid_at=MID))
    return c.select(F.get_json_object("identity", "$[0].txt").alias("c"), "conflict", F.size("sources").cast("long").alias("sources"))


@query(f"WITH o AS ({_ORDER}), a AS (SELECT k FROM o WHERE t > 200000 AND vf <= {MID} AND (vt IS NULL OR vt > {MID})), b AS (SELECT k FROM o WHERE t > 200000 AND vf <= {MID + 10 * DAY} AND (vt IS NULL OR vt > {MID + 10 * DAY})) SELECT CASE WHEN b.k IS NULL THEN 'removed' WHEN a.k IS NULL THEN 'added' ELSE 'unchanged' END AS change, count(*) AS n FROM a FULL JOIN b USING (k) GROUP BY ALL")
def derived_reconciled(spark, sf_dir):
    base = ledger(spark, sf_dir).base()
    return D.reconcile(D.candidates(base, _BIG, Basis(valid_at=MID)), D.candidates(base, _BIG, Basis(valid_at=MID + 10 * DAY))).groupBy("change").agg(F.count("*").alias("n"))


@listed("when string, status string", [("before", "unmaterialized"), ("run", "current"), ("edge", "stale"), ("earlier", "stale")])
def derived_status(spark, sf_dir):
    m = D.Materialized(ledger(spark, sf_dir), _BIG, Folder(spark, "run").root + "/m")
    out = [("before", m.status(MID))]
    m.run(MID)
    return out + [("run", m.status(MID)), ("edge", m.status(MID + 400 * DAY)), ("earlier", m.status(MID - DAY))]


@query(f"WITH o AS ({_ORDER}) SELECT 'order:new' AS o, 'customer:4' AS c UNION ALL SELECT e, 'customer:' || o_custkey FROM o WHERE o_custkey = 4 AND k <> (SELECT min(k) FROM o WHERE o_custkey = 4)")
def overlay(spark, sf_dir):
    s = ledger(spark, sf_dir)
    of = s.facts().where("attribute = ':order/customer' AND v.txt = 'customer:4'")
    first = of.orderBy(F.expr("CAST(substring(entity, 7) AS LONG)")).select("id").first()["id"]
    then = D.what_if(s.base(), [{"op": "assert", "entity": "order:new", "attribute": ":order/customer", "value": {"type": "ref", "value": "customer:4"}}], [first])
    return then.query({"find": ["?o", "?c"], "where": [["?o", ":order/customer", "?c"], ["=", "?c", "customer:4"]], "validTime": "all"}, decode={"c": "string"})


@listed("step long, actor string, command_id string, more boolean", [(0, "user:d", "c4", False), (1, "user:c", "c3", True)])
def why_chain(spark, sf_dir):
    return [(r["step"], r["actor"], r["command_id"], r["more"]) for r in D.why(ledger(spark, sf_dir), "f:000000000004:000001", depth=2).collect()]


@listed("batch long, reason string, attempt long, changes string", [(0, "initial", 1, "failed"), (0, "initial", 2, "added"), (1, "commit", 1, "added"), (2, "time", 1, "removed")])
def runner_deliveries(spark, sf_dir):
    now, got, fail = [1000], [], [1]
    s = small(spark, now)
    s.transact([person("a", ":p/name", "Ann", validTo=9000)])

    def deliver(info: dict, diff: DataFrame) -> None:
        broken = fail[0] > 0
        fail[0] -= 1
        got.append((info["batch_id"], info["reason"], info["attempt"], "failed" if broken else ",".join(sorted(r["change"] for r in diff.collect()))))
        if broken:
            raise OSError("down")

    r = R.Runner(s, "mailer", first_delay=100)
    r.register("names", D.Derivation.make("n", {"find": ["?e"], "where": [["?e", ":p/name", "?n"]]}, ["?e"]), deliver)
    r.tick()
    now[0] = 1200
    r.tick()
    s.transact([person("b", ":p/name", "Bob")])
    r.tick()
    now[0] = 9500
    r.tick()
    names = list(dict.fromkeys(b for b, *_ in got))
    return [(names.index(b), *more) for b, *more in got]


# Live queries.


@listed("reason string, position long, names string", [("initial", 1, "Ann"), ("commit", 2, "Ann,Bob"), ("coalesced", 5, "Ann,Bob,Cy"), ("time", 5, "Bob,Cy"), ("resume", 5, "Bob,Cy")])
def watch_reasons(spark, sf_dir):
    now, got = [1000], []
    s = small(spark, now)
    q = {"find": ["?n"], "where": [["?e", ":p/name", "?n"]]}
    on = lambda df, info: got.append((info["reason"], info["position"], ",".join(sorted(r["n"]["txt"] for r in df.collect()))))
    w = Watch(s, q, on)
    s.transact([person("a", ":p/name", "Ann", validTo=7000)])
    w.poll()
    s.transact([person("b", ":p/name", "Bob")])
    w.poll()
    s.transact([person("b", ":p/mail", "x")])
    w.poll()
    s.transact([person("b", ":p/mail", "y")])
    s.transact([person("c", ":p/name", "Cy")])
    w.poll()
    now[0] = 7000
    w.poll()
    Watch(s, q, on, token=w.token).poll()
    return got


@listed("name string, affected boolean", [("balance", True), ("note of 2", False), ("status", False), ("any", True)])
def registry_split(spark, sf_dir):
    r, s = Registry(), ledger(spark, sf_dir)
    asked = {
        "balance": {"find": ["?b"], "where": [["?c", ":customer/balance", "?b"]]}, "note of 2": {"find": ["?n"], "where": [["customer:2", ":customer/note", "?n"]]},
        "status": {"find": ["?n"], "where": [["?o", ":order/status", "?n"]]}, "any": {"find": ["?a"], "where": [["customer:2", "?a", "?n"]]},
    }
    keys = {r.subscribe("me", q): name for name, q in asked.items()}
    hit, _ = r.split(s.changes().where("position = 4"))
    return [(name, key in hit) for key, name in keys.items()]


@query("SELECT 'customer:' || c_custkey AS entity, 'building' AS rule, true AS before, NULL::BOOLEAN AS after FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 4 = 0 UNION ALL SELECT 'customer:' || c_custkey, 'building', false, NULL FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey % 4 = 0")
def reactor_flips(spark, sf_dir):
    live = ledger(spark, sf_dir).facts().where("retracted_position IS NULL")
    gone = live.where("attribute = ':customer/segment' AND CAST(substring(entity, 10) AS LONG) % 4 = 0")
    r = Reactor({"building": ("eq", ":customer/segment", "BUILDING"), "noted": ("exists", ":customer/note")})
    return r.react(gone.select("entity", "attribute"), live, live.join(gone.select("id"), "id", "left_anti"), 0)


# Rules of three values.

_KLEENE = {"building": ("eq", ":customer/segment", "BUILDING"), "noted": ("exists", ":customer/note"), "first": ("eq", ":customer/note", "first"), "poor": ("before", ":customer/balance", "instant"), "both": ("all", [("rule", "building"), ("rule", "first")]), "one": ("any", [("rule", "building"), ("rule", "first")]), "not": ("not", ("rule", "first")), "loop": ("not", ("rule", "loop"))}


def _customers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    live = ledger(spark, sf_dir).facts().where("retracted_position IS NULL AND attribute <> ':customer/seen'")
    return live, live.where("entity_type = 'customer'").select("entity").distinct()


_THREE = f"SELECT e AS entity, c_mktsegment = 'BUILDING' AS building, k IN (1, 2) AS noted, CASE k WHEN 1 THEN true WHEN 2 THEN false END AS first, floor(bal) < 1000 AS poor FROM ({_CUSTOMER})"


@query(f'SELECT *, building AND "first" AS both, building OR "first" AS one, NOT "first" AS "not", NULL::BOOLEAN AS loop FROM ({_THREE})')
def three_values(spark, sf_dir):
    return K.evaluate(*_customers(spark, sf_dir), _KLEENE, 1000)


@query(f"SELECT entity, 'building' AS rule, building AS before, true AS after FROM ({_THREE}) WHERE NOT building UNION ALL SELECT entity, 'one', building OR \"first\", true FROM ({_THREE}) WHERE coalesce(building OR \"first\", false) IS DISTINCT FROM true UNION ALL SELECT entity, 'both', building AND \"first\", \"first\" FROM ({_THREE}) WHERE (building AND \"first\") IS DISTINCT FROM \"first\"")
def rule_impact(spark, sf_dir):
    return K.impact(*_customers(spark, sf_dir), _KLEENE, _KLEENE | {"building": ("lit", True)}, 1000)


@query(f"SELECT 'poor' AS rule, 'moved' AS verdict, count(*) AS n FROM customer UNION ALL SELECT 'building', 'same', count(*) FROM customer WHERE c_custkey <> 1 UNION ALL SELECT 'building', 'moved', 1")
def rule_replay(spark, sf_dir):
    facts, subjects = _customers(spark, sf_dir)
    rules = {k: _KLEENE[k] for k in ("building", "poor")}
    then = facts.where("NOT (entity = 'customer:1' AND attribute = ':customer/segment')")
    return K.replay(K.answers(facts, subjects, rules, 1000), then, rules, 2000).groupBy("rule", "verdict").agg(F.count("*").alias("n"))


@listed("case string, code string", [("several", "raised"), ("one", "ok")])
def rule_of_many_values(spark, sf_dir):
    live = ledger(spark, sf_dir).facts().where("retracted_position IS NULL")
    subjects = live.where("entity_type = 'customer'").select("entity").distinct()

    def tried(a: str) -> str:
        try:
            K.evaluate(live, subjects, {"x": ("exists", a)}, 0).write.format("noop").mode("overwrite").save()
        except Exception:
            return "raised"
        return "ok"

    return [("several", tried(":customer/seen")), ("one", tried(":customer/name"))]


# Types, entities, snapshots, sealed values, configuration.

_NUM, _INT, _TEXT = T.Prim("number"), T.Prim("integer"), T.Prim("text")


@listed("case string, relation string", [("integer number", "widens"), ("number integer", "narrows"), ("date text", "incompatible"), ("instant number", "incompatible"), ("tight loose", "widens"), ("enum text", "widens"), ("record more", "widens"), ("same", "equal")])
def type_relations(spark, sf_dir):
    some, more = T.Record((("a", _NUM, True),)), T.Record((("a", _NUM, False),))
    pairs = {"integer number": (_INT, _NUM), "number integer": (_NUM, _INT), "date text": (T.Prim("date"), _TEXT), "instant number": (T.Prim("instant"), _NUM), "tight loose": (T.Bounded(_NUM, min=1, max=5), T.Bounded(_NUM, min=0)), "enum text": (T.Enum(frozenset({"a"})), _TEXT), "record more": (some, more), "same": (T.ListOf(_INT), T.ListOf(_INT))}
    return [(k, T.relation(a, b)) for k, (a, b) in pairs.items()]


@listed("case string, got string", [("fallback", '{"n":3,"tags":[]}'), ("extra", '{"n":3,"tags":["x"]}'), ("fraction", "rejected"), ("missing", "rejected")])
def type_normalized(spark, sf_dir):
    t = T.Record((("n", _INT, True), ("tags", T.ListOf(_TEXT), False, [])))

    def got(x: dict) -> str:
        try:
            return V.canonical_json(T.normalize(t, x))
        except ValueError:
            return "rejected"

    return [("fallback", got({"n": 3.0})), ("extra", got({"n": 3, "tags": ["x"], "z": 1})), ("fraction", got({"n": 3.5})), ("missing", got({}))]


_TYPE = T.EntityType("customer", (T.Attribute(":customer/name", _TEXT, True), T.Attribute(":customer/segment", T.Enum(frozenset({"BUILDING", "MACHINERY"})), True), T.Attribute(":customer/balance", T.Bounded(_NUM, min=0), True), T.Attribute(":customer/nation", T.Ref(), True), T.Attribute(":customer/note", _TEXT, True), T.Attribute(":customer/secret", _TEXT, sealed=True)))
_INVALID = f"""WITH c AS ({_CUSTOMER}), s AS ({_SEEN}) SELECT e AS entity, ':customer/segment' AS attribute, 'invalid' AS problem FROM c WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') UNION ALL SELECT e, ':customer/balance', 'invalid' FROM c WHERE bal < 0
UNION ALL SELECT e, ':customer/note', 'missing' FROM c WHERE k NOT IN (1, 2) UNION ALL SELECT DISTINCT 'customer:' || k, ':customer/seen', 'unknown' FROM s"""


@query(_INVALID)
def entity_validation(spark, sf_dir):
    return T.validate(ledger(spark, sf_dir).facts().where("retracted_position IS NULL"), _TYPE)


@query(f"SELECT 'ever' AS kind, count(DISTINCT entity) AS n FROM ({_INVALID}) UNION ALL SELECT 'now', count(DISTINCT entity) FROM ({_INVALID}) UNION ALL SELECT 'last', count(DISTINCT entity) FROM ({_INVALID})")
def entity_validation_runs(spark, sf_dir):
    runs = T.ValidationRuns(ledger(spark, sf_dir), _TYPE, Folder(spark, "runs").root + "/v")
    runs.run()
    n = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n("ever", runs.ever_invalid()).unionByName(n("now", runs.current_invalid())).unionByName(n("last", runs.last_invalid()))


@query(f"WITH c AS ({_CUSTOMER}), s AS ({_SEEN}), n AS (SELECT k, count(*) AS n FROM s GROUP BY k) SELECT e AS entity, c_name AS name, bal AS balance, coalesce(n, 0) AS seen, CASE k WHEN 1 THEN 'first' WHEN 2 THEN 'also' ELSE 'none' END AS note FROM c LEFT JOIN n USING (k)")
def entity_decode(spark, sf_dir):
    t = T.EntityType("customer", (T.Attribute(":customer/name", _TEXT), T.Attribute(":customer/balance", _NUM), T.Attribute(":customer/seen", T.AnyType(), many=True), T.Attribute(":customer/note", _TEXT, fallback="none")))
    got = T.decode(ledger(spark, sf_dir).facts().where("retracted_position IS NULL"), t)
    return got.select("entity", F.col("name.txt").alias("name"), F.col("balance.num").alias("balance"), F.size("seen").cast("long").alias("seen"), F.col("note.txt").alias("note"))


@query(f"SELECT e AS self FROM ({_CUSTOMER}) WHERE c_mktsegment = 'BUILDING' AND k NOT IN (1, 2)")
def entity_query(spark, sf_dir):
    return ledger(spark, sf_dir).base().query({"find": ["?self"], "where": [*_TYPE.where(segment="BUILDING"), _TYPE.without("note")]}, Basis(valid_at=10))


@listed("entity string, attribute string, change string", [("customer:1", ":customer/note", "added"), ("customer:2", ":customer/note", "added"), ("customer:3", ":customer/balance", "changed")])
def snapshot_diff(spark, sf_dir):
    return [tuple(r) for r in N.cuts(ledger(spark, sf_dir).facts(), Basis(position=1), Basis(position=5)).collect()]


@listed("position long, same boolean", [(1, True), (2, False), (3, False)])
def snapshot_hashes(spark, sf_dir):
    s = ledger(spark, sf_dir)
    first = N.at(s, ["customer:2"], position=1).first()["hash"]
    return [(r["position"], r["hash"] == first) for r in N.hashes(s, "customer:2").collect()]


@query("SELECT 'customer:' || c_custkey AS entity FROM customer WHERE c_custkey IN (1, 2, 3)")
def snapshot_changed(spark, sf_dir):
    return N.find_changed(ledger(spark, sf_dir), 1).select("entity")


@query("SELECT 'customer:' || c_custkey AS e FROM customer WHERE c_mktsegment = 'MACHINERY'")
def sealed_equality(spark, sf_dir):
    return ledger(spark, sf_dir).base(sealing=SEALING).query({"find": ["?e"], "where": [["?e", ":customer/secret", "MACHINERY"]]}, Basis(valid_at=10))


@listed("case string, code string", [("presence", "ok"), ("projection", "projection"), ("predicate", "predicate"), ("order", "projection"), ("join", "join"), ("open attribute", "dynamic-attribute"), ("aggregate", "aggregate")])
def sealed_refusals(spark, sf_dir):
    base = ledger(spark, sf_dir).base(sealing=SEALING)
    secret = ["?e", ":customer/secret", "?x"]
    ask = lambda find, where, **more: code_of(lambda: base.query({"find": find, "where": where, **more}, Basis(valid_at=10)))
    return [
        ("presence", ask(["?e"], [secret])), ("projection", ask(["?x"], [secret])), ("predicate", ask(["?e"], [secret, ["=", "?x", "y"]])), ("order", ask(["?e", "?x"], [secret], orderBy=[{"variable": "?x"}])), ("join", ask(["?e"], [secret, ["?f", ":customer/name", "?x"]])),
        ("open attribute", ask(["?e"], [["?e", "?a", "BUILDING"]])), ("aggregate", ask(["?e", "?n"], [secret], aggregate=[["count", "?x", "?n"]])),
    ]


@query("SELECT 'customer:' || c_custkey AS entity, '\"' || c_mktsegment || '\"' AS plain FROM customer")
def sealed_opened(spark, sf_dir):
    return X.opened(ledger(spark, sf_dir).sealed_facts(), CODEC).select("entity", "plain")


@listed("step string, n long", [("rewrapped", 2), ("again", 0), ("equal", 2), ("scrubbed", 2), ("equal after", 0), ("present", 2)])
def sealed_rotation(spark, sf_dir):
    s = small(spark)
    z = X.Sealing(CODEC, {":p/ssn": "string"})
    s.transact([person(e, ":p/ssn", z.value(":p/ssn", "123")) for e in ("a", "b")])
    new = X.Codec("k2", lambda t: t.swapcase(), lambda t: t.swapcase(), b"ledger")
    ask = lambda v: s.base(sealing=X.Sealing(new, z.attributes)).query({"find": ["?e"], "where": [["?e", ":p/ssn", v]]}, Basis(valid_at=10)).count()
    return [("rewrapped", X.rewrap(s, CODEC, new)), ("again", X.rewrap(s, CODEC, new)), ("equal", ask("123")), ("scrubbed", s.scrub_blind_tokens()), ("equal after", ask("123")), ("present", ask("?x"))]


@listed("change string, path string", [("changed", "visit"), ("changed", "visit/has:age"), ("added", "visit/has:mail")])
def config_diff(spark, sf_dir):
    field = lambda k, t: G.Node("field", k, {"type": t})
    form = lambda *fields: G.Node("form", "visit", {}, tuple(("has", f) for f in fields))
    return [(c["change"], c["path"]) for c in G.diff(form(field("age", "integer"), field("name", "text")), form(field("name", "text"), field("age", "number"), field("mail", "text")))]


@listed("what string, key string", [("needs adult", "check"), ("needs adult", "visit"), ("live", "first"), ("live", "second"), ("rejected", "adult")])
def config_releases(spark, sf_dir):
    c = G.ConfigStore(small(spark))
    policy = lambda n: G.Node("policy", "adult", {"min": n})
    form, step = G.Node("form", "visit", {}, refs=(("by", "policy", "adult"),)), G.Node("step", "check", {}, refs=(("uses", "form", "visit"),))
    a, b = c.commit("first", [form, policy(18), step], ref="live"), None
    out = [("needs adult", r["key"]) for r in c.reverse_dependencies("policy", "adult").collect()]
    out.append(("live", "first" if c.resolve_ref("live") == a else "?"))
    b = c.commit("second", [form, policy(21), step])
    c.set_ref("live", b)
    return out + [("live", "second" if c.resolve_ref("live") == b else "?")] + [("rejected", k) for k in c.recheck(a, "policy", T.Record((("min", T.Bounded(_INT, min=20), True),)))]
