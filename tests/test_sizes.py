"""What must not grow with a transaction, a key or a cut: rows, buffers and shuffles of the plans."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.operators.store import Store


def P(e, a, v, **more):
    return {"op": "assert", "entity": e, "attribute": a, "value": v, "validFrom": 0, "entityType": "person", **more}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s", clock=lambda: 1000)


def loaded(spark, store, n=6):
    rows = spark.range(n).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("entity"), F.lit(":p/name").alias("attribute"), F.lit("person").alias("entity_type"), F.lit("string").alias("vtype"), V.struct(F.col("id").cast("string"), V.TEXT).alias("v"))
    return store.load(rows, actor="a")


def test_feed_gathers_no_changes_into_a_row(spark, store):
    loaded(spark, store)
    ids = store.transact([P("b", ":p/name", "Bob"), P("c", ":p/name", "Cy")]).ids
    store.transact([{"op": "append-entry", "scope": "s", "key": "k"}])
    feed = store.feed()
    assert [(r["position"], r["n"]) for r in feed.collect()] == [(1, 6), (2, 2), (3, 0)]
    assert "collect_" not in plan(feed) and "collect_" not in plan(store.feed_changes())
    assert [(r["position"], r["ord"], r["triple_id"]) for r in store.feed_changes(after=1).collect()] == [(2, 0, ids[0]), (2, 1, ids[1])]
    assert store.feed_changes(limit=1).count() == 6 and store.feed_changes(prefix="b").count() == 2
    assert [r["n"] for r in store.feed(prefix="b").collect()] == [2] and store.feed(after=3).count() == 0


def test_load_writes_its_facts_once_in_lots(spark, store, tmp_path, monkeypatch):
    from factloom.operators import store as S

    monkeypatch.setattr(S, "LOT", 2, raising=False)
    loaded(spark, store)
    (name, kinds), = store.manifest()["segments"]
    assert kinds == ["facts", "transactions"]
    assert len(list((tmp_path / "s" / name / "facts").glob("*.parquet"))) > 1  # a task sorts LOT rows or so
    facts = {(r["id"], r["entity"], r["attribute"], r["recorded_at"], r["tx_id"], r["created_by"]) for r in store.facts().collect()}
    assert len(facts) == 6 and {x[3:] for x in facts} == {(1000, "tx:000000000001", "a")}
    want = {(1, 0, i, "assert", e, a) for i, e, a, *_ in facts}
    assert {tuple(r) for r in store.changes().collect()} == want
    store.transact([P("b", ":p/name", "Bob")])
    assert store.changes().count() == 7 and store.transactions_for_entity("e3").count() == 1
    store.compact()
    assert {tuple(r) for r in store.changes().where("position = 1").collect()} == want and store.changes().count() == 7


def facts_of(spark, *rows):
    df = spark.createDataFrame([(f"f{i}", *r) for i, r in enumerate(rows)], "id string, entity string, attribute string, txt string, valid_from long, valid_to long")
    return df.select("id", "entity", "attribute", F.lit("t").alias("entity_type"), F.lit("string").alias("vtype"), V.struct(F.col("txt"), V.TEXT).alias("v"), "valid_from", "valid_to")


def test_violations_pair_no_fact_with_all_edges_of_its_key(spark):
    from factloom.operators import constraints as C

    # Two entities hold x over [2, 5) and [6, 7); overlapping spans of one entity count once, and keep their edges.
    facts = facts_of(spark, ("a", ":p", "x", 0, 4), ("a", ":p", "x", 3, 5), ("a", ":p", "x", 6, None), ("b", ":p", "x", 2, 7))
    got = C.violations(facts, [C.Unique("t", ":p"), C.Cardinality("t", ":p", 1)])
    want = {("Unique", t, 2) for t in (2, 3, 4, 6)} | {("Cardinality", 3, 2)}
    assert {(r["kind"], r["at"], r["size"]) for r in got.collect()} == want
    assert "Join" not in plan(C.violations(facts, [C.Required("t", ":q"), C.Cardinality("t", ":p", 1)]))


def test_cuts_compare_only_what_flipped_and_gather_no_values(spark, store):
    from factloom.functions.basis import Basis, visible
    from factloom.operators import snapshots as N

    a = store.transact([P("a", ":p/name", "Ann"), P("b", ":p/name", "Bob"), P("b", ":p/mail", "x"), P("c", ":p/mail", "y")]).ids
    store.transact([{"op": "retract", "id": a[0]}, {"op": "retract", "id": a[2]}, {"op": "retract", "id": a[3]}, P("a", ":p/name", "Eve"), P("b", ":p/tag", "t"), P("c", ":p/mail", "y")])
    cut = [Basis(position=p) for p in (1, 2)]
    got, whole = N.cuts(store.facts(), *cut), N.diff(*[store.facts().where(visible(c)) for c in cut])
    want = {("a", ":p/name", "changed"), ("b", ":p/mail", "removed"), ("b", ":p/tag", "added")}
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in whole.collect()} == want
    assert "collect_" not in plan(got) + plan(whole) and "LeftSemi" in plan(got)


def test_many_to_many_joins_are_dealt_in_cells(spark, monkeypatch):
    from factloom.plans import compile as P
    from factloom.sources.facts import FactBase, lift

    monkeypatch.setattr(P, "CELL", (3, 2), raising=False)
    base = FactBase(spark, [lift(spark.range(n).withColumn("k", F.col("id") % 2), kind, F.col("id"), mark="k:number") for kind, n in (("a", 20), ("b", 10))])
    df = base.query({"find": ["?a", "?b"], "where": [["?a", ":a/mark", "?k"], ["?b", ":b/mark", "?k"]]})
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == sorted((f"a:{i}", f"b:{j}") for i in range(20) for j in range(10) if i % 2 == j % 2)
    assert df.rdd.getNumPartitions() == 4  # all shuffle partitions, though the sides have a few bytes only
