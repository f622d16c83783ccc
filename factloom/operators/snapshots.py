"""Snapshots of entities: their attributes as one map with a content hash, compared across cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.basis import Basis, visible
from factloom.functions.lineage import Folder


def snapshot(facts: DataFrame) -> DataFrame:
    """(entity, attributes, hash) of visible facts; equal contents have equal hashes, whatever their facts' ids."""
    one = facts.groupBy("entity", "attribute").agg(F.sort_array(F.collect_list(F.struct("vtype", "v"))).alias("values"))
    rows = one.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("attribute", "values"))).alias("attributes"))
    return rows.withColumn("hash", F.sha2(F.to_json("attributes"), 256))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(entity, attribute, change): what differs between the visible facts of two cuts.

    Values are counted on both sides, not gathered, so no buffer grows with an attribute's values.
    """
    value = F.to_json(F.struct("vtype", "v")).alias("value")
    side = lambda df, a, b: df.select("entity", "attribute", value, F.lit(a).alias("_a"), F.lit(b).alias("_b"))
    both = side(before, 1, 0).unionByName(side(after, 0, 1)).repartition("entity", "attribute")
    one = both.groupBy("entity", "attribute", "value").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    sums = one.groupBy("entity", "attribute").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"), F.bool_or(F.col("_a") != F.col("_b")).alias("_differs"))
    change = F.when(F.col("_a") == 0, "added").when(F.col("_b") == 0, "removed").otherwise("changed")
    return sums.where("_differs").select("entity", "attribute", change.alias("change"))


def cuts(facts: DataFrame, before: Basis, after: Basis) -> DataFrame:
    """The same of two cuts of one history. Only entities' attributes with a fact that is visible at one cut alone are compared."""
    a, b = F.coalesce(visible(before), F.lit(False)), F.coalesce(visible(after), F.lit(False))
    flipped, _ = Folder(facts.sparkSession, "cuts").write(facts.where(a != b).select("entity", "attribute").distinct(), "flipped")
    near = facts.where(a | b).join(flipped, ["entity", "attribute"], "left_semi")
    return diff(near.where(a), near.where(b))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(entity, before, after): hashes of entities whose content differs."""
    a, b = snapshot(before).select("entity", F.col("hash").alias("before")), snapshot(after).select("entity", F.col("hash").alias("after"))
    return a.join(b, "entity", "full").where(~F.col("before").eqNullSafe(F.col("after")))


def find_by_hash(snapshots: DataFrame, digest: str) -> DataFrame:
    return snapshots.where(F.col("hash") == digest)


# Of a store, at its cuts.


def at(store, ids: list[str] | None = None, position: int | None = None, recorded_at: int | None = None) -> DataFrame:
    """Snapshots of some entities, or of all, at a position or a recorded moment; the head if neither is given. All valid times count."""
    facts = store.facts()
    facts = facts if ids is None else facts.where(F.col("entity").isin(ids))
    basis = Basis.of(recorded_at=recorded_at, position=position if position is not None or recorded_at is not None else store.head())
    return snapshot(facts.where(visible(basis)))


def hashes(store, entity: str) -> DataFrame:
    """(position, tx_id, instant, hash): an entity's content after each transaction that touched it; hash null once it is gone."""
    touched = store.changes().where(F.col("entity") == entity).select("position").distinct()
    history = store.history(entity)
    # Its facts beside each of its own positions only.
    held = touched.join(history, (F.col("recorded_position") <= F.col("position")) & (F.col("retracted_position").isNull() | (F.col("retracted_position") > F.col("position"))))
    one = held.groupBy("position", "attribute").agg(F.sort_array(F.collect_list(F.struct("vtype", "v"))).alias("values"))
    rows = one.groupBy("position").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("attribute", "values")))), 256).alias("hash"))
    return touched.join(rows, "position", "left").join(store.transactions().select("position", "tx_id", "instant"), "position").select("position", "tx_id", "instant", "hash")


def find_changed(store, since: int) -> DataFrame:
    """(entity, hash) of entities that transactions behind a position have touched, as they are now."""
    touched = store.changes().where(F.col("position") > since).select("entity").distinct()
    return snapshot(store.facts().where(visible(Basis.of(position=store.head()))).join(touched, "entity", "left_semi")).select("entity", "hash")


def checkpoint(store, recorded_at: int) -> DataFrame:
    """(entity, hash) of all entities at a recorded moment."""
    return at(store, recorded_at=recorded_at).select("entity", "hash")
