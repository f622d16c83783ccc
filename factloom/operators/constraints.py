"""Constraints on the graph, judged at every edge of valid time.

Beginnings and ends are summed up for each key (an entity, a value, or a reference), so judging is linear in a key's facts,
never a product. A violation is a row (rule, kind, key, at, size).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import values as V

VIOLATION = "rule int, kind string, key string, at long, size long"
_EVER = -(1 << 62)
_NEVER = (1 << 63) - 1


@dataclass(frozen=True)
class Required:
    type: str
    attribute: str


@dataclass(frozen=True)
class Cardinality:
    type: str
    attribute: str
    max: int = 1


@dataclass(frozen=True)
class Unique:
    type: str
    attribute: str


@dataclass(frozen=True)
class ReferenceTarget:
    type: str
    attribute: str
    target_type: str


def _spans(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct (entity, valid_from, valid_to) under other names: the facts of an entity mostly share theirs."""
    return df.repartition("entity").select(*[F.col(c).alias(n) for c, n in zip(("entity", "valid_from", "valid_to"), columns, strict=True)]).distinct()


def _counts(df: DataFrame, key: str, few: bool = False, **counts: Column) -> DataFrame:
    """At each moment at which something of a key begins or ends, the sums of what holds there.

    A running sum over beginnings and ends, so its cost is linear in a key's rows. ``few``: keys are few and have many
    rows, which are then summed before they are dealt out.
    """
    lasts = F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to"))
    one = {n: F.when(lasts & F.coalesce(c, F.lit(False)), 1).otherwise(0) for n, c in counts.items()}
    rows = df.select(key, "valid_from", "valid_to", *[c.alias(n) for n, c in one.items()])
    rows = rows if few else rows.repartition(key)
    edge = lambda at, sign: F.struct(F.col(at).alias("at"), *[(F.col(n) * sign).alias(n) for n in counts])
    edges = rows.select(key, F.inline(F.filter(F.array(edge("valid_from", 1), edge("valid_to", -1)), lambda e: e["at"].isNotNull())))
    sums = edges.groupBy(key, "at").agg(*[F.sum(n).alias(n) for n in counts])
    so_far = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.select(key, "at", *[F.sum(n).over(so_far).alias(n) for n in counts])


def _merged(df: DataFrame) -> DataFrame:
    """(key, valid_from, valid_to, holds): an entity's spans of a key so that no two overlap; their own edges stay, where ``holds`` is false."""
    own = Window.partitionBy("key", "entity").orderBy("valid_from", F.col("valid_to").asc_nulls_last())
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce("valid_to", F.lit(_NEVER))
    rows = df.withColumn("_end", F.max(end).over(before))
    # What an earlier span covers adds no more than what reaches beyond it.
    rows = rows.withColumn("_from", F.greatest("valid_from", F.coalesce("_end", F.col("valid_from"))))
    span = lambda start, holds: F.struct(F.col(start).alias("valid_from"), F.col("valid_to").alias("valid_to"), holds.alias("holds"))
    whole = F.col("_from") == F.col("valid_from")
    return rows.select("key", F.inline(F.when(~whole & (F.col("_from") < end), F.array(span("valid_from", F.lit(False)), span("_from", F.lit(True)))).otherwise(F.array(span("valid_from", whole)))))


def violations(facts: DataFrame, rules: list) -> DataFrame:
    """``facts``: rows that are recorded and not retracted at the state to judge."""
    facts = facts.withColumn("valid_from", F.coalesce("valid_from", F.lit(_EVER)))
    out = []
    for i, r in enumerate(rules):
        typed, attr = F.col("entity_type") == r.type, F.col("attribute") == r.attribute
        if isinstance(r, (Required, Cardinality)):
            n = _counts(facts.where(typed | attr), "entity", typed=F.coalesce(typed, F.lit(False)), held=attr)
            bad = F.col("held") == 0 if isinstance(r, Required) else F.col("held") > r.max
            found = n.where((F.col("typed") > 0) & bad).select(F.col("entity").alias("key"), "at", F.when(F.lit(isinstance(r, Required)), 1).otherwise(F.col("held")).alias("size"))
        elif isinstance(r, Unique):
            own = facts.where(attr).select("entity", "v", "valid_from", "valid_to")
            kinds = _spans(facts.where(typed), "entity", "tf", "tt")
            # The spans in which an entity both has the value and the type.
            both = own.join(kinds, "entity").select("entity", "v", F.greatest("valid_from", "tf").alias("valid_from"), F.least("valid_to", "tt").alias("valid_to"))
            both = both.where("valid_to IS NULL OR valid_from < valid_to").withColumn("key", F.to_json("v")).select("key", "entity", "valid_from", "valid_to")
            found = _counts(_merged(both), "key", few=True, size=F.col("holds")).where("size > 1")
        else:
            refs = facts.where(attr & (F.col("vtype") == "ref") & F.col("v.txt").isNotNull()).select("entity", F.col("v.txt").alias("target"), "valid_from", "valid_to")
            owner = _spans(facts.where(typed), "entity", "tf", "tt")
            refs = refs.join(owner, "entity").select(F.concat_ws(" -> ", "entity", "target").alias("key"), "target", F.greatest("valid_from", "tf").alias("valid_from"), F.least("valid_to", "tt").alias("valid_to"), F.lit(False).alias("is_target"))
            refs = refs.where("valid_to IS NULL OR valid_from < valid_to")
            targets = _spans(facts.where(F.col("entity_type") == r.target_type), "target", "valid_from", "valid_to")
            targets = refs.select("key", "target").distinct().join(targets, "target").select("key", "target", "valid_from", "valid_to", F.lit(True).alias("is_target"))
            n = _counts(refs.unionByName(targets), "key", refs=~F.col("is_target"), targets=F.col("is_target"))
            found = n.where("refs > 0 AND targets = 0").select("key", "at", F.lit(1).alias("size"))
        out.append(found.select(F.lit(i).alias("rule"), F.lit(type(r).__name__).alias("kind"), "key", "at", F.col("size").cast("long")))
    if not out:
        return facts.sparkSession.createDataFrame([], VIOLATION)
    return reduce(DataFrame.unionByName, out)


def relevant(facts: DataFrame, touched: DataFrame, rules: list) -> DataFrame:
    """(entity): those whose facts a commit that touches some entities can set against each other.

    An entity meets those that hold its values of unique attributes, those that refer to it, and those it refers to.
    Facts of the rest are the same before and after. A value or target that is shared by many is found by a join, so its
    holders come once.
    """
    out = [touched.select("entity")]
    unique = [r.attribute for r in rules if isinstance(r, Unique)]
    refs = [r.attribute for r in rules if isinstance(r, ReferenceTarget)]
    if unique:
        held = facts.where(F.col("attribute").isin(unique)).select("entity", "attribute", "v")
        out.append(held.join(held.join(touched, "entity", "left_semi").select("attribute", "v").distinct(), ["attribute", "v"], "left_semi").select("entity"))
    if refs:
        held = facts.where(F.col("attribute").isin(refs) & (F.col("vtype") == "ref")).select("entity", F.col("v.txt").alias("target"))
        out.append(held.join(touched.withColumnRenamed("entity", "target"), "target", "left_semi").select("entity"))
        # Of all entities so far: a holder that refers elsewhere is judged with its targets, before as after.
        out.append(held.join(reduce(DataFrame.unionByName, out).distinct(), "entity", "left_semi").select(F.col("target").alias("entity")))
    return reduce(DataFrame.unionByName, out).distinct()


def worsened(before: DataFrame, after: DataFrame) -> DataFrame:
    """Violations that are new or larger; those that were there already are tolerated.

    A violation's place in time is where it begins, so the state before is taken at the same moment or the last edge
    before it.
    """
    old = before.select("rule", F.col("key"), F.col("size").alias("_old")).groupBy("rule", "key").agg(F.max("_old").alias("_most"))
    same = before.select("rule", "key", "at", F.col("size").alias("_same"))
    joined = after.join(same, ["rule", "key", "at"], "left").join(old, ["rule", "key"], "left")
    return joined.where(F.col("size") > F.coalesce("_same", "_most", F.lit(0))).select(*after.columns)


__all__ = ["Cardinality", "ReferenceTarget", "Required", "Unique", "V", "relevant", "violations", "worsened"]
