"""Rules of three values over entities: SQL's own three-valued logic, evaluated for all subjects at once.

Expressions: ("lit", b), ("exists", attr), ("eq", attr, scalar), ("before", attr, "day"|"instant"), ("rule", name), ("not", e),
("all", [e]), ("any", [e]). A missing fact makes eq and before unknown (null), and exists false. A rule that calls itself
is unknown.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import values as V

DAY = 86_400_000


def attributes(e: tuple, rules: dict[str, tuple], seen: frozenset = frozenset()) -> set[str]:
    kind = e[0]
    if kind in ("exists", "eq", "before"):
        return {e[1]}
    if kind == "not":
        return attributes(e[1], rules, seen)
    if kind in ("all", "any"):
        return set().union(*(attributes(x, rules, seen) for x in e[1])) if e[1] else set()
    if kind == "rule" and e[1] in rules and e[1] not in seen:
        return attributes(rules[e[1]], rules, seen | {e[1]})
    return set()


def condition(e: tuple, value: dict[str, Column], rules: dict[str, tuple], now: int, seen: frozenset = frozenset()) -> Column:
    """A nullable Boolean Column; ``value`` has the struct of each attribute, null where there is no fact."""
    kind, unknown = e[0], F.lit(None).cast("boolean")
    if kind == "lit":
        return F.lit(e[1]).cast("boolean")
    if kind == "exists":
        return value[e[1]].isNotNull()
    if kind == "eq":
        return F.when(value[e[1]].isNotNull(), value[e[1]] == V.literal(e[2]))
    if kind == "before":
        size = {"day": DAY, "instant": 1}[e[2]]
        return F.floor(V.part(value[e[1]], V.NUMBER) / size) < F.lit(now // size)
    if kind == "rule":
        if e[1] in seen or e[1] not in rules:
            return unknown
        return condition(rules[e[1]], value, rules, now, seen | {e[1]})
    if kind == "not":
        return ~condition(e[1], value, rules, now, seen)
    parts = [condition(x, value, rules, now, seen) for x in e[1]]
    if kind == "all":
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    if kind == "any":
        return reduce(lambda a, b: a | b, parts, F.lit(False))
    raise ValueError(f"no expression {kind!r}")


def evaluate(facts: DataFrame, subjects: DataFrame, rules: dict[str, tuple], now: int) -> DataFrame:
    """(entity, a Boolean column for each rule) for subjects (entity); ``facts`` (entity, attribute, v) are visible ones.

    One aggregation brings all needed attributes beside each subject. An attribute with several facts raises.
    """
    need = sorted(set().union(*(attributes(e, rules) for e in rules.values())) if rules else set())
    picked = facts.where(F.col("attribute").isin(need)).groupBy("entity", "attribute").agg(F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("several values: "), F.first("entity"), F.lit(" "), F.first("attribute")))).otherwise(F.first("v")).alias("v"))
    wide = picked.groupBy("entity").agg(*[F.first(F.when(F.col("attribute") == a, F.col("v")), ignorenulls=True).alias(f"_{i}") for i, a in enumerate(need)] or [F.lit(1).alias("_none")])
    rows = subjects.select("entity").join(wide, "entity", "left")
    value: dict[str, Any] = {a: F.col(f"_{i}") for i, a in enumerate(need)}
    return rows.select("entity", *[condition(("rule", n), value, rules, now).alias(n) for n in rules])


def impact(facts: DataFrame, subjects: DataFrame, old: dict[str, tuple], new: dict[str, tuple], now: int) -> DataFrame:
    """(entity, rule, before, after) where publishing ``new`` would change an answer."""
    both = sorted(set(old) & set(new))
    a, b = evaluate(facts, subjects, old, now), evaluate(facts, subjects, new, now)
    joined = a.select("entity", *[F.col(n).alias(f"_a_{n}") for n in both]).join(b.select("entity", *[F.col(n).alias(f"_b_{n}") for n in both]), "entity")
    rows = joined.select("entity", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_a_{n}").alias("before"), F.col(f"_b_{n}").alias("after")) for n in both])).alias("r"))
    return rows.select("entity", "r.*").where(~F.col("before").eqNullSafe(F.col("after")))


# Answers with what they rest on.


def observed(e: tuple, rules: dict[str, tuple], seen: frozenset = frozenset()) -> set[tuple]:
    """What an expression looks at: ("fact", attribute), ("clock", granularity) and ("rule", name)."""
    kind = e[0]
    if kind in ("exists", "eq"):
        return {("fact", e[1])}
    if kind == "before":
        return {("fact", e[1]), ("clock", e[2])}
    if kind == "not":
        return observed(e[1], rules, seen)
    if kind in ("all", "any"):
        return set().union(*(observed(x, rules, seen) for x in e[1])) if e[1] else set()
    if kind == "rule":
        inner = observed(rules[e[1]], rules, seen | {e[1]}) if e[1] in rules and e[1] not in seen else set()
        return {("rule", e[1])} | inner
    return set()


def answers(facts: DataFrame, subjects: DataFrame, rules: dict[str, tuple], now: int, cache: DataFrame | None = None) -> DataFrame:
    """(entity, rule, truth, closure, hit) for each subject and rule.

    ``closure`` hashes the rule's definition with those it calls, the values it looked at and the clock's buckets: answers
    of one closure are equal. With a ``cache`` of earlier answers (rule, closure, truth), those found there are hits.
    """
    need = sorted(set().union(*(attributes(e, rules) for e in rules.values())) if rules else set())
    values = facts.where(F.col("attribute").isin(need)).groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("attribute", F.to_json("v")))).alias("_read"))
    rows = evaluate(facts, subjects, rules, now).join(values, "entity", "left")
    out = []
    for n in rules:
        look = observed(("rule", n), rules)
        fixed = sorted(f"{k}={rules.get(k)!r}" for kind, k in look if kind == "rule") + sorted(f"{g}={now // {'day': DAY, 'instant': 1}[g]}" for kind, g in look if kind == "clock")
        read = [F.coalesce(F.col("_read")[a], F.lit("-")) for a in sorted(a for kind, a in look if kind == "fact")]
        closure = F.sha2(F.concat_ws("\u0001", *[F.lit(x) for x in fixed], *read), 256)
        out.append(F.struct(F.lit(n).alias("rule"), F.col(n).alias("truth"), closure.alias("closure")))
    rows = rows.select("entity", F.explode(F.array(*out)).alias("r")).select("entity", "r.*")
    if cache is None:
        return rows.withColumn("hit", F.lit(False))
    known = cache.select("rule", "closure", F.col("truth").alias("_known"), F.lit(True).alias("_hit")).dropDuplicates(["rule", "closure"])
    rows = rows.join(known, ["rule", "closure"], "left").withColumn("hit", F.coalesce("_hit", F.lit(False)))
    return rows.select("entity", "rule", F.when(F.col("hit"), F.col("_known")).otherwise(F.col("truth")).alias("truth"), "closure", "hit")


def replay(recorded: DataFrame, facts: DataFrame, rules: dict[str, tuple], now: int) -> DataFrame:
    """(entity, rule, verdict) of recorded answers looked at again: same; moved, if an input has changed; wrong, if none has but the truth differs."""
    again = answers(facts, recorded.select("entity").distinct(), rules, now).select("entity", "rule", F.col("truth").alias("_t"), F.col("closure").alias("_c"))
    both = recorded.join(again, ["entity", "rule"], "left")
    verdict = F.when(~F.col("closure").eqNullSafe(F.col("_c")), "moved").when(~F.col("truth").eqNullSafe(F.col("_t")), "wrong").otherwise("same")
    return both.select("entity", "rule", verdict.alias("verdict"))
