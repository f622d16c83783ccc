"""Binary rules, joined to a fixpoint level by level: only what the last level found is joined again.

A call whose first argument is a constant, or a variable that patterns bind, follows edges from those values; one whose
second argument is, starts from the pairs that end there. Only else the whole relation is derived.

Each level is written once, as a Parquet table in the folder that all executors share; what was seen is the union of the
levels and is never written again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.functions.lineage import Folder
from factloom.plans import ast as A

#: Levels that one plan follows from given values before it is written.
STRIDE = 4


def _pairs(compiler, patterns: list[A.Pattern], left: A.Var, right: A.Var) -> DataFrame:
    """(x, y) texts of a chain of patterns; numbers and booleans are no identities and drop out."""
    rel = compiler.conjunction(compiler.relations(patterns))
    out = []
    for v in (left, right):
        family = rel.binds[v].family
        c = rel.col(v)
        out.append(c if family == V.TEXT else V.part(c, V.TEXT) if family is None else F.lit(None).cast("string"))
    df = rel.df.select(out[0].alias("x"), out[1].alias("y"))
    return df.where("x IS NOT NULL AND y IS NOT NULL").distinct()


def pairs_of(compiler, rule: str, starts: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """All (x, y) of a rule, or those from the values of ``starts`` (n), or to those of ``ends`` (n)."""
    spark = compiler.base.spark
    rules = [r for r in compiler.q.rules if r.name == rule]
    base = [_pairs(compiler, list(r.body), r.body[0].entity, r.body[-1].value) for r in rules if not any(isinstance(c, A.RuleCall) for c in r.body)]
    steps = [_pairs(compiler, [r.body[0]], r.body[0].entity, r.body[0].value) for r in rules if any(isinstance(c, A.RuleCall) for c in r.body)]
    if not base:
        return spark.createDataFrame([], "x string, y string")
    base = reduce(DataFrame.union, base).distinct()
    if steps:
        depth, folder = max(r.max_depth for r in rules), Folder(spark, "rule")
        edges = folder.write(reduce(DataFrame.union, steps).distinct(), "edges")[0]
        if starts is not None:
            base = _forward(folder, base, edges, starts, depth)
        else:
            base = _closure(folder, base if ends is None else base.join(ends.withColumnRenamed("n", "y"), "y", "left_semi"), edges, depth)
    if starts is not None:
        base = base.join(starts.withColumnRenamed("n", "x"), "x", "left_semi")
    return base.select("x", "y") if ends is None else base.join(ends.withColumnRenamed("n", "y"), "y", "left_semi").select("x", "y")


def _closure(folder: Folder, base: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """Level k has the pairs first found over k edges before a base pair."""
    delta, n = folder.write(base, "level-0")
    for k in range(1, depth + 1):
        if not n:
            break
        seen = folder.read("level-*", delta.schema)
        new = edges.join(delta.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select("x", F.col("z").alias("y")).distinct()
        delta, n = folder.write(new.join(seen, ["x", "y"], "left_anti"), f"level-{k}")
    return folder.read("level-*", delta.schema)


def _forward(folder: Folder, base: DataFrame, edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Level k has the (x, n) with n first reached from the start x over k edges; a base pair of any n ends the path.

    A stride of levels is one plan; only its last level is followed on.
    """
    level = starts.distinct().select(F.col("n").alias("x"), "n", F.lit(0).alias("d"))
    last, n = folder.write(level, "from-0")
    k = 0
    while n and k < depth:
        stride, step, found = min(STRIDE, depth - k), last, []
        for i in range(1, stride + 1):
            step = edges.select(F.col("x").alias("n"), F.col("y").alias("m")).join(step.select("x", "n"), "n").select("x", F.col("m").alias("n")).distinct()
            found.append(step.withColumn("d", F.lit(k + i)))
        seen = folder.read("from-*", last.schema)
        new = reduce(DataFrame.union, found).groupBy("x", "n").agg(F.min("d").alias("d")).join(seen.select("x", "n"), ["x", "n"], "left_anti")
        k += stride
        got, n = folder.write(new, f"from-{k}", F.col("d") == k)
        last = got.where(F.col("d") == k)
    reached = folder.read("from-*", last.schema).select(F.col("x").alias("s"), "n")
    return base.join(reached, base["x"] == reached["n"]).select(F.col("s").alias("x"), "y").distinct()


def call(compiler, c: A.RuleCall, bound=None):
    """The relation of a call; ``bound`` is what patterns bind."""
    from factloom.plans.compile import Operand, Rel

    def given(t) -> DataFrame | None:
        if isinstance(t, str):
            return compiler.base.spark.createDataFrame([(t,)], "n string")
        if bound is None or t not in bound.binds:
            return None
        family = bound.binds[t].family
        value = bound.col(t) if family == V.TEXT else V.part(bound.wide(t), V.TEXT)
        return bound.df.select(value.alias("n")).where("n IS NOT NULL").distinct()

    df = pairs_of(compiler, c.name, given(c.left), given(c.right))
    for t, column in ((c.left, "x"), (c.right, "y")):
        if isinstance(t, str):
            df = df.where(F.col(column) == t)
    places = [(t, Operand(F.col(column), V.TEXT, False)) for t, column in ((c.left, "x"), (c.right, "y")) if isinstance(t, A.Var)]
    rel = compiler.project(df, [], places)
    return Rel(rel.df, rel.binds, frozenset(rel.binds))


__all__ = ["STRIDE", "call", "pairs_of"]
