"""Mixing sources to target weights by weighted fair queueing.

Each source shuffles its documents by a hash of their ids. A document's copies (pass 0, 1, 2) queue behind one another;
a copy's virtual finish time is the source's tokens through it, divided by the source's target. All queued copies are
range-sorted by finish time and taken while the total fits the budget. A source queues a copy only as long as its target
isn't reached before that copy starts.

Edge cases: a null source is a source of its own, last in order; a null or empty text has size 0, and is never taken
more than for 0 words; a very long text is one copy like any other, left out where the rest of the budget is less. Equal
finish times go by source, then by the shuffle; rows of one id by size. Repeated rows queue once each. Without any words
all targets and takes are 0, and an empty table gives no rows. Other columns are ignored, whatever their names, but for
the one named as ``key``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import Scratch, running_totals

WEIGHTS, MAX_PASSES = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text):
    """Number of words; null has none. JVM-side, without a list of the words: a break then a non-space starts each."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size, target) from (source, size). One row for each source; windows over them see no documents.

    With level x, a source's target is min(max_passes * its size, x * its weight); x is where the targets add up to all
    sizes. Sorted by the level at which each is capped, that level follows from two running sums.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(max_passes)) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    done = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_cap0", F.coalesce(F.sum("cap").over(done), F.lit(0.0))).withColumn("_w0", F.coalesce(F.sum("weight").over(done), F.lit(0.0)))
    s = s.withColumn("_all", F.sum(F.col("source_size").cast("double")).over(everything)).withColumn("_w", F.sum("weight").over(everything))
    s = s.withColumn("_level", (F.col("_all") - F.col("_cap0")) / (F.col("_w") - F.col("_w0")))
    s = s.withColumn("_level", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("_level").alias("x")))).over(everything)["x"])
    return s.select("source", "source_size", F.least("cap", F.col("_level") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, max_passes: int = MAX_PASSES, seed: str = "", key: str | None = None) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) and the column ``key``, if named, for each row of docs (doc_id, text, source)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words(F.col("text")).alias("size"), order.alias("_order"), *([key] if key else []))
    rows = running_totals(sized, scratch, "shuffled", ["source"], [F.col("_order"), F.col("doc_id").asc_nulls_last(), F.col("size")], "size", "_through")
    rows = scratch.table(rows, "totals")
    t = scratch.table(source_targets(rows.select("source", "size"), weights, max_passes), "targets")
    t = t.select(F.col("source").alias("_source"), "source_size", "target")
    rows = rows.join(t, rows["source"].eqNullSafe(t["_source"])).drop("_source")
    copies = rows.where("size > 0").withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))))
    through = F.col("_pass") * F.col("source_size") + F.col("_through")
    copies = copies.where((through - F.col("size")).cast("double") < F.col("target"))
    copies = copies.select("doc_id", "source", "size", "_order", "_through", "_pass", (through.cast("double") / F.col("target")).alias("_finish"))
    queue = running_totals(copies, scratch, "queue", [], [F.col("_finish"), F.col("source").asc_nulls_last(), F.col("_order"), F.col("_through"), F.col("_pass"), F.col("doc_id").asc_nulls_last()], "size", "_spent")
    budget = rows.agg(F.sum("size").alias("_budget"))
    taken = queue.crossJoin(F.broadcast(budget)).where("_spent <= _budget")  # one row
    taken = taken.groupBy("doc_id", "source", "_through").agg(F.sum("size").alias("taken"))
    taken = taken.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("_through").alias("_t"), "taken")
    out = rows.join(taken, rows["doc_id"].eqNullSafe(taken["_d"]) & rows["source"].eqNullSafe(taken["_s"]) & (rows["_through"] == taken["_t"]) & (rows["size"] > 0), "left")
    return out.select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), *([key] if key else []))
