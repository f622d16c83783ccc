"""Tables written between stages, and running totals that need no single task."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.words import pieces, release


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a session on one machine may do without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the session was started; on a cluster it's installed or in a shared path."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


class Scratch:
    """Parquet tables of one query in the shared folder. They cut lineage and survive lost executors; the folder goes with the driver."""

    def __init__(self, spark: SparkSession, name: str):
        importable(spark)
        self.spark, self.root = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)  # what isn't there can't be marked
        fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that no later stage reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_totals(df: DataFrame, scratch: Scratch, name: str, group: list[str], order: list, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` (long) from the first row of its group through this row, in the given total order.

    Rows are range-sorted by group and order, so a group of any size spreads over many partitions. Each partition sums
    its own rows; one small table (a row for each partition and group in it) carries the sums before it. ``order`` must
    be a total order within the group. Null groups are groups of their own.
    """
    spark = df.sparkSession
    keys = [F.col(g).asc_nulls_last() for g in group]
    # The range-sorted rows are written once: sampled range bounds must not be drawn twice.
    dealt = df.repartitionByRange(partitions(spark), *keys, *order).withColumn("_p", F.spark_partition_id())
    dealt = scratch.table(dealt.sortWithinPartitions(*keys, *order), name)
    local = Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = dealt.groupBy("_p", *group).agg(F.sum(value).alias("_sum"))
    before = sums.select("_p", *group, (F.sum("_sum").over(Window.partitionBy(*group).orderBy("_p")) - F.col("_sum")).alias("_before"))
    before = before.select(F.col("_p").alias("_q"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_before")
    inside = dealt.withColumn("_inside", F.sum(value).over(local))
    match = inside["_p"] == before["_q"]
    for i, g in enumerate(group):
        match = match & inside[g].eqNullSafe(before[f"_g{i}"])
    return inside.join(before, match).withColumn(out, F.col("_inside") + F.col("_before")).drop("_p", "_q", "_inside", "_before", *[f"_g{i}" for i in range(len(group))])


#: Bits of the largest filter as a power of two: 32 MB.
MOST_BITS = 28


def sieve(keys: DataFrame, column: str, log_bits: int | None = None):
    """A Bloom filter of a long column, as a function from a long Column to a Boolean one: false only for values that aren't there.

    ``keys`` is a written table. The filter has 8 to 16 bits a key, 2**20 at least and 2**MOST_BITS at most, so it can be
    broadcast whatever the data; beyond some 100 million keys it lets more pass, which costs work and no results.
    """
    spark = keys.sparkSession
    if log_bits is None:
        log_bits = min(max((8 * keys.count()).bit_length(), 20), MOST_BITS)
    spots = F.explode(F.array(*[F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(1 << log_bits)) for k in (1, 2)]))
    words = keys.select(spots.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    got = words.toArrow()  # 2**(log_bits - 6) rows at most
    table = np.zeros(1 << (log_bits - 6), np.int64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    sent = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def there(a: pd.Series, b: pd.Series) -> pd.Series:
        t, out = sent.value, True
        for at in (a.to_numpy(), b.to_numpy()):
            out = out & ((t[at >> 6] >> (at & 63)) & 1 == 1)
        return pd.Series(out)

    return lambda c: there(*[F.pmod(F.xxhash64(c, F.lit(k)), F.lit(1 << log_bits)) for k in (1, 2)])


def classified(rows: DataFrame, key: str, marks: DataFrame, column: str) -> DataFrame:
    """rows with ``column`` of marks (key long, column), a written table that has each row's key once and few values of the column.

    Each value has a sieve of its keys. The keys that one sieve alone lets pass have its value for sure, so only rows whose
    keys several let pass, a few hundredths of all, are shuffled to be joined; the others, however wide, stay where they are.
    """
    marks = marks.select(F.col(key).alias("_marked"), column)
    values = sorted(r[0] for r in marks.select(column).distinct().collect())
    if not values:
        return rows.withColumn(column, F.lit(None).cast(marks.schema[column].dataType)).limit(0)
    tests = {v: sieve(marks.where(F.col(column) == v), "_marked") for v in values}
    tested = rows.withColumn("_pass", F.array(*[F.when(test(F.col(key)), F.lit(v)) for v, test in tests.items()])).withColumn("_pass", F.array_compact("_pass"))
    sure = tested.where(F.size("_pass") == 1).withColumn(column, F.col("_pass")[0].cast(marks.schema[column].dataType)).drop("_pass")
    return sure.unionByName(tested.where(F.size("_pass") > 1).drop("_pass").join(marks, F.col(key) == F.col("_marked")).drop("_marked"))


def frequent_grams(docs: DataFrame, n: int, lower: bool, at_least: int = 3, top: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and counts of frequent runs of n words of docs (text): those met ``at_least`` times in one batch.

    Serves to order runs by frequency, where any order gives right results; so the list may keep to ``top`` entries.
    """

    def count(batches):
        for batch in batches:
            found = [p.grams(n, p.hashes())[0] for p in pieces(batch.column("text"), lower)]
            if not found:
                continue
            x = np.concatenate(found)
            del found
            x.sort()
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
            times = np.diff(np.append(at, len(x)))
            keep = times >= at_least
            x, times = x[at[keep]], times[keep]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(times.astype(np.int64))], ["gram", "n"])
            release()

    sums = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    sums = Scratch(docs.sparkSession, "frequent").table(sums, "sums")
    level, held, least = F.floor(F.log2(F.col("n").cast("double")) * 8), 0, None
    for r in sums.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # 512 rows at most
        held += r["count"]
        if held > top:
            break
        least = r["level"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    got = sums.where(level >= least).toArrow()
    gram = got.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(gram)
    return gram[order], got.column("n").to_numpy()[order]
