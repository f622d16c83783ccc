"""Packing into optimal length buckets.

One exact histogram of lengths over the whole corpus goes to the driver. Distinct lengths of W words altogether number
at most sqrt(2 W), some 4 million for 10 trillion words, so its size is bounded far under the corpus's. Dynamic
programming over it chooses the bucket boundaries with the least padding, in time proportional to its size. Inside a
bucket, documents in hash order form batches whose padded size keeps to the token budget; places in a bucket come from
distributed running counts.

Edge cases: a null or empty text has length 0 and is in no batch (bucket, batch and place null). A document longer than
the budget is a batch of its own; a very long text is one length like any other. Fewer distinct lengths than buckets give
a bucket each. Of equally good boundaries the one with fewer buckets, then with the earlier cuts, is taken. Repeated rows
are packed once each; rows with equal ids and lengths change places at will. Columns named like results are replaced. An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.mixing import n_words
from factloom.llm.shared import Scratch, running_totals

BUCKETS, BUDGET = 16, 16_384


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> tuple[list[int], int]:
    """At most ``buckets`` of the ascending ``lengths`` as upper ends, the last among them, with the least padding; and that padding.

    With c documents and s tokens up to each length, a bucket over i..j pads (c[j] - c[i]) x lengths[j] - (s[j] - s[i]).
    So the best cut i below j lies on the lower envelope of the lines (slope -c[i], height cost[i] + s[i]) at lengths[j];
    slopes fall and places rise, so one walk along the envelope serves all j. Of equal cuts the earliest is taken, and
    another bucket only where it pads less.
    """
    n = len(lengths)
    if not n:
        return [], 0
    at = [int(x) for x in lengths]
    c, s = [0], [0]
    for length, k in zip(at, counts.tolist(), strict=True):
        c.append(c[-1] + k)
        s.append(s[-1] + k * length)
    cost = [0, *(c[j] * at[j - 1] - s[j] for j in range(1, n + 1))]
    cuts = []
    for _ in range(1, min(buckets, n)):
        new, cut = cost[:], [-1] * (n + 1)
        line, best = [], 0  # cuts on the envelope, and the best of them so far
        for j in range(1, n + 1):
            i, slope, height = j - 1, c[j - 1], cost[j - 1] + s[j - 1]
            while len(line) >= 2:
                (a, slope_a, height_a), (_, slope_b, height_b) = line[-2], line[-1]
                # b is nowhere under both neighbours
                if (height - height_a) * (slope_b - slope_a) <= (height_b - height_a) * (slope - slope_a):
                    line.pop()
                else:
                    break
            line.append((i, slope, height))
            best = min(best, len(line) - 1)
            x = at[j - 1]
            while best + 1 < len(line) and line[best + 1][2] - line[best + 1][1] * x < line[best][2] - line[best][1] * x:
                best += 1
            value = line[best][2] - line[best][1] * x + c[j] * x - s[j]
            if value < cost[j]:
                new[j], cut[j] = value, line[best][0]
        cuts.append(cut)
        cost = new
    ends, j = [], n
    for cut in reversed(cuts):
        if cut[j] >= 0:
            ends.append(at[j - 1])
            j = cut[j]
    if j > 0:
        ends.append(at[j - 1])
    return sorted(ends), cost[n]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, keep_text: bool = False) -> DataFrame:
    """docs (doc_id, text) with n_tokens, bucket_len (its bucket's upper end), batch_id (within the bucket), place and padding; other columns stay, the text if asked for."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    added = ("n_tokens", "bucket_len", "batch_id", "place", "padding")
    if clash := set(added) & set(docs.columns):
        docs = docs.drop(*clash)
    sized = docs.withColumn("n_tokens", n_words(F.col("text")))
    if not keep_text:
        sized = sized.drop("text")  # before rows are sorted
    hist = sized.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas().sort_values("n_tokens")  # sqrt(2 x words) rows at most
    ends, _ = boundaries(hist.n_tokens.to_numpy(), hist.n.to_numpy(), buckets)
    up = F.lit(None).cast("long")
    for end in reversed(ends):
        up = F.when(F.col("n_tokens") <= end, F.lit(end).cast("long")).otherwise(up)
    sized = sized.withColumn("bucket_len", F.when(F.col("n_tokens") > 0, up)).withColumn("_one", F.lit(1).cast("long"))
    order = [F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.col("doc_id").asc_nulls_last(), F.col("n_tokens")]
    out = running_totals(sized, scratch, "sorted", ["bucket_len"], order, "_one", "_at").drop("_one")
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    real = F.col("bucket_len").isNotNull()
    at = F.col("_at") - 1
    out = out.withColumn("batch_id", F.when(real, F.floor(at / fits))).withColumn("place", F.when(real, at % fits)).withColumn("padding", F.col("bucket_len") - F.col("n_tokens"))
    return out.drop("_at")
