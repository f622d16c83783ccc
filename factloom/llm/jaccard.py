"""Near-duplicate join on the Jaccard similarity of word shingles, by grouped prefixes.

1. Shingles are ordered rare to frequent (frequent ones by counts within batches; any one order gives right results).
   Two sets that are similar enough share ``COMMON`` shingles among the first n - ceil(t n) + COMMON of each.
2. Documents with the same prefix and set size are one group, so copies cost one group; only groups travel, as packed
   (shingle, group) entries.
3. The groups that share a shingle are a bucket. A group that shares too few shingles with all others goes; of a group's
   largest buckets, those that can't suffice for a pair serve to count and not to join. Pairs of groups are filtered by
   their sizes, the places of the shared shingles and how many they share; only pairs that pass expand to the groups' distinct sets.
4. Each group first meets one leader, the least of those its buckets offer, and its sets the first set of the group; whole
   shingle sets are compared, and links give components. While more pairs than entries hold sets of different
   components, and each turn halves them, groups meet some further leaders, drawn anew in each turn. Then pairs of groups that still hold sets
   of different components meet in blocks of bounded size; their sets are compared unless parity bitmaps prove too great a
   difference. A large group of near copies thus costs some stars and not its square, and no pair that could connect two
   components is left out. Groups that share much and are not similar may still cost their square.
5. Copies join the component of their set at the end.

Shingles are 64-bit hashes (6 bits of frequency, 58 of hash); sets are told apart by 128 bits. The number of parts that
entries are dealt to grows with their number, so a part stays at some ``PART`` entries whatever the corpus.

Edge cases: documents without words, or with a null text, have no shingles and no links. A null id takes no part and
gets component_id null. A row that occurs twice gives two equal results; rows of one id but different texts keep their
own n_shingles and may share each other's links. Ties don't arise: the smallest id names a component. A text of any length is one set of all its shingles. An
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.components import connected
from factloom.llm.shared import Scratch, frequent_grams, partitions, sieve
from factloom.llm.words import Piece, gram_hash, mix, pieces, release

SHINGLE, PERCENT = 5, 75
#: Shingles that prefixes of similar sets share at least (all that must be shared, in small sets).
COMMON = 4
#: Frequent shingles of this level (1 + 3 for each doubling of the count) or more skip the gathering by shingle: they go to the leaders at once.
HOT_LEVEL = 24
#: Entries in a part, members of a bucket on one side of a block pair, and longs in a set's parity bitmap.
PART, SIDE, BITS = 1 << 21, 256, 8
#: Leaders of a bucket and class in a turn, and the most that a group tries; pairs for each entry that need no turn.
TRIES, FEW = 4, 1
#: Hot buckets count as larger than all others.
HOT_SIZE = 1 << 30


class Order:
    """Shingle keys whose numeric order is rare to frequent: 6 bits of level, 58 of hash."""

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        self.gram, self.level = gram, np.minimum(np.log2(np.maximum(count, 2)) * 3, 62).astype(np.uint64) + np.uint64(1)

    def key(self, grams: np.ndarray) -> np.ndarray:
        level = np.zeros(len(grams), np.uint64)
        if len(self.gram):
            at = np.minimum(np.searchsorted(self.gram, grams), len(self.gram) - 1)
            hit = self.gram[at] == grams
            level[hit] = self.level[at[hit]]
        return (level << np.uint64(58)) | (grams >> np.uint64(6))


def shingle_sets(p: Piece, order: Order, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle keys of each document, ascending, one document after another; and each one's bounds in them."""
    hashes = p.hashes()
    grams, at = p.grams(n, hashes)
    doc = p.doc[at]
    count = np.diff(p.first_word)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):  # the whole sequence is the one shingle
        extra = np.array([gram_hash(hashes[p.first_word[d] : p.first_word[d + 1]], int(count[d]))[0] for d in short]) + count[short].astype(np.uint64)
        grams, doc = np.concatenate([grams, mix(extra)]), np.concatenate([doc, short])
    key = order.key(grams)
    by = np.argsort(key)
    by = by[np.argsort(doc[by], kind="stable")]
    key, doc = key[by], doc[by]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    return key, np.searchsorted(doc, np.arange(p.n_docs + 1))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    least = -(-n * percent // 100)  # what any partner shares
    return n - least + np.minimum(least, COMMON)


def digests(key: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(size, two hashes of the set, hash of prefix and size) of each document."""
    n = np.diff(bounds)
    with np.errstate(over="ignore"):
        sums = []
        for x in (mix(key), mix(key ^ np.uint64(0x5BD1E995B6A7C1F3))):
            s = np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
            sums.append(s)
        first, second = (mix(s[bounds[1:]] - s[bounds[:-1]] + n.astype(np.uint64)) for s in sums)
        end = bounds[:-1] + prefix_length(n, percent)
        group = mix(sums[0][end] - sums[0][bounds[:-1]] + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return n, first, second, group


def parity(key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A bitmap of BITS longs of each document: each shingle turns one bit. Bitmaps differ in no more bits than sets in shingles."""
    n, width = len(bounds) - 1, 64 * BITS
    at = np.repeat(np.arange(n), np.diff(bounds)) * width + (mix(key) % np.uint64(width)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * width) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(n, BITS)


def _sets(order, percent: int, n: int):
    def sets(batches):
        for batch in batches:
            for p in pieces(batch.column("text"), lower=True):
                key, bounds = shingle_sets(p, order.value, n)
                size, a, b, g = digests(key, bounds, percent)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(p.first, p.n_docs), pa.array(size.astype(np.int64)), *[pa.array(x.view(np.int64)) for x in (a, b, g)], pa.FixedSizeListArray.from_arrays(pa.array(parity(key, bounds).ravel()), BITS).cast(pa.list_(pa.int64()))], ["doc_id", "n_shingles", "fp1", "fp2", "grp", "bits"])
            release()

    return sets


def _entries(order, percent: int, n: int, parts: int, hot: int):
    """Rows (part, entries): shingle keys, groups and places (at most 65535) of all prefixes of a batch, by part; each group once in a batch."""

    def entries(batches):
        for batch in batches:
            seen: set[int] = set()
            tokens, groups, places = [], [], []
            valid = ~np.asarray(batch.column("doc_id").is_null())
            for p in pieces(batch.column("text"), lower=True):
                key, bounds = shingle_sets(p, order.value, n)
                size, _, _, g = digests(key, bounds, percent)
                new = []
                for d in np.flatnonzero((size > 0) & valid[p.first : p.first + p.n_docs]).tolist():
                    if (x := int(g[d])) not in seen:
                        seen.add(x)
                        new.append(d)
                new = np.array(new, np.int64)
                length = prefix_length(size[new], percent)
                at = np.arange(length.sum()) + np.repeat(bounds[new] - np.cumsum(length) + length, length)
                tokens.append(key[at])
                groups.append(np.repeat(g[new], length))
                places.append(np.minimum(at - np.repeat(bounds[new], length), 65535).astype(np.uint16))
            if not tokens:
                continue
            token, group, place = np.concatenate(tokens), np.concatenate(groups), np.concatenate(places)
            common = (token >> np.uint64(58)) >= np.uint64(hot)
            part = (mix(np.where(common, token + group, token)) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            token, group, place, part = token[by], group[by], place[by], part[by]
            cut = np.searchsorted(part, np.arange(parts + 1))
            full = np.flatnonzero(np.diff(cut))
            blobs = []
            for k in full:
                one = slice(cut[k], cut[k + 1])
                names, which = np.unique(group[one], return_inverse=True)
                blobs.append(np.array([len(names), cut[k + 1] - cut[k]], np.uint32).tobytes() + names.tobytes() + token[one].tobytes() + place[one].tobytes() + which.astype(np.uint16 if len(names) < 65536 else np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "entries"])
            release()

    return entries


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g, n = np.frombuffer(blob, np.uint32, 2).tolist()
    names = np.frombuffer(blob, np.uint64, g, 8)
    token = np.frombuffer(blob, np.uint64, n, 8 + 8 * g)
    place = np.frombuffer(blob, np.uint16, n, 8 + 8 * g + 8 * n)
    which = np.frombuffer(blob, np.uint16 if g < 65536 else np.uint32, n, 8 + 8 * g + 10 * n)
    return token, names[which], place


def _buckets(hot: int):
    """From the entries of a part to rows (bucket, grp, place, k, size): the groups that share k shingles, each with its least place.

    Shingles that the same groups share are one bucket, named after the groups; ``size`` is their number. A hot shingle is
    a bucket of its own; its rows, one for each batch that holds the group, have k = 0 and count 1 together, and its size
    is HOT_SIZE and its level, as its groups are in no one place.
    """

    def emit(bucket, group, place, k, size):
        return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(group.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(size.astype(np.int32))], ["bucket", "grp", "place", "k", "size"])

    def buckets(batches):
        got = []
        for batch in batches:
            for blob in batch.column("entries"):
                token, group, place = _unpack(blob.as_py())
                common = (token >> np.uint64(58)) >= np.uint64(hot)
                if common.any():
                    yield emit(token[common], group[common], place[common], np.zeros(int(common.sum())), HOT_SIZE + (token[common] >> np.uint64(58)).astype(np.int64))
                    token, group, place = token[~common], group[~common], place[~common]
                got.append((token, group, place))
        if not got:
            return
        token, group, place = (np.concatenate(x) for x in zip(*got, strict=True))
        got.clear()
        by = np.argsort(token)
        token = token[by]
        same = token[1:] == token[:-1]
        keep = np.zeros(len(token), bool)  # a shingle of one entry pairs nothing
        keep[1:] |= same
        keep[:-1] |= same
        token, group, place = token[keep], group[by[keep]], place[by[keep]]
        token, group, place, _ = _least(token, group, place)
        if not len(token):
            return
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(start, len(token)))
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(group), dtype=np.uint64)])
            name = mix(sums[start + size] - sums[start] + size.astype(np.uint64))
        several = np.repeat(size > 1, size)
        bucket, group, place, k = _least(np.repeat(name, size)[several], group[several], place[several])
        new = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
        members = np.diff(np.append(new, len(bucket)))
        yield emit(bucket, group, place, k, np.repeat(np.minimum(members, HOT_SIZE), members))
        del token, group, place, by
        release()

    return buckets


def _least(bucket: np.ndarray, group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each (bucket, group) once, sorted, with its least place and how often it came."""
    by = np.lexsort((place, group, bucket))
    bucket, group, place = bucket[by], group[by], place[by]
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (group[1:] != group[:-1])
    return bucket[new], group[new], place[new], np.diff(np.append(np.flatnonzero(new), len(bucket)))


def _pack(order, n: int):
    def pack(batches):
        for batch in batches:
            for p in pieces(batch.column("text"), lower=True):
                key, bounds = shingle_sets(p, order.value, n)
                blobs = [key[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(p.first, p.n_docs), pa.array(blobs, pa.binary())], ["doc_id", "grams"])
            release()

    return pack


def _compare(percent: int):
    def compare(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            now, mine = None, None
            a = batch.column("a").to_numpy()
            for i in range(batch.num_rows):
                if a[i] != now:
                    now, mine = a[i], np.frombuffer(batch.column("ga")[i].as_buffer(), np.uint64)
                other = np.frombuffer(batch.column("gb")[i].as_buffer(), np.uint64)
                x = np.sort(np.concatenate([mine, other]))
                both = int((x[1:] == x[:-1]).sum())
                keep[i] = 100 * both >= percent * (len(x) - both)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])
            release()

    return compare


def meet(rows: DataFrame, key: str, row: str, condition) -> DataFrame:
    """Pairs of rows of one key, each once; the second's columns have a 2 behind them. Column ``s`` has the number of rows of the key.

    Rows of a large key are dealt to blocks of some SIDE rows, and each pair of blocks is a key of the join of its own.
    """
    blocks = F.ceil(F.col("s") / SIDE).cast("int")
    rows = rows.withColumn("_own", F.pmod(F.xxhash64(row), blocks).cast("int"))
    left = rows.withColumn("_j", F.explode(F.sequence(F.col("_own"), blocks - 1))).withColumnRenamed("_own", "_i")
    right = rows.select(*[F.col(c).alias(f"{c}2") for c in rows.columns], F.explode(F.sequence(F.lit(0), F.col("_own"))).alias("_i2"))
    same = (F.col(key) == F.col(f"{key}2")) & (F.col("_i") == F.col("_i2")) & (F.col("_j") == F.col("_own2"))
    once = (F.col("_i") < F.col("_j")) | (F.col(row) < F.col(f"{row}2"))
    return left.join(right, same & once & condition).drop("_i", "_j", "_i2", "_own2")


def similar_groups(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, hot_level: int = HOT_LEVEL) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    order = spark.sparkContext.broadcast(Order(*frequent_grams(docs, shingle, lower=True)))
    sets = scratch.table(docs.mapInArrow(_sets(order, percent, shingle), "doc_id long, n_shingles long, fp1 long, fp2 long, grp long, bits array<long>"), "sets")
    real = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = scratch.table(real.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("grp").alias("grp"), F.first("bits").alias("bits")), "reps")
    groups = scratch.table(reps.groupBy("grp").agg(F.min("rep").alias("lead"), F.first("n").alias("n"), F.count("*").alias("members")), "groups")
    entries = groups.agg(F.sum(F.col("n") * (100 - percent) / 100 + COMMON + 1).alias("n")).first()["n"] or 0
    parts = max(partitions(spark), int(entries) // PART)
    dealt = docs.mapInArrow(_entries(order, percent, shingle, parts, hot_level), "part int, entries binary").repartitionById(parts, F.col("part"))
    found = scratch.table(dealt.mapInArrow(_buckets(hot_level), "bucket long, grp long, place int, k int, size int"), "found")
    # A size class holds sizes within the ratio; a class's groups meet its leader and the one of the class below.
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    held = found.groupBy("bucket", "grp").agg(F.min("place").alias("place"), F.greatest(F.sum("k"), F.lit(1)).alias("k"), F.first("size").alias("size")).join(groups.select("grp", "lead", "n"), "grp")
    # A group that shares fewer shingles with all others than a partner of any size must share has none. Of the rest, those
    # in its largest buckets may go, as long as they are fewer than that: of the buckets that two partners share, the last
    # in this order stays with both.
    need = F.least(F.lit(COMMON), F.ceil(F.col("n") * percent * percent / 10000))
    mine = Window.partitionBy("grp")
    held = held.withColumn("_all", F.sum("k").over(mine)).where(F.col("_all") >= need)
    held = held.withColumn("joins", F.sum("k").over(mine.orderBy(F.desc("size"), "bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) >= need)
    held = scratch.table(held.select("bucket", "grp", "lead", "n", (F.col("n") - F.col("place")).alias("room"), "k", size_class.alias("c"), "joins"), "held")
    scratch.drop("found")

    fits = lambda n, m, room: (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * room >= percent * (n + m))  # noqa: E731  all that is shared lies from the first common shingle on
    share = lambda n, m: F.least(F.lit(COMMON), F.ceil(n * percent / 100), F.ceil(m * percent / 100))  # noqa: E731  what prefixes share

    def close(x: str, y: str, n, m):
        """False if the bitmaps differ in more bits than similar sets differ in shingles, n + m less twice what they share."""
        bits = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(1, BITS)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))
        return (100 + percent) * bits <= (100 - percent) * (n + m)

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        ids = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct(), f"{name}-ids")
        needed = sieve(ids, "k")
        grams = docs.where("doc_id IS NOT NULL").withColumn("_needed", needed(F.col("doc_id"))).where("_needed").select("doc_id", "text")
        grams = scratch.table(grams.mapInArrow(_pack(order, shingle), "doc_id long, grams binary"), f"{name}-grams", "none")
        half = pairs.join(grams.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb")), "b")
        whole = half.join(grams.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), "a").select("a", "b", "ga", "gb")
        links = scratch.table(whole.mapInArrow(_compare(percent), "a long, b long"), f"{name}-links")
        scratch.drop(f"{name}-grams")
        return links

    n = F.col("n")
    # First each group meets one leader, the least of those that its buckets offer, and its sets their group's first.
    leaders = scratch.table(held.groupBy("bucket", "c").agg(F.min(F.struct("lead", "grp", "n", "room")).alias("l")), "leaders")
    near = held.unionByName(held.withColumn("c", F.col("c") - 1)).join(leaders, ["bucket", "c"]).where(F.col("l.lead") < F.col("lead"))
    near = near.select(F.col("l.lead").alias("a"), "grp", "n", F.col("l.n").alias("m"), "k", F.least("room", "l.room").alias("room"))
    near = near.groupBy("a", "grp").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.sum("k").alias("k"), F.max("room").alias("room"))
    near = near.where(fits(F.col("n"), F.col("m"), F.col("room")) & (F.col("k") >= share(F.col("n"), F.col("m"))))
    star = near.groupBy("grp").agg(F.min("a").alias("a")).join(reps.select("grp", F.col("rep").alias("b"), n.alias("m"), F.col("bits").alias("bits2")), "grp").select("a", "b", "m", "bits2")
    inside = reps.join(groups.where("members > 1").select("grp", F.col("lead").alias("a")), "grp").where(F.col("a") < F.col("rep")).select("a", F.col("rep").alias("b"), n.alias("m"), F.col("bits").alias("bits2"))
    tried = star.unionByName(inside).join(reps.select(F.col("rep").alias("a"), "n", "bits"), "a").where(close("bits", "bits2", n, F.col("m")))
    tried = scratch.table(tried.select("a", "b").distinct(), "tried")
    comps = scratch.table(connected(verify(tried, "first"), scratch, "stars"), "comps")
    # While many pairs of groups still hold sets of different components, and a turn halves them, groups' first sets meet further leaders.
    # Shared shingles of buckets that one of the two left, COMMON - 1 each at most, may lie before the first common one here.
    rows = held.where("joins").select("bucket", "grp", "n", (F.col("room") + 2 * (COMMON - 1)).alias("room"))
    m, pairs = F.col("l.n"), float("inf")
    for turn in count():
        members = reps.join(comps, reps["rep"] == comps["node"], "left").select("grp", "rep", "n", "bits", F.coalesce("component", "rep").alias("comp"))
        members = scratch.table(members, f"members-{turn}")
        spans = members.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("s"), F.min(F.struct("rep", "comp", "bits")).alias("lead"))
        named = spans.select("grp", "lo", "hi", F.when(F.col("s") == 1, F.col("lead.bits")).alias("bits"))
        placed = scratch.table(rows.join(named, "grp"), f"spans-{turn}")
        open_ = placed.groupBy("bucket").agg(F.min("lo").alias("_a"), F.max("hi").alias("_b"), F.count("*").alias("s")).where("_a < _b")
        open_ = scratch.table(open_.select("bucket", "s"), f"open-{turn}")
        placed = scratch.table(placed.join(open_, "bucket"), f"placed-{turn}")
        scratch.drop(f"spans-{turn}")
        rows = placed.select("bucket", "grp", "n", "room")
        # Any groups may lead, TRIES of a bucket and class, in an order of the bucket's own each turn, or all buckets of a large group
        # would have one leader; size classes are those of above, shifted by half every other turn.
        shifted = F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent)) + turn % 2 / 2).cast("int")
        firsts = rows.join(spans.select("grp", "lead"), "grp").withColumn("c", shifted).withColumn("by", F.xxhash64("grp", "bucket", F.lit(turn)))
        firsts = scratch.table(firsts, f"firsts-{turn}")
        least = firsts.groupBy("bucket", "c", F.pmod("by", F.lit(TRIES)).alias("_")).agg(F.min(F.struct("by", "grp", "n", "room", "lead")).alias("l"), F.count("*").alias("x"))
        least = least.groupBy("bucket", "c").agg(F.collect_list("l").alias("ls"), (F.sum("x") / F.count("*")).alias("x"))
        near = firsts.join(least, ["bucket", "c"]).select("n", "room", "lead", "x", F.explode("ls").alias("l"))
        near = near.where((F.col("lead.comp") != F.col("l.lead.comp")) & fits(n, m, F.least("room", "l.room")) & close("lead.bits", "l.lead.bits", n, m))
        near = near.groupBy(F.col("lead.rep").alias("b")).agg(F.slice(F.array_distinct(F.sort_array(F.collect_set(F.struct("l.by", F.col("l.lead.rep").alias("a"))))["a"]), 1, TRIES).alias("l"), F.sum("x").alias("x"))
        near = scratch.table(near, f"near-{turn}")
        scratch.drop(f"firsts-{turn}")
        # What the leaders, drawn by chance, would meet if each group of their class led: an estimate of the pairs that are left.
        pairs, before = (near.agg(F.sum("x")).first()[0] or 0) / 2, pairs
        if pairs <= FEW * placed.count() or pairs > before / 2:
            break
        near = near.select("b", F.explode("l").alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        near = scratch.table(near, f"tried-{turn}")
        links = verify(near, f"turn-{turn}")
        if not links.take(1):
            break
        tried = tried.unionByName(near)
        comps = scratch.table(connected(comps.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links), scratch, f"stars-{turn}"), f"comps-{turn}")
    # Then all pairs of groups that still hold sets of different components.
    spans = spans.select("grp", "lo", "hi", "s")
    n2 = F.col("n2")
    apart = (F.least("lo", "lo2") < F.greatest("hi", "hi2")) & fits(n, n2, F.least("room", "room2")) & F.coalesce(close("bits", "bits2", n, n2), F.lit(True))
    rest = meet(placed, "bucket", "grp", apart).select(F.least("grp", "grp2").alias("g"), F.greatest("grp", "grp2").alias("h"), share(n, n2).alias("least")).distinct()
    # All buckets that both are in count the shingles their prefixes share; a bucket's k is the same for all its groups.
    rest = scratch.table(rest, "near")
    lists = held.join(rest.select(F.explode(F.array("g", "h")).alias("grp")).distinct(), "grp", "left_semi")
    lists = lists.groupBy("grp").agg(F.collect_set(F.struct("bucket", "k")).alias("have"))
    rest = rest.join(lists.select(F.col("grp").alias("g"), F.col("have").alias("x")), "g").join(lists.select(F.col("grp").alias("h"), F.col("have").alias("y")), "h")
    both = F.aggregate(F.array_intersect("x", "y"), F.lit(0).cast("long"), lambda total, bucket: total + bucket["k"])
    rest = rest.where(both >= F.col("least")).select("g", "h")
    # What passed expands to sets; so do groups whose own sets are of different components.
    second = members.select(*[F.col(c).alias(f"{c}2") for c in members.columns])
    differ = (F.col("comp") != F.col("comp2")) & close("bits", "bits2", n, n2)
    across = rest.join(members, F.col("g") == F.col("grp")).join(second, (F.col("h") == F.col("grp2")) & differ).select("rep", "rep2")
    within = meet(members.join(spans.where("lo < hi").select("grp", "s"), "grp"), "grp", "rep", differ).select("rep", "rep2")
    rest = across.unionByName(within).select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    rest = scratch.table(rest, "rest")
    if rest.take(1):
        more = verify(rest, "second")
        comps = connected(comps.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more), scratch, "all")
    named = reps.join(comps, reps["rep"] == comps["node"], "left").select("fp1", "fp2", F.coalesce("component", "rep").alias("component_id"))
    out = real.join(named, ["fp1", "fp2"]).select("doc_id", "n_shingles", "component_id")
    return out.unionByName(sets.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
