"""Removal of long word sequences that occur more than once, by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words. Its minimiser is the least of its runs of ``RUN`` words, in the order of a hash
in which frequent runs come last. Consecutive windows with one minimiser travel together, as one packed string, to the
minimiser's bucket; equal windows always meet there. In the bucket, windows are sorted by 128 bits of hash and counted.

Packed strings that occur again within a lot (some megabytes of text) are settled where they are: all their windows repeat, so each place is
told so at once and one string travels for all, marked as repeated. A group of copies therefore sends a string for each
lot, not for each copy. Buckets are read one after another, sorted by the JVM, which spills; their number grows with the
bytes of text, so one holds some ``SHELF`` bytes whatever the corpus.

Edge cases: a null or empty text has no words and no windows; kept_sha256 is that of no bytes. Texts under the window
length lose nothing; a very long text is cut into strings of ``LONGEST`` windows at most. Repeated rows repeat each
other, so both lose all their windows. Windows that overlap their own repetition count as repeated. Of equal minimisers
in a window any will do, as a bucket is named by the value and not by its place. An empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import Scratch, frequent_grams, partitions, sieve
from factloom.llm.words import Piece, gram_hash, mix, pieces, release

WINDOW, RUN = 35, 4
#: Windows in one packed string at most, buckets of one partition, bytes that are packed at once, and bytes of text for each bucket.
LONGEST, SHELVES, LOT, SHELF = 512, 16, 8 << 20, 8 << 20
_HOT = np.uint64(1 << 63)


def rolling_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    out, w = x, 1
    while 2 * w <= width:
        out = np.minimum(out[: len(out) - w], out[w:])
        w *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - w :]) if w < width else out


def super_runs(p: Piece, window: int, run: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, windows, minimiser) of the runs of consecutive windows of a piece that share a minimiser."""
    hashes = p.hashes()
    n = len(hashes)
    none = np.empty(0, np.int64)
    if n < window:
        return none, none, none.astype(np.uint64)
    g = gram_hash(hashes, run)
    key = g & ~_HOT
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, g), len(frequent) - 1)
        key[frequent[at] == g] |= _HOT
    least = rolling_min(key, window - run + 1)
    whole = p.doc[window - 1 :] == p.doc[: n - window + 1]
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none, none.astype(np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (p.doc[at[1:]] != p.doc[at[:-1]])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at)))
    first, times = at[head], least[at[head]]
    cuts = -(-size // LONGEST)
    if (cuts > 1).any():
        k = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        first, times, size = np.repeat(first, cuts) + k * LONGEST, np.repeat(times, cuts), np.minimum(np.repeat(size, cuts) - k * LONGEST, LONGEST)
    return first, size, times


def spaced(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, each followed by one space, and where each word starts in them (and the end)."""
    size = p.ends - p.starts + 1
    at = np.concatenate([[0], np.cumsum(size)])
    src = np.arange(at[-1]) + np.repeat(p.starts - at[:-1], size)
    out = p.data[np.minimum(src, len(p.data) - 1)] if len(p.data) else p.data
    out[at[1:] - 1] = 0x20
    return out, at


def _deal(docs: DataFrame, window: int, run: int, frequent: np.ndarray, parts: int) -> DataFrame:
    """Rows (part, shelf, meta, text): the packed strings of a batch for one bucket. Shelf -1: settled places, meta only."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def deal(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False), batch.column("_key").to_numpy(zero_copy_only=False)
            texts, cols, done = [], [], 0
            for p in pieces(batch.column("text")):
                first, size, least = super_runs(p, window, run, sent.value)
                if not len(first):
                    continue
                text, at = spaced(p)
                last = first + size + window - 1
                bytes_ = Piece(text, np.array([0, len(text)]), 0, False)
                content = bytes_.span_hash(at[first], at[last] - 1)
                doc = p.doc[first]
                cols.append(np.rec.fromarrays([ids[p.first + doc], keys[p.first + doc], (first - p.first_word[doc]).astype(np.int32), size.astype(np.int32), (at[last] - 1 - at[first]).astype(np.int32), content, least, done + at[first]], names="id,key,start,size,len,content,least,at"))
                texts.append(text)
                done += len(text)
                if done >= LOT:
                    yield from _blobs(np.concatenate(texts).tobytes(), np.concatenate(cols), parts)
                    texts, cols, done = [], [], 0
            if cols:
                yield from _blobs(np.concatenate(texts).tobytes(), np.concatenate(cols), parts)
            release()

    return docs.mapInArrow(deal, "part int, shelf int, n int, meta binary, text binary")


def _blobs(text: bytes, rows: np.recarray, parts: int):
    """The rows of one lot, after strings that occur again in it have been settled."""
    pack = zstandard.ZstdCompressor(level=3)
    order = np.argsort(rows["content"], kind="stable")
    same = np.zeros(len(rows), bool)
    a, b = order[:-1], order[1:]
    hit = (rows["content"][a] == rows["content"][b]) & (rows["len"][a] == rows["len"][b]) & (rows["size"][a] == rows["size"][b])
    at, length = rows["at"], rows["len"]
    for i in np.flatnonzero(hit).tolist():  # settled only after all bytes have been compared
        x, y, n = at[a[i]], at[b[i]], length[a[i]]
        hit[i] = text[x : x + n] == text[y : y + n]
    same[b] = hit
    again = same.copy()
    again[a] |= hit
    out = []
    settled = np.flatnonzero(again)
    to = (mix(rows["id"][settled].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    for part in np.unique(to):
        mine = rows[settled[to == part]]
        out.append((int(part), -1, len(mine), pack.compress(_meta(mine, np.ones(len(mine), bool))), b""))
    bucket = (mix(rows["least"]) % np.uint64(parts * SHELVES)).astype(np.int64)
    sends = np.flatnonzero(~same)
    sends = sends[np.argsort(bucket[sends], kind="stable")]
    for mine in np.split(sends, np.flatnonzero(np.diff(bucket[sends])) + 1):
        words = b"".join([text[x : x + n] for x, n in zip(at[mine].tolist(), length[mine].tolist(), strict=True)])
        k = int(bucket[mine[0]])
        out.append((k // SHELVES, k % SHELVES, len(mine), pack.compress(_meta(rows[mine], again[mine])), pack.compress(words)))
        if len(out) >= 256:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["part", "shelf", "n", "meta", "text"])


def _meta(rows, marked: np.ndarray) -> bytes:
    ids = np.diff(rows["id"], prepend=0)
    return b"".join([ids.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), rows["key"].astype(np.int32).tobytes(), rows["start"].astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), rows["size"].astype(np.int16).tobytes(), rows["len"].astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), marked.astype(np.uint8).tobytes()])


def _parse(meta: bytes, n: int) -> list[np.ndarray]:
    x = np.frombuffer(meta, np.uint8)
    cut = np.cumsum([0, 8 * n, 4 * n, 4 * n, 2 * n, 4 * n, n])
    part = [x[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    whole = lambda y, k, t: np.ascontiguousarray(y.reshape(k, n).T).view(t).ravel()
    return [np.cumsum(whole(part[0], 8, np.int64)), part[1].copy().view(np.int32), whole(part[2], 4, np.int32), part[3].copy().view(np.int16), whole(part[4], 4, np.int32), part[5].astype(bool)]


def repeated(window_hash: np.ndarray, second: np.ndarray) -> np.ndarray:
    """True for values (128 bits in two columns) that occur more than once."""
    order = np.argsort(window_hash, kind="stable")
    a, b = window_hash[order], second[order]
    close = a[1:] == a[:-1]
    if (close & (b[1:] != b[:-1])).any():  # half a hash collides: sort by all of it
        order = np.lexsort((second, window_hash))
        a, b = window_hash[order], second[order]
        close = a[1:] == a[:-1]
    pair = close & (b[1:] == b[:-1])
    out = np.zeros(len(a), bool)
    out[order[1:]] = pair
    out[order[:-1]] |= pair
    return out


def _count(window: int):
    """From the rows of a partition, sorted by shelf, to (doc_id, _key, start, size): runs of repeated windows."""

    def shelf_of(blobs: list) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor()
        metas = [_parse(unpack.decompress(m), n) for n, m, _ in blobs]
        ids, keys, start, size, length, marked = (np.concatenate(x) for x in zip(*metas, strict=True))
        if not blobs[0][2]:
            return _runs(ids, keys, start, size)
        data = b"".join([unpack.decompress(t) for _, _, t in blobs])
        bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        strings = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        cols = []
        for p in pieces(strings):  # only hashes and places of a whole shelf stand side by side
            grams, at = p.grams(window, p.hashes())
            own = p.doc[at]
            cols.append((grams, p.span_hash(p.starts[at], p.ends[at + window - 1]), (at - p.first_word[own]).astype(np.int32), (p.first + own).astype(np.int32)))
        del data, strings, p
        grams, second, at, own = (np.concatenate(x) for x in zip(*cols, strict=True))
        cols.clear()
        twice = repeated(grams, second)
        twice |= marked[own]
        at, own = at[twice], own[twice]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])
        head = np.flatnonzero(new)
        own = own[head]
        return _runs(ids[own], keys[own], start[own] + at[head], np.diff(np.append(head, len(at))))

    def count(batches):
        shelf, blobs = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                s, n, m, t = (batch.column(c)[i].as_py() for c in ("shelf", "n", "meta", "text"))
                if s != shelf or (s == -1 and len(blobs) >= 64):
                    if blobs:
                        yield shelf_of(blobs)
                    shelf, blobs = s, []
                    release()
                blobs.append((n, m, t))
        if blobs:
            yield shelf_of(blobs)
            release()

    return count


def _runs(ids, keys, start, size) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(keys.astype(np.int32)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], ["doc_id", "_key", "start", "size"])


def _finish(window: int, with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def finish(batches):
        for batch in batches:
            found = batch.column("_runs")
            n_runs = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(found), 0))
            flat = found.flatten()
            starts, sizes = (flat.field(c).to_numpy() for c in ("start", "size"))
            upto = np.concatenate([[0], np.cumsum(n_runs)])
            for p in pieces(batch.column("text")):
                text, at = spaced(p)
                n = np.diff(p.first_word)
                mine = slice(upto[p.first], upto[p.first + p.n_docs])
                base = np.repeat(p.first_word[:-1], n_runs[p.first : p.first + p.n_docs])
                edge = np.zeros(len(p.starts) + 1, np.int64)
                np.add.at(edge, base + starts[mine], 1)
                np.add.at(edge, base + starts[mine] + sizes[mine] + window - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = np.bincount(p.doc[gone], minlength=p.n_docs).astype(np.int64)
                keep = text[np.repeat(~gone, np.diff(at))] if gone.any() else text
                size = np.diff(at) * ~gone
                ends = np.concatenate([[0], np.cumsum(size)])[p.first_word]
                kept = keep.tobytes()
                parts = [kept[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                cols = [batch.column("doc_id").slice(p.first, p.n_docs), pa.array(n.astype(np.int64)), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in parts])]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(parts, pa.binary()).cast(pa.string())] * with_text, names)
            release()

    return finish


def remove_repeats(docs: DataFrame, window: int = WINDOW, run: int = RUN, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) and, if asked for, kept_text, for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    # Rows are told apart by id and text; equal rows have equal results.
    named = docs.select(F.col("doc_id").cast("long"), "text", F.hash("doc_id", "text").alias("_key"))
    frequent, _ = frequent_grams(named, run, lower=False)
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), size // (SHELVES * SHELF))
    dealt = _deal(named, window, run, frequent, parts).repartitionById(parts, F.col("part")).sortWithinPartitions("shelf")
    runs = dealt.mapInArrow(_count(window), "doc_id long, _key int, start int, size int")
    runs = scratch.table(runs, "runs")
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("_key"))
    by_doc = runs.groupBy("doc_id", "_key").agg(F.collect_list(F.struct("start", "size")).alias("_runs"))
    by_doc = by_doc.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "_runs")
    maybe = sieve(runs.select(key.alias("k")).distinct(), "k")(key)
    named = named.withColumn("_maybe", maybe)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    clean = named.where(~F.col("_maybe")).select("doc_id", "text", F.expr("CAST(NULL AS array<struct<start:int,size:int>>)").alias("_runs"))
    rest = named.where("_maybe")
    rest = rest.join(by_doc, (F.coalesce(rest["doc_id"], F.lit(-1)) == by_doc["_d"]) & (rest["_key"] == by_doc["_k"]), "left").select("doc_id", "text", "_runs")
    return clean.mapInArrow(_finish(window, with_text), out).unionByName(rest.mapInArrow(_finish(window, with_text), out))
