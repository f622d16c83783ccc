"""Language identification by bit-sliced Bloom filters of character n-grams.

One table of slots serves all languages: a slot is a bitmask with a bit for each language (a word of 64 bits for every 64
languages), so an n-gram's masks, combined by AND over its slots, name all languages whose filter holds it. A language's
filter holds its ``FILTER_SIZE`` most frequent n-grams, whether or not others have them too. A document's popcounts by
language are corrected for the n-grams that answer without being held: a foreign n-gram does so with the share of all hash
classes that answer for the language, which counts both what was folded into one class and what slots confuse. The
greatest corrected count decides; the score is its share of the document's n-grams.

Bounds: n-grams are counted in 2**GRAM_BITS hash classes; FILTER_SIZE of each language reach the driver, and the broadcast
masks are 2**GRAM_BITS words for every 64 languages, whatever the corpus. Any number of languages will do.

Edge cases: a null text or one without a letter is ``und`` with score 0; a text with letters too short for any n-gram
or with none known gets the language with most training text, score 0. Without training rows all is ``und``. Ties go to
the first language in code-point order. A text of any length is read whole, a document of more than a piece of its own.
Repeated rows give repeated results, and an empty table none. Columns other than the named ones are ignored, whatever
their names, unless they are asked for in ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.shared import Scratch
from factloom.llm.words import mix, pieces, release

GRAM_BITS, SLOT_BITS, HASHES, NGRAMS = 20, 20, 2, (2, 3, 4)
#: N-grams in each language's filter.
FILTER_SIZE = 20_000
#: Languages whose counts a task holds at once.
HELD = 32


def grams(p, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, offset) of each run of n bytes that starts within a document; white space is one kind of byte, digits and ASCII marks another."""
    data = _FOLD[p.data]
    if len(data) < n:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    m = len(data) - n + 1
    x = np.full(m, n, np.uint32)
    for k in range(n):
        x = x * np.uint32(0x01000193) ^ data[k : k + m]
    x = x * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    ok = np.ones(m, bool)
    for b in p.bounds[1:-1]:  # runs over a border
        ok[max(0, b - n + 1) : b] = False
    ok &= data[:m] != 1  # no run starts with a mark
    at = np.flatnonzero(ok)
    return x[at], at


_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 1
_FOLD[[0x20, *range(0x09, 0x0E)]] = 0
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)


def learn(docs: DataFrame, size: int = FILTER_SIZE) -> tuple[list[str], np.ndarray, str]:
    """From docs (text, lang): the languages in code-point order, the slot table (words of 64 languages x slots), and the language with most text."""

    def count(batches):
        total: dict[str, np.ndarray] = {}

        def counted():
            for lang, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "gram", "n"])
            total.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                if lang not in total:
                    if len(total) == HELD:
                        yield from counted()
                    total[lang] = np.zeros(1 << GRAM_BITS, np.int64)
                mine = batch.column("text").filter(pa.array([x == lang for x in langs]))
                for p in pieces(mine):
                    for n in NGRAMS:
                        x, _ = grams(p, n)
                        total[lang] += np.bincount(x & np.uint32((1 << GRAM_BITS) - 1), minlength=1 << GRAM_BITS)
            release()
        yield from counted()

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string"))
    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = Scratch(docs.sparkSession, "language").table(sums, "sums")
    total = {r["lang"]: r["n"] for r in sums.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row for each language
    seen = {r["lang"] for r in rows.select("lang").distinct().collect()}  # those without any n-gram too
    langs = sorted(seen)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))  # 2**GRAM_BITS rows of each language at most
    best = sums.where("n > 1").withColumn("nth", nth).where(F.col("nth") <= size).select("lang", "gram").toArrow()
    slots = np.zeros((-(-len(langs) // 64), 1 << SLOT_BITS), np.uint64)
    if langs:
        which = np.asarray(pa.compute.index_in(best.column("lang"), pa.array(langs, pa.string())).combine_chunks())
        gram = best.column("gram").to_numpy().astype(np.uint64)
        for k in range(len(langs)):
            mine = gram[which == k]
            for j in range(HASHES):
                slots[k // 64][slot(mine, j)] |= np.uint64(1 << k % 64)
    return langs, slots, min(langs, key=lambda x: (-total.get(x, 0), x)) if langs else "und"


def slot(gram: np.ndarray, j: int) -> np.ndarray:
    return mix(gram + np.uint64((j + 1) << 32)) & np.uint64((1 << SLOT_BITS) - 1)


def answers(slots: np.ndarray) -> np.ndarray:
    """The mask of each n-gram class: the AND of its slots, so all classes are answered once for all documents."""
    every = np.arange(1 << GRAM_BITS, dtype=np.uint64)
    masks = np.full((len(slots), 1 << GRAM_BITS), (1 << 64) - 1, np.uint64)
    for j in range(HASHES):
        masks &= slots[:, slot(every, j)]
    return masks


def corrected(hits: np.ndarray, total: np.ndarray, wrong: np.ndarray) -> np.ndarray:
    """N-grams that a language holds, from those that answered: hits = held + wrong x (total - held)."""
    return np.clip((hits - wrong[:, None] * total) / np.maximum(1 - wrong[:, None], 1e-9), 0, total)


def predict(docs: DataFrame, model: tuple, keep: tuple = ("doc_id",)) -> DataFrame:
    """(lang_pred, score) and the columns ``keep`` for each row of docs (doc_id, text)."""
    langs, slots, usual = model
    spark = docs.sparkSession
    masks = answers(slots)
    bit = lambda m, k: m[k // 64] >> np.uint64(k % 64) & np.uint64(1)
    wrong = np.array([bit(masks, k).mean() for k in range(len(langs))])
    sent = spark.sparkContext.broadcast(masks)  # 8 MB for every 64 languages

    def score(batches):
        masks, n_langs = sent.value, len(langs)
        for batch in batches:
            letter = batch.column("_letter").to_numpy(zero_copy_only=False)
            for p in pieces(batch.column("text")):
                hits, total = np.zeros((n_langs, p.n_docs)), np.zeros(p.n_docs)
                for n in NGRAMS:
                    x, at = grams(p, n)
                    doc = np.searchsorted(p.bounds, at, side="right") - 1
                    mask = masks[:, x & np.uint32((1 << GRAM_BITS) - 1)]
                    total += np.bincount(doc, minlength=p.n_docs)
                    for k in range(n_langs):
                        hits[k] += np.bincount(doc[bit(mask, k) > 0], minlength=p.n_docs)
                right = corrected(hits, total, wrong)
                names, scores = [], []
                for i in range(p.n_docs):
                    known = right[:, i].max() if n_langs else 0
                    if not n_langs or not letter[p.first + i]:
                        names.append("und")
                        scores.append(0.0)
                    elif known <= 0:
                        names.append(usual)
                        scores.append(0.0)
                    else:
                        k = int(right[:, i].argmax())
                        names.append(langs[k])
                        scores.append(float(right[k, i] / total[i]))
                yield pa.RecordBatch.from_arrays([*[batch.column(f"_keep{i}").slice(p.first, p.n_docs) for i in range(len(keep))], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])
            release()

    rows = docs.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    kinds = dict(docs.dtypes)
    return rows.mapInArrow(score, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", lang_pred string, score double")


def held_out(doc_id, parts: int = 5, part: int = 0):
    """True for documents that are kept from learning: crc32 of the id as text, modulo ``parts``."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % parts == part, F.lit(False))
