"""Quality rules: counts of each whole text, and a linear-chain conditional random field over its lines.

The field marks each line as content or boilerplate; Viterbi decoding gives the best marks, and the share of words in
content lines decides whether a document stays. Its weights come from maximum likelihood (gradient steps, forward and
backward sums) on a bounded sample of labelled documents, whose lines inherit the document's label.

Edge cases: a null or empty text has no words, so all counts are 0, ``base_failed`` is true and it is not kept. Lines
without a word take no part in the chain. A text of any length is decoded whole. Ties between marks go to content. Repeated
rows give repeated results; an empty table gives none. Labelled rows without an id or a label are not learned from; where
labels lack one of the two kinds, fit() warns and returns the weights set by hand. Columns other than the named ones are
ignored, whatever their names.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.words import Piece, mix, pieces

#: Bounds of the training sample: documents, and lines of each.
MAX_TRAIN_DOCS, MAX_TRAIN_LINES = 2000, 64
FEATURES = ("one", "words", "letters", "upper", "symbols", "bangs", "digits", "repeats", "duplicate", "stops", "word_length")
#: Weights for content without training (a row for each feature), then transitions boilerplate-boilerplate, b-c, c-b, c-c.
DEFAULT = np.array([1.0, 0.5, 1.0, -4.0, -12.0, -12.0, -4.0, -6.0, -1.0, 0.5, 0.0, 0.5, -0.5, -0.5, 0.5])
_CLASS = np.zeros((7, 256), np.uint8)
_CLASS[0, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = 1  # letters, or a lead byte of a longer code point
_CLASS[1, 65:91] = 1
_CLASS[2, list(b"#*$%&|<>")] = 1
_CLASS[3, list(b"!")] = 1
_CLASS[4, 48:58] = 1
_CLASS[5, list(b".?;:")] = 1
_CLASS[6, [*range(0x80), *range(0xC0, 0x100)]] = 1  # code points
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


class Lines:
    """Counts and line features of one piece."""

    def __init__(self, p: Piece):
        hashes, n = p.hashes(), len(p.data)
        new = np.flatnonzero(p.data == 10)
        starts = np.unique(np.concatenate([p.bounds[:-1], new + 1]))
        starts = starts[starts < n]
        ends = np.append(starts[1:], n)
        after_break = p.data[ends - 1] == 10 if len(ends) else np.empty(0, bool)
        ends = ends - after_break  # a break belongs to no line
        at = np.searchsorted(starts, p.starts, side="right") - 1  # the line of each word
        words = np.bincount(at, minlength=len(starts))
        sums = [np.concatenate([[0], np.cumsum(_CLASS[k][p.data], dtype=np.int64)]) for k in range(7)]
        in_lines = [s[ends] - s[starts] for s in sums]
        in_words = np.bincount(at, sums[6][p.ends] - sums[6][p.starts], minlength=len(starts))
        doc = np.searchsorted(p.bounds, starts, side="right") - 1
        has = np.flatnonzero(words > 0)
        self.doc, self.words = doc[has], words[has]
        with np.errstate(over="ignore"):
            key = mix(p.span_hash(starts[has], ends[has]) + mix(self.doc.astype(np.uint64)))
        _, first = np.unique(key, return_index=True)
        self.duplicate = np.ones(len(has), bool)
        self.duplicate[first] = False
        same = np.zeros(len(hashes), np.int64)
        if len(hashes) > 1:
            same[1:] = (hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1])
        repeats = np.bincount(at, same, minlength=len(starts))[has]
        letters, upper, symbols, bangs, digits, stops, points = (x[has].astype(float) for x in in_lines)
        size = np.maximum(points, 1)
        self.features = np.stack([np.ones(len(has)), np.minimum(np.log1p(self.words) / 4, 2), letters / size, upper / np.maximum(letters, 1), symbols / self.words, bangs / self.words, digits / size, repeats / self.words, self.duplicate.astype(float), np.minimum(stops / self.words * 5, 2), np.minimum(in_words[has] / self.words / 10, 3)], 1)
        # Of the whole documents.
        count = np.bincount(p.doc, minlength=p.n_docs)
        self.n_words = count
        self.word_chars = np.bincount(p.doc, sums[6][p.ends] - sums[6][p.starts], minlength=p.n_docs).astype(np.int64)
        self.n_symbols = sums[2][p.bounds[1:]] - sums[2][p.bounds[:-1]]
        self.n_dup_lines = np.bincount(self.doc, self.duplicate, minlength=p.n_docs).astype(np.int64)
        grams, where = p.grams(3, hashes)
        with np.errstate(over="ignore"):
            grams = mix(grams + mix(p.doc[where].astype(np.uint64)))
        _, inverse, times = np.unique(grams, return_inverse=True, return_counts=True)
        again = where[times[inverse] > 1]
        covered = np.zeros(len(hashes), bool)
        for k in range(3):
            covered[again + k] = True
        self.n_repeat_words = np.bincount(p.doc[covered], minlength=p.n_docs)


def viterbi(features: np.ndarray, doc: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """True for each line that the best path marks as content. All chains advance together, line by line; ties go to content."""
    k = features.shape[1]
    emit, step = features @ weights[:k], weights[k:].reshape(2, 2)
    n = len(doc)
    if not n:
        return np.zeros(0, bool)
    first = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1))
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    live = np.searchsorted(-size, -np.arange(size[0]) - 1, side="right")  # chains that have a t-th line
    back = np.zeros((n, 2), np.int8)
    best = np.stack([np.zeros(len(first)), emit[first]], 1)
    for t in range(1, int(size[0])):
        m = live[t]
        at = first[:m] + t
        from0, from1 = best[:m, :1] + step[0], best[:m, 1:] + step[1]
        back[at] = from1 >= from0
        best[:m] = np.maximum(from0, from1)
        best[:m, 1] += emit[at]
    mark = np.zeros(n, bool)
    state = (best[:, 1] >= best[:, 0]).astype(np.int8)
    for t in range(int(size[0]) - 1, -1, -1):
        m = live[t]
        at = first[:m] + t
        mark[at] = state[:m] == 1
        state[:m] = back[at, state[:m]]
    return mark


def train(features: np.ndarray, doc: np.ndarray, label: np.ndarray, steps: int = 120, l2: float = 1e-3) -> np.ndarray:
    """Weights of greatest penalised conditional likelihood, by Adam on the exact gradient (scaled forward-backward sums)."""
    if not len(doc) or label.all() or not label.any():
        return untrained()
    k = features.shape[1]
    _, row = np.unique(doc, return_inverse=True)
    place = np.arange(len(row)) - np.searchsorted(row, row)
    n, longest = row.max() + 1, place.max() + 1
    x, y, there = np.zeros((n, longest, k)), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    x[row, place], y[row, place], there[row, place] = features, label, True
    w, m, v = DEFAULT.copy(), np.zeros(k + 4), np.zeros(k + 4)
    both = there[:, 1:] & there[:, :-1]
    seen = np.bincount((y[:, :-1] * 2 + y[:, 1:])[both], minlength=4)
    for i in range(1, steps + 1):
        emit = np.zeros((n, longest, 2))
        emit[..., 1] = x @ w[:k]
        step = np.exp(w[k:].reshape(2, 2))
        e = np.exp(emit - emit.max(2, keepdims=True))
        f, b = np.zeros_like(e), np.ones_like(e)
        f[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for t in range(1, longest):
            z = (f[:, t - 1] @ step) * e[:, t]
            f[:, t] = z / z.sum(1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            z = (b[:, t + 1] * e[:, t + 1]) @ step.T
            b[:, t] = np.where(there[:, t + 1 : t + 2], z / z.sum(1, keepdims=True), 1)
        p = f * b
        p /= p.sum(2, keepdims=True)
        pair = f[:, :-1, :, None] * step * (e[:, 1:] * b[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        g = np.concatenate([((y - p[..., 1]) * there).ravel() @ x.reshape(-1, k), seen - (pair * both[..., None, None]).sum((0, 1)).ravel()])
        g = g / there.sum() - l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return w


def untrained() -> np.ndarray:
    warnings.warn("labels of both kinds are needed to learn; the weights set by hand hold", stacklevel=3)
    return DEFAULT


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_lines: int = MAX_TRAIN_LINES) -> np.ndarray:
    """Learn from at most ``max_docs`` labelled documents, those of the smallest hashes, and ``max_lines`` lines of each.

    Of a longer document these are 4 runs of lines, one drawn by hash from each quarter; a run is a sequence of its own.
    """
    few = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_docs)
    picked = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # max_docs rows at most

    def lines(batches):
        for batch in batches:
            label = batch.column("quality").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for p in pieces(batch.column("text")):
                x = Lines(p)
                place = np.arange(len(x.doc)) - np.searchsorted(x.doc, x.doc)
                n = np.bincount(x.doc, minlength=p.n_docs)[x.doc]
                quarter = np.minimum(4 * place // np.maximum(n, 1), 3)
                first, end = -(-quarter * n // 4), -(-(quarter + 1) * n // 4)
                run = max(max_lines // 4, 1)
                seed = (ids.astype(np.int64).astype(np.uint64)[p.first + x.doc] << np.uint64(2)) + quarter.astype(np.uint64)
                start = first + (mix(seed) % np.maximum(end - first - run + 1, 1).astype(np.uint64)).astype(np.int64)
                use = (n <= max_lines) | ((place >= start) & (place < start + run))
                quarter[n <= max_lines] = 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[p.first + x.doc[use]]), pa.array(quarter[use]), pa.array(place[use]), pa.array((label[p.first + x.doc[use]] == 1).astype(np.int64)), pa.array(list(x.features[use]), pa.list_(pa.float64()))], ["doc_id", "run", "place", "label", "x"])

    got = picked.mapInArrow(lines, "doc_id long, run long, place long, label long, x array<double>").toPandas()
    if got.empty:
        return untrained()
    got = got.sort_values(["doc_id", "place"], kind="stable").drop_duplicates(["doc_id", "place"])
    return train(np.stack(got.x), got.groupby(["doc_id", "run"]).ngroup().to_numpy(), got.label.to_numpy())


def quality_rules(docs: DataFrame, weights: np.ndarray = DEFAULT, min_words: int = 50, max_repeat_percent: int = 50, min_content: float = 0.5) -> DataFrame:
    """One row for each document (``doc_id``, ``text``): its counts, ``base_failed``, ``kept`` and ``content_share``."""

    def score(batches):
        for batch in batches:
            for p in pieces(batch.column("text")):
                x = Lines(p)
                mark = viterbi(x.features, x.doc, weights)
                share = np.bincount(x.doc, x.words * mark, minlength=p.n_docs) / np.maximum(x.n_words, 1)
                failed = (x.n_words < min_words) | (100 * x.n_repeat_words > max_repeat_percent * x.n_words)
                cols = [x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(p.first, p.n_docs), *[pa.array(c.astype(np.int64)) for c in cols], pa.array(failed), pa.array(~failed & (share >= min_content)), pa.array(share)], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, SCHEMA)
