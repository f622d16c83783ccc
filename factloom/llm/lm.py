"""Brown class-based bigram language model.

Tokens are lower-cased words, then one end. Clustering has two steps. First the most frequent words are units of their own
and all others belong to the unit of their ending; exchange clustering moves these units between classes until no move
raises the likelihood of the class bigrams. Then every other word met ``LEAST`` times or more, however many there are,
gathers the classes around it and moves to the class where the likelihood gains most, in one distributed pass over all
training text. Only rarer and unseen words have the class of their ending. A text's probability is the product of smoothed
class transitions and word emissions (count + 1) / (class tokens + class words + 1); the spare 1 is for unseen words.

All training text is counted. Counts and classes of the ``TOP`` most frequent words (a fixed bound, some 40 MB) are
broadcast; rarer tokens meet their counts and classes in joins on the word's hash, where no key is hot. Bloom filters (4 MB
each) spare the count's join those that no training text has, and in training texts those that occur once. The unit bigrams that reach the driver are at most ``UNITS`` squared. Class bigrams are counted over all training text with
the final classes. Words are told apart by 64-bit hashes.

Edge cases: a null or empty text is its end token. A text of any length is scored whole. With no training rows all counts
are 0. Repeated rows count and are scored each. A null id trains. Words of equal frequency are taken in the order of their
hashes, and of equally good classes the first. Columns other than the named ones are ignored, whatever their names. An
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from factloom.llm.shared import Scratch
from factloom.llm.words import Piece, mix, pieces, release

WORDS, ENDINGS, CLASSES, TOP = 1024, 512, 32, 1 << 21
UNITS = WORDS + ENDINGS
END = mix(np.array([0xE0D], np.uint64))[0]
#: Strength of the class unigram in class transitions.
BACKOFF = 10.0
#: Words met less often have the class of their ending.
LEAST = 5
#: Bits of the Bloom filter of words that have a class of their own.
LOG_BITS = 25


def endings(p: Piece) -> np.ndarray:
    """A number under ENDINGS from each word's last three bytes."""
    last = np.maximum(p.ends - 3, p.starts)
    x = np.zeros(len(p.ends), np.uint32)
    for k in range(3):
        at = last + k
        x = x * np.uint32(257) + np.where(at < p.ends, p.data[np.minimum(at, len(p.data) - 1)], 0).astype(np.uint32)
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64) % ENDINGS


def count_words(docs: DataFrame) -> DataFrame:
    """(word, ending, n): tokens of all texts, by hash; the end has ending -1."""

    def batches_of(batches):
        for batch in batches:
            found, tails = [np.full(batch.num_rows, END)], [np.full(batch.num_rows, -1, np.int64)]
            for p in pieces(batch.column("text"), lower=True):
                found.append(p.hashes())
                tails.append(endings(p))
            words, first, n = np.unique(np.concatenate(found), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.concatenate(tails)[first].astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "ending", "n"])

    return docs.select("text").mapInArrow(batches_of, "word long, ending int, n long").groupBy("word", "ending").agg(F.sum("n").alias("n"))


def count_level():
    return F.floor(F.log2(F.col("n").cast("double")) * 16)


def least_level(counts: DataFrame, top: int = TOP) -> int | None:
    """The least count, in classes of 1/16 of a power of two, that keeps the words above it to ``top``; None if no class does."""
    held, least = 0, None
    for r in counts.groupBy(count_level().alias("level")).count().orderBy(F.desc("level")).collect():  # 1024 rows at most
        held += r["count"]
        if held > top:
            break
        least = r["level"]
    return least


def word_filter(words: DataFrame) -> np.ndarray:
    """A Bloom filter of the column word: 2**LOG_BITS bits whatever the data; with more words it lets more pass."""
    spots = F.explode(F.array(*[F.pmod(F.shiftright("word", k), F.lit(1 << LOG_BITS)) for k in (0, 32)]))
    bits = words.select(spots.alias("at")).groupBy(F.shiftright("at", 6).alias("at64")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    got = bits.toArrow()  # 2**(LOG_BITS - 6) rows at most
    table = np.zeros(1 << (LOG_BITS - 6), np.int64)
    table[got.column("at64").to_numpy()] = got.column("bits").to_numpy()
    return table


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    x, out = hashes.view(np.int64), np.ones(len(hashes), bool)
    for k in (0, 32):
        at = (x >> k) & ((1 << LOG_BITS) - 1)
        out &= (table[at >> 6] >> (at & 63)) & 1 == 1
    return out


def units_of(p: Piece, hashes: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Unit of each word; ``lexicon`` is sorted. Unit 0 is the end."""
    at = np.minimum(np.searchsorted(lexicon, hashes), max(len(lexicon) - 1, 0))
    known = lexicon[at] == hashes if len(lexicon) else np.zeros(len(hashes), bool)
    return np.where(known, 1 + at, WORDS + endings(p))


def chains(p: Piece, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, unit before, document) of all tokens of a piece; before the first token stands the end, 0. Takes classes or hashes as well."""
    n = len(units) + p.n_docs
    ends = p.first_word[1:] + np.arange(p.n_docs)
    token = np.zeros(n, units.dtype)
    inner = np.ones(n, bool)
    inner[ends] = False
    token[inner] = units
    before = np.concatenate([np.zeros(1, token.dtype), token[:-1]])
    return token, before, np.repeat(np.arange(p.n_docs), np.diff(p.first_word) + 1)


def count_bigrams(docs: DataFrame, lexicon: np.ndarray) -> np.ndarray:
    """Unit bigrams of all texts, UNITS x UNITS. Each task sends a row for each bigram it has met, so at most UNITS squared."""

    def count(batches):
        total = np.zeros(UNITS * UNITS, np.int64)
        for batch in batches:
            for p in pieces(batch.column("text"), lower=True):
                token, before, _ = chains(p, units_of(p, p.hashes(), lexicon))
                total += np.bincount(before * UNITS + token, minlength=UNITS * UNITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    got = docs.select("text").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(UNITS * UNITS, np.int64)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(UNITS, UNITS)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The class of each unit. Unit 0 (the end) keeps class 0 to itself.

    Units start dealt out by frequency; each in turn moves to the class with the greatest class-bigram likelihood, until
    a round moves none. Each move raises the likelihood by more than rounding can feign, so rounds end.
    """
    b = bigrams.astype(float)
    n, freq = len(b), b.sum(0)
    order = [u for u in np.argsort(-freq, kind="stable") if u]
    of = np.zeros(n, np.int64)
    for i, u in enumerate(order):
        of[u] = 1 + i % (classes - 1)
    one = np.eye(classes)[of]
    after, before = b @ one, b.T @ one  # of each unit: counts of the class that follows, that precedes
    m = one.T @ after
    size = m.sum(1)
    least, moved = 1e-12 * float(_xlogx(freq.sum())) + 1e-9, 1
    while moved:
        moved = 0
        for u in order:
            if not freq[u]:
                continue
            a, s = of[u], b[u, u]
            r, c = after[u].copy(), before[u].copy()
            # Take u out of its class.
            m[a] -= r
            m[:, a] -= c
            m[a, a] += s
            r[a] -= s
            c[a] -= s
            size[a] -= freq[u]
            # Gain of putting it into each class: row and column change, the diagonal takes both and u's own bigram.
            gain = (_xlogx(m + r) - _xlogx(m)).sum(1) + (_xlogx(m + c[:, None]) - _xlogx(m)).sum(0)
            d = np.diag(m)
            gain += _xlogx(d + r + c + s) + _xlogx(d) - _xlogx(d + r) - _xlogx(d + c)
            gain -= 2 * (_xlogx(size + freq[u]) - _xlogx(size))
            gain[0] = -np.inf
            k = int(gain.argmax())
            if gain[k] <= gain[a] + least:
                k = a
            m[k] += r
            m[:, k] += c
            m[k, k] += s
            size[k] += freq[u]
            if k != a:
                moved += 1
                of[u] = k
                after[:, a] -= b[:, u]
                after[:, k] += b[:, u]
                before[:, a] -= b[u]
                before[:, k] += b[u]
    return of


def best_classes(m: np.ndarray, of: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The class each of some units gains most in, all others staying: m are the class bigrams, ``of`` the units' classes,
    after and before their counts by class, own those of the unit after itself."""
    i = np.arange(len(of))
    freq, size = before.sum(1), np.repeat(m.sum(1, dtype=float)[None], len(of), 0)
    size[i, of] -= freq
    r, c = after.astype(float), before.astype(float)
    r[i, of] -= own
    c[i, of] -= own
    gain = -2 * (_xlogx(size + freq[:, None]) - _xlogx(size))
    # Only cells the unit has counts in change: m without the unit, in the row or column of each such count.
    for m_, x, mine, others in ((m.T, r, after, before), (m, c, before, after)):
        u, j = np.nonzero(x)
        line = m_[j].astype(float)
        line[np.arange(len(u)), of[u]] -= mine[u, j]
        same = np.flatnonzero(j == of[u])
        line[same] -= others[u[same]]
        line[same, of[u[same]]] += own[u[same]]
        if len(u):
            first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            gain[u[first]] += np.add.reduceat(_xlogx(line + x[u, j][:, None]) - _xlogx(line), first)
    d = np.repeat(np.diag(m).astype(float)[None], len(of), 0)
    d[i, of] -= after[i, of] + before[i, of] - own
    gain += _xlogx(d + r + c + own[:, None]) + _xlogx(d) - _xlogx(d + r) - _xlogx(d + c)
    gain[:, 0] = -np.inf
    k = gain.argmax(1)
    return np.where(gain[i, k] > gain[i, of] + 1e-9, k, of)


def word_classes(docs: DataFrame, sent, classes: int) -> DataFrame:
    """(word, n, class) of all words met LEAST times or more, but for the first units: one pass of exchange moves.

    ``sent`` has the first units' lexicon and classes, their class bigrams and the filter of words to place.
    """

    width = 2 * classes + 1  # classes before, classes after, and the word after itself

    def contexts(batches):
        lexicon, of, _, table = sent.value
        words, slots = [], []

        def counted():
            which, names = pd.factorize(np.concatenate(words))
            x = (which << 32) + np.concatenate(slots)
            words.clear()
            slots.clear()
            x.sort()
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
            n, x = np.diff(np.append(at, len(x))), x[at]
            return pa.RecordBatch.from_arrays([pa.array(names[x >> 32].view(np.int64)), pa.array((x & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], ["word", "slot", "n"])

        for batch in batches:
            for p in pieces(batch.column("text"), lower=True):
                hashes = p.hashes()
                units = units_of(p, hashes, lexicon)
                word, last, _ = chains(p, hashes)
                unit, _, _ = chains(p, units)
                cls = of[unit]
                to_place = unit >= WORDS
                to_place[to_place] = passes(table, word[to_place])
                at = np.flatnonzero(to_place)
                own = at[word[at] == last[at]]
                words += [word[at], word[at], word[own]]
                # A word has a token after it, the end if no other; before the first token stands the end.
                slots += [width * cls[at] + np.where(at > 0, cls[at - 1], 0), width * cls[at] + classes + cls[at + 1], width * cls[own] + 2 * classes]
                if sum(map(len, words)) > 1 << 19:
                    yield counted()
            if words:
                yield counted()
            release()

    def place(batches):
        def placed(word, slot, n):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            x = np.zeros((len(start), width), np.int64)
            x[np.repeat(np.arange(len(start)), np.diff(np.append(start, len(word)))), slot % width] = n
            word, of, freq = word[start], slot[start] // width, x[:, :classes].sum(1)
            ok = freq >= LEAST
            x, word, of, freq = x[ok], word[ok], of[ok], freq[ok]
            for a in range(0, len(x), 1024):
                y = x[a : a + 1024]
                best = best_classes(sent.value[2], of[a : a + 1024], y[:, classes : 2 * classes], y[:, :classes], y[:, -1])
                yield pa.RecordBatch.from_arrays([pa.array(word[a : a + 1024]), pa.array(freq[a : a + 1024]), pa.array(best.astype(np.int32))], ["word", "n", "class"])

        held = None  # the last word's rows so far, ``width`` at most
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in ("word", "slot", "n")]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            cut = int(np.flatnonzero(rows[0] == rows[0][-1])[0])
            held = [x[cut:].copy() for x in rows]
            if cut:
                yield from placed(*[x[:cut] for x in rows])
        if held is not None:
            yield from placed(*held)

    got = docs.select("text").mapInArrow(contexts, "word long, slot int, n long").repartition("word")
    got = got.groupBy("word", "slot").agg(F.sum("n").alias("n")).sortWithinPartitions("word")
    return got.mapInArrow(place, "word long, n long, class int")


class Classes:
    """The classes of words: of ``known`` words by their hashes, else of the ending, unless ``table`` says that the word may be placed elsewhere."""

    def __init__(self, known: np.ndarray, of: np.ndarray, endings: np.ndarray, table: np.ndarray | None, n: np.ndarray):
        self.known, self.of, self.endings, self.table, self.n = known, of, endings, table, n

    def look(self, p: Piece, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, hash or 0) of each word; a hash where the class must be looked up and the one given is but the ending's."""
        cls, away = self.endings[endings(p)], np.ones(len(hashes), bool)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            hit = self.known[at] == hashes
            cls[hit] = self.of[at[hit]]
            away[hit] = False
        if self.table is None:
            away[:] = False
        else:
            away[away] = passes(self.table, hashes[away])
        return cls, np.where(away, hashes, np.uint64(0))


MOVE = "ac int, aw long, bc int, bw long"


def moves(p: Piece, hashes: np.ndarray, classes: Classes):
    """(class before, class, document) of the tokens whose both classes are known, and the same with hashes of the rest (column arrays of MOVE)."""
    cls, away = classes.look(p, hashes)
    (b, a, doc), (bw, aw, _) = chains(p, cls), chains(p, away)
    open_ = (aw != 0) | (bw != 0)
    rest = [pa.array(a[open_].astype(np.int32)), pa.array(aw[open_].view(np.int64), mask=aw[open_] == 0), pa.array(b[open_].astype(np.int32)), pa.array(bw[open_].view(np.int64), mask=bw[open_] == 0)]
    return a[~open_], b[~open_], doc[~open_], doc[open_], rest


def look_up(rows: DataFrame, tail: DataFrame) -> DataFrame:
    """Put the classes of tail (word, class) in the place of the endings' classes. Rows without a word are dealt by chance, so no key is hot."""
    for w, c in (("aw", "ac"), ("bw", "bc")):
        rows = rows.withColumn("_at", F.coalesce(w, F.xxhash64(F.monotonically_increasing_id())))
        rows = rows.join(tail.select(F.col("word").alias("_at"), F.col("class").alias("_class")), "_at", "left")
        rows = rows.withColumn(c, F.when(F.col(w).isNotNull(), F.coalesce("_class", c)).otherwise(F.col(c))).drop("_at", "_class")
    return rows


def count_moves(docs: DataFrame, sent, tail: DataFrame | None, classes: int) -> np.ndarray:
    """Class bigrams of all texts."""

    def count(batches):
        total = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for p in pieces(batch.column("text"), lower=True):
                a, b, _, _, rest = moves(p, p.hashes(), sent.value)
                total += np.bincount(a * classes + b, minlength=classes * classes)
                yield pa.RecordBatch.from_arrays([*rest, pa.array(np.ones(len(rest[0]), np.int64))], ["ac", "aw", "bc", "bw", "n"])
        at = np.flatnonzero(total)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array((at // classes).astype(np.int32)), none, pa.array((at % classes).astype(np.int32)), none, pa.array(total[at])], ["ac", "aw", "bc", "bw", "n"])

    got = docs.select("text").mapInArrow(count, MOVE + ", n long")
    if tail is not None:
        got = look_up(got, tail)
    out = np.zeros((classes, classes), np.int64)
    for r in got.groupBy("ac", "bc").agg(F.sum("n").alias("n")).collect():  # classes squared at most
        out[r["ac"], r["bc"]] = r["n"]
    return out


def class_lm(docs: DataFrame, held_out, classes: int = CLASSES, top: int = TOP, model: dict | None = None) -> DataFrame:
    """Scores of all rows of docs (doc_id, text); the Boolean column ``held_out`` keeps rows from training.

    What was learned is put into ``model``, if given: words (DataFrame word, class; beyond them endings decide), endings, pairs.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    train = docs.where(~held_out)
    counts = scratch.table(count_words(train), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = int(total["n"]), int(total["v"])
    least = least_level(counts, top)
    frequent_ = F.lit(False) if least is None else count_level() >= least
    words = counts.where("ending >= 0")
    units = [r["word"] for r in words.orderBy(F.desc("n"), "word").limit(WORDS - 1).select("word").collect()]
    best = counts.where(frequent_ | (F.col("ending") == -1) | F.col("word").isin(units)).toArrow()  # top and WORDS rows at most, and the end
    hash_, ending, n = (best.column(c).to_numpy() for c in ("word", "ending", "n"))
    order = np.argsort(hash_.astype(np.int64).view(np.uint64))
    hash_, ending, n = hash_.astype(np.int64).view(np.uint64)[order], ending[order], n[order]
    own = np.flatnonzero(np.isin(hash_, np.array(units, np.int64).view(np.uint64)) & (ending >= 0))
    lexicon = hash_[own]
    bigrams = count_bigrams(train, lexicon)
    of = exchange(bigrams, classes)
    one = np.eye(classes, dtype=np.int64)[of]
    # All other words that aren't rare: a table that grows with the corpus.
    frequent = counts.where((F.col("ending") >= 0) & (F.col("n") >= LEAST))
    table = word_filter(frequent)
    placed = scratch.table(word_classes(train, spark.sparkContext.broadcast((lexicon, of, one.T @ bigrams @ one, table)), classes), "placed")
    got = placed.where(frequent_).toArrow()  # top rows at most
    cls = np.where(ending >= 0, of[WORDS + np.maximum(ending, 0)], 0)
    cls[np.searchsorted(hash_, got.column("word").to_numpy().astype(np.int64).view(np.uint64))] = got.column("class").to_numpy()
    cls[own] = of[1 : 1 + len(own)]
    tail = placed.where(~frequent_).select("word", "class")
    if not tail.take(1):
        tail = table = None
    sent = spark.sparkContext.broadcast(Classes(hash_, cls.astype(np.int16), of[WORDS:], table, n))  # top entries at most
    # Of the words beyond them, only what may be there is looked up, and in training texts, where all are, only what may be there twice.
    beyond = counts.where(~frequent_ & (F.col("ending") >= 0))
    filters = spark.sparkContext.broadcast((word_filter(beyond), word_filter(beyond.where("n > 1"))) if beyond.take(1) else None)
    # Tokens and words of each class: the first units have one word, rare words come from the counts by ending.
    words_in = np.zeros(classes, np.int64)
    words_in[0] = int((ending == -1).any())
    np.add.at(words_in, of[1 : 1 + len(own)], 1)
    for r in placed.groupBy("class").count().collect():  # classes at most
        words_in[r["class"]] += r["count"]
    for r in counts.where((F.col("ending") >= 0) & (F.col("n") < LEAST)).groupBy("ending").count().collect():  # ENDINGS rows at most
        words_in[of[WORDS + r["ending"]]] += r["count"]
    np.subtract.at(words_in, of[WORDS + ending[own[n[own] < LEAST]]], 1)
    pairs = count_moves(train, sent, tail, classes)
    tokens_in = pairs.sum(0)
    usual = (tokens_in + 1) / (tokens_in.sum() + classes)
    step = np.log10((pairs + BACKOFF * usual) / (pairs.sum(1, keepdims=True) + BACKOFF))
    step = step - np.log10(tokens_in + words_in + 1)  # with the emission's divisor

    if model is not None:
        lexicon_ = spark.createDataFrame([(int(h), int(of[1 + i])) for i, h in enumerate(lexicon.view(np.int64))], "word long, class int")
        model.update(words=placed.select("word", "class").unionByName(lexicon_), endings=of[WORDS:], pairs=pairs)

    def score(batches):
        known, n = sent.value.known, sent.value.n
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for p in pieces(batch.column("text"), lower=True):
                hashes = p.hashes()
                before, token, doc, open_doc, rest = moves(p, hashes, sent.value)
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                c_end = n[np.searchsorted(known, END)] if END in known else 0
                c = np.where(hit, n[at] if len(known) else 0, 0)
                rare = ~hit
                if filters.value is None:
                    rare[:] = False  # all words are known or unseen
                else:
                    seen, twice = filters.value
                    trained = ~np.asarray(batch.column("held_out").slice(p.first, p.n_docs).fill_null(True).to_numpy(zero_copy_only=False), bool)[p.doc]
                    more = np.zeros(len(hashes), bool)
                    more[rare] = passes(twice, hashes[rare])
                    once = rare & trained & ~more
                    c[once] = 1
                    rare &= np.where(trained, more, passes(seen, hashes))
                logs = np.bincount(p.doc, np.log10(c + 1.0), minlength=p.n_docs).astype(float) + np.log10(c_end + 1.0)
                n_known = np.bincount(p.doc[c > 0], minlength=p.n_docs) + int(c_end > 0)
                chain = np.bincount(doc, step[before, token], minlength=p.n_docs).astype(float)  # of no token numpy counts whole numbers
                offsets = np.concatenate([[0], np.cumsum(np.bincount(p.doc[rare], minlength=p.n_docs))])
                rare_words = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes[rare].view(np.int64)))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(open_doc, minlength=p.n_docs))])
                rest = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays(rest, ["ac", "aw", "bc", "bw"]))
                ids = pa.array(np.arange(row, row + p.n_docs))
                row += p.n_docs
                yield pa.RecordBatch.from_arrays([ids, *[batch.column(x).slice(p.first, p.n_docs) for x in ("doc_id", "held_out")], pa.array(np.diff(p.first_word).astype(np.int64) + 1), pa.array(n_known.astype(np.int64)), pa.array(logs), pa.array(chain), rare_words, rest], ["_row", "doc_id", "held_out", "n_tokens", "_known", "_logs", "_chain", "_tail", "_open"])

    schema = "_row long, doc_id long, held_out boolean, n_tokens long, _known long, _logs double, _chain double, _tail array<long>, _open array<struct<ac: int, aw: bigint, bc: int, bw: bigint>>"
    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out")).mapInArrow(score, schema)
    rows = scratch.table(rows, "rows")
    rare = rows.select("_row", F.explode("_tail").alias("word")).join(counts.select("word", "n"), "word")
    rare = rare.groupBy("_row").agg(F.count("*").alias("_n"), F.sum(F.log10(F.col("n") + 1.0)).alias("_more"))
    out = rows.drop("_tail", "_open").join(rare, "_row", "left")
    chain = F.col("_chain")
    if tail is not None:
        steps = spark.createDataFrame([(a, b, float(step[a, b])) for a in range(classes) for b in range(classes)], "ac int, bc int, step double")
        further = look_up(rows.select("_row", F.explode("_open").alias("m")).select("_row", "m.*"), tail).join(steps, ["ac", "bc"])
        out = out.join(further.groupBy("_row").agg(F.sum("step").alias("_further")), "_row", "left")
        chain = chain + F.coalesce("_further", F.lit(0.0))
    logs = F.col("_logs") + F.coalesce("_more", F.lit(0.0))
    n_known = F.col("_known") + F.coalesce("_n", F.lit(0))
    score_ = logs + chain
    base = logs - F.col("n_tokens") * F.log10(F.lit(float(n_all + v_all + 1)))
    perplexity = F.pow(F.lit(10.0), -score_ / F.col("n_tokens"))
    return out.select("doc_id", "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), score_.alias("score"), perplexity.alias("perplexity"))
