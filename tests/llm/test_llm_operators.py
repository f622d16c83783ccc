"""The ten operators against brute force, round trips and edge cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from compare import same
from pyspark.sql import functions as F

from factloom.llm import components, jaccard, language, lm, mixing, packing, quality, queries, secrets, shared, substrings, vectors, warc
from factloom.llm import words as shared_words

EMPTY = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(real):
    return [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df())


# 1


@pytest.mark.parametrize("hot", [24, 1])
def test_jaccard(real, texts, hot):
    assert sorted(map(tuple, jaccard.similar_groups(real, hot_level=hot).collect()), key=str) == brute.components(texts)


def test_jaccard_edges(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, jaccard.similar_groups(docs).collect()), key=str) == brute.components(rows)
    assert jaccard.similar_groups(spark.createDataFrame([], EMPTY)).count() == 0


def test_jaccard_near_copies_in_one_large_bucket(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[:55] + [f"x{k}"] + base[55:] if k % 2 else base[: 60 - k % 12])) for k in range(90)]
    rows += [(1000 + k, " ".join(base[:25] + [f"y{k}z{i}" for i in range(9)])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar_groups(df).collect()), key=str) == brute.components(rows)


def test_jaccard_group_in_many_batches(spark):
    # Copies of a in every batch, a near copy in one; both first meet the dissimilar head, whose id is less.
    word = lambda w, n: [f"{w}{i}" for i in range(n)]
    passage, tail, other = word("s", 40), word("a", 24), word("h", 25)
    a, head = " ".join(passage + tail), " ".join(passage + other)
    rows = [(1 + k, head) for k in range(80)] + [(1000 + k, a) for k in range(80)]
    rows += [(2000 + k, " ".join(tail)) for k in range(300)] + [(3000 + k, " ".join(other)) for k in range(300)]
    np.random.default_rng(2).shuffle(rows)
    rows = [(int(d), str(t)) for d, t in rows] + [(9000, a.replace("a23", "end"))]
    want = brute.components(rows)
    assert dict((d, c) for d, _, c in want)[9000] == 1000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (24, 1):
        assert sorted(map(tuple, jaccard.similar_groups(df, hot_level=hot).collect()), key=str) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (60, 100), (60, 50), (7, 7)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(edges, "a long, b long"), shared.Scratch(spark, "t"), "c").collect()))
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 60: 50, 100: 50}
    assert components.connected(spark.createDataFrame([], "a long, b long"), shared.Scratch(spark, "t"), "e").count() == 0


def test_jaccard_of_shared_passages(spark, monkeypatch):
    """Texts of 7 of 24 passages: nearly every pair shares some, and next to none is similar."""
    rng = np.random.default_rng(7)
    passage = [" ".join(f"p{k}w{i}" for i in range(40)) for k in range(24)]
    rows = [(d, " ".join(passage[k] for k in rng.choice(24, 7, replace=False))) for d in range(400)]
    seen = {}
    table = shared.Scratch.table
    monkeypatch.setattr(shared.Scratch, "table", lambda self, df, name, *a: (out := table(self, df, name, *a), seen.update({name: out.count()}))[0])
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute.components(rows)
    assert seen["tried"] + seen["rest"] < 2000  # of 79800


def test_jaccard_large_buckets_meet_in_blocks(spark, monkeypatch):
    """One prefix and size, many endings; blocks of 8, so the hot bucket is dealt to many of them."""
    monkeypatch.setattr(jaccard, "SIDE", 8)
    head = [f"h{i}" for i in range(30)]
    rows = [(d, " ".join(head + [f"x{d % 25}y{i}" for i in range(10 + d % 3)])) for d in range(120)]
    rows += [(500 + d, " ".join([f"x{d}y{i}" for i in range(12)] + head[: 24 + d % 5])) for d in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (24, 1):
        assert sorted(map(tuple, jaccard.similar_groups(df, hot_level=hot).collect()), key=str) == brute.components(rows)


def test_jaccard_leader_that_links_half(spark, monkeypatch):
    """Near copies of one text with one or two words changed: two changes each are too many, so the least id links but half."""
    rng, base = np.random.default_rng(5), [f"w{i}" for i in range(120)]
    rows = []
    for d in range(240):
        words = list(base)
        for i in rng.choice(np.arange(5, 115, 5), 1 + (d + 1) % 2, replace=False):
            words[i] = f"x{d}y{i}"
        rows.append((d, " ".join(words)))
    seen = {}
    table = shared.Scratch.table
    monkeypatch.setattr(shared.Scratch, "table", lambda self, df, name, *a: (out := table(self, df, name, *a), seen.update({name: out.count()}))[0])
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute.components(rows)
    assert sum(n for name, n in seen.items() if name.startswith(("tried", "rest"))) < 10 * len(rows)  # of 28680


def test_jaccard_turns_leave_few_pairs(spark, monkeypatch):
    """Near copies with 1 to 4 words changed, where 5 changes are the most a pair may have: one leader links but a part, many leaders nearly all."""
    rng, base, rows = np.random.default_rng(11), [f"w{i}" for i in range(200)], []
    for d in range(200):
        words = list(base)
        for i in rng.choice(np.arange(5, 195, 6), 4 if d < 2 else rng.integers(1, 5), replace=False):
            words[i] = f"x{d}y{i}"
        rows.append((d, " ".join(words)))
    seen, met = {}, []
    table, meet = shared.Scratch.table, jaccard.meet
    monkeypatch.setattr(shared.Scratch, "table", lambda self, df, name, *a: (out := table(self, df, name, *a), seen.update({name: out}))[0])
    monkeypatch.setattr(jaccard, "meet", lambda rows, key, *a: (out := meet(rows, key, *a), met.append(out.count()) if key == "bucket" else None)[0])
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute.components(rows)
    assert len(met) == 1 and met[0] < 15 * len(rows)
    assert seen["near-0"].select(F.explode("l")).distinct().count() > 15  # buckets have leaders of their own


def test_jaccard_joins_only_buckets_that_can_suffice(spark, monkeypatch):
    """Pairs of texts that share two shingles, fewer than partners must, don't join; mutated texts of all lengths are linked as by brute force."""
    rng, rows = np.random.default_rng(7), []
    for d in range(200):
        rows.append((d, " ".join([*(f"a{d}x{i}" for i in range(20)), *(f"p{d // 2}y{i}" for i in range(6)), *(f"b{d}z{i}" for i in range(14))])))
    seen = {}
    table = shared.Scratch.table
    monkeypatch.setattr(shared.Scratch, "table", lambda self, df, name, *a: (out := table(self, df, name, *a), seen.update({name: out.count()}))[0])
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute.components(rows)
    assert seen["found"] > 0
    assert seen["held"] == 0
    rows = []
    for d in range(240):
        words = [f"t{d % 12}w{i}" for i in range(6 + 9 * (d % 12))]
        for i in rng.choice(len(words), rng.integers(0, 2 + len(words) // 25), replace=False):
            words[i] = f"x{rng.integers(0, 6)}"
        rows.append((d, " ".join([*words, *(f"common{i}" for i in range(d % 9))])))
    for hot in (24, 1):
        got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), hot_level=hot)
        assert sorted(map(tuple, got.collect()), key=str) == brute.components(rows)
        assert seen["rest"] > 0


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in (0, 1, 50, 300, 900)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    bits = jaccard.parity(np.concatenate(sets), bounds)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert sum(int(a).bit_count() for a in (bits[i] ^ bits[j]).view(np.uint64)) <= len(np.setxor1d(x, y))


CLASH = ("n_shingles", "component_id", "grp", "fp1", "bits", "bucket", "n_words", "n_removed", "kept_sha256", "start", "_key", "lang_pred", "score", "held_out", "n_tokens", "bucket_len", "batch_id", "place", "padding", "size", "target", "taken", "source_size", "word", "class", "spans", "found", "hash", "owner", "repo", "kept", "base_failed", "a", "b", "n", "k")


def test_columns_that_clash_change_nothing(spark, docs):
    """Every operator on documents gives the same rows beside columns named like its own."""
    plain = docs.select("doc_id", "text", "lang", "source")
    more = plain.withColumns({c: F.lit(f"own {c}") for c in CLASH})
    labels = spark.createDataFrame([(k, k % 2) for k in range(13)], "doc_id long, quality int")
    lab = labels.withColumns({c: F.lit(1) for c in ("text", "label", "x", "kept")})
    rows = lambda df: sorted(map(str, df.collect()))
    for f in (
        jaccard.similar_groups, substrings.remove_repeats, lambda d: language.predict(d, language.learn(d)), lambda d: packing.pack(d).select("doc_id", "n_tokens", "bucket_len", "batch_id", "place", "padding"), mixing.mix_sources,
        lambda d: lm.class_lm(d, F.lit(False)), lambda d: secrets.secret_spans(d).drop("_key"), lambda d: secrets.redact(d).select("doc_id", "text"), quality.quality_rules,
    ):
        assert rows(f(plain)) == rows(f(more))
    assert (quality.fit(plain, labels) == quality.fit(more, lab)).all()


# 2


def test_warc_round_trip(spark):
    tail = b"x" * 1000 + b"\r\n\r\n\r\n\r\n" + bytes(range(256))
    rows = [(1, "u", b"a\r\n\r\n", 1), (2, None, b"\r\n\r\nx\r", 1), (3, "u", None, 1), (4, "u", b"\r", 1), (5, "u", b"\r\n\r", 1), (7, "u", tail, 1), (6, " a b", tail, 1), (8, "u", b"\r\n\r\n" * 60, 1), (9, "", b"short", 1), (10, "", b"short", 1), (11, "v", b"WARC/1.1\r\n", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html binary, digest int")
    for chunk in (7, 100, 1 << 20):
        got = {r.page_id: r for r in warc.archive_round_trip(pages, chunk=chunk).collect()}
        assert len(got) == len(rows)
        for i, _, x, _ in rows:
            x = x or b""
            want = ("revisit", 6) if i == 7 else ("response", None)
            assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(x), hashlib.sha256(x).hexdigest(), *want)
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_equal_and_null_ids(spark):
    long_, mid = b"z" * 1_500_000, b"y" * 200
    rows = [(5, "u", long_), (5, "u", long_), (5, "v", long_), (9, "u", long_), (7, "u", mid), (7, "u", mid), (None, "u", mid), (None, None, b"x" * 150), (None, "u", b"x" * 150), (8, "u", b"short"), (8, "u", b"short"), (None, None, None)]
    got = warc.archive_round_trip(spark.createDataFrame([(*r, "a", 1) for r in rows], "page_id long, url string, html binary, record_type string, chunk_no int"))
    want = []
    for payload in {x for _, _, x in rows}:
        ids = sorted((i for i, _, x in rows if x == payload), key=lambda i: (i is None, i))
        x = payload or b""
        want += [(i, len(x), hashlib.sha256(x).hexdigest(), *(("revisit", ids[0]) if k and len(x) >= 100 else ("response", None))) for k, i in enumerate(ids)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_warc_chunks_carry_running_digests(spark, tmp_path):
    data = bytes(range(256)) * 3
    pages = spark.createDataFrame([(1, "u", data)], "page_id long, url string, payload binary")
    warc.write_archives(warc.roles(pages, shared.Scratch(spark, "t")), f"file://{tmp_path}/a", 100)
    rows = warc.read_archives(spark, f"file://{tmp_path}/a").orderBy("chunk_no").collect()
    assert [r.offset for r in rows] == list(range(0, 768, 100)) and b"".join(bytes(r.data) for r in rows) == data
    assert [r.through for r in rows] == [hashlib.sha256(data[: r.offset + 100]).hexdigest() for r in rows]


def test_warc_notices_damage(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(20)], "page_id long, url string, payload string").withColumn("payload", F.encode("payload", "UTF-8"))
    warc.write_archives(warc.roles(pages, shared.Scratch(spark, "t")), f"file://{tmp_path}/a", 64)
    chunks = warc.read_archives(spark, f"file://{tmp_path}/a")
    assert chunks.count() > 100 and warc.records_of(chunks).count() == 20
    for damaged in (chunks.where("page_id IS NOT NULL OR chunk_no <> 2"), chunks.withColumn("data", F.when(F.col("chunk_no") == 1, F.lit(b"?")).otherwise(F.col("data")))):
        with pytest.raises(Exception, match="chunk"):
            warc.records_of(damaged).count()


# 3


def test_substrings(real, texts):
    assert sorted(map(tuple, substrings.remove_repeats(real).collect())) == sorted(brute.repeats(texts, 35))


@pytest.mark.parametrize(("window", "run"), [(3, 2), (4, 2), (5, 4), (35, 4)])
def test_substrings_edges(spark, docs, window, run):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(20, "a b c d e f a b c d e"), (21, "\n q  r\ts a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substrings.remove_repeats(df, window, run).collect()), key=str) == sorted(brute.repeats(rows, window), key=str)


def test_substrings_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0
    kept = substrings.remove_repeats(spark.createDataFrame([(1, "a b c x"), (2, "a b c y")], "doc_id long, text string"), 3, 2, with_text=True)
    assert sorted(r.kept_text for r in kept.collect()) == ["x", "y"]


def test_substrings_shelf_is_read_in_pieces(monkeypatch):
    """Tables of powers, which a worker keeps, stay those of a piece; repetitions meet across pieces."""
    words = [" ".join(f"w{x}" for x in np.random.default_rng(k).integers(0, 100_000, 200)) for k in range(2600)]
    words.append(words[0])
    n, size = len(words), 200 - substrings.WINDOW + 1
    rows = np.rec.fromarrays([np.arange(n), np.zeros(n, np.int32), np.zeros(n, np.int32), np.full(n, size, np.int32), [len(x) for x in words]], names="id,key,start,size,len")
    pack = substrings.zstandard.ZstdCompressor().compress
    shelf = substrings._batch([(0, 0, n, pack(substrings._meta(rows, np.zeros(n, bool))), pack("".join(words).encode()))])
    assert sum(map(len, words)) > 3 * shared_words.PIECE
    for name in ("_powers", "_undo"):
        monkeypatch.setattr(shared_words, name, np.ones(1, np.uint64))
    found = [tuple(r.values()) for b in substrings._count(substrings.WINDOW)([shelf]) for r in b.to_pylist()]
    assert sorted(found) == [(0, 0, 0, size), (n - 1, 0, 0, size)]
    assert len(shared_words._powers) <= shared_words.PIECE + 1


def test_rolling_min():
    x = np.array([5, 3, 9, 1, 4, 8, 7, 2], np.uint64)
    for w in range(1, 9):
        assert substrings.rolling_min(x, w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]


# 4


def test_language(spark, real, docs, sf_dir):
    got = queries.op4_language_filters(spark, sf_dir).toPandas().merge(real.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()
    out = {r.doc_id: r for r in language.predict(docs, language.learn(docs)).collect()}
    assert all(out[i].lang_pred == "und" for i in (4, 5, 6, 11)) and out[10].lang_pred in ("en", "de", "fr")
    none = language.learn(spark.createDataFrame([], EMPTY))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(spark.createDataFrame([], EMPTY), none).count() == 0


def test_language_filters_hold_the_most_frequent(spark, docs):
    """Filters, answers, correction and verdict against plain loops."""
    size, width = 50, 1 << language.GRAM_BITS
    langs, slots, _ = language.learn(docs, size)
    grams = lambda t: [g for p in shared.pieces(pa.array([t])) for n in language.NGRAMS for g in (language.grams(p, n)[0] & np.uint32(width - 1)).tolist()]
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    assert langs == sorted({x for _, t, x in rows if t is not None})
    held, bits = {}, np.zeros(1 << language.SLOT_BITS, np.uint64)
    for k, lang in enumerate(langs):
        counts = Counter(g for _, t, x in rows if x == lang and t is not None for g in grams(t))
        held[lang] = sorted((g for g in counts if counts[g] > 1), key=lambda g: (-counts[g], g))[:size]
        for g in held[lang]:
            for j in range(language.HASHES):
                bits[int(language.slot(np.array([g], np.uint64), j)[0])] |= np.uint64(1 << k)
    assert (slots == bits).all() and any(set(held[a]) & set(held[b]) for a in langs for b in langs if a < b)  # n-grams of several languages too
    masks = language.answers(slots)[0]
    for k, lang in enumerate(langs):
        assert all(int(masks[g]) >> k & 1 for g in held[lang])
    wrong = [np.mean(masks >> np.uint64(k) & np.uint64(1)) for k in range(len(langs))]
    got = {r.doc_id: r for r in language.predict(docs, (langs, slots, "en")).collect()}
    for d, t, _ in rows:
        mine = grams(t or "")
        right = [min(max((sum(int(masks[g]) >> k & 1 for g in mine) - wrong[k] * len(mine)) / (1 - wrong[k]), 0), len(mine)) for k in range(len(langs))]
        if not any(c.isalpha() for c in t or ""):
            assert (got[d].lang_pred, got[d].score) == ("und", 0)
        elif max(right) > 0:
            assert got[d].lang_pred == langs[right.index(max(right))] and math.isclose(got[d].score, max(right) / len(mine))


def test_language_correction_counts_collisions():
    """Foreign n-grams that answer by a shared class or slot add nothing, on average."""
    rng = np.random.default_rng(3)
    held = rng.choice(1 << language.GRAM_BITS, 20_000, replace=False).astype(np.uint64)
    slots = np.zeros((1, 1 << language.SLOT_BITS), np.uint64)
    for j in range(language.HASHES):
        slots[0, language.slot(held, j)] |= np.uint64(1)
    masks = language.answers(slots)[0]
    wrong = np.array([masks.mean()])
    foreign = rng.integers(0, 1 << language.GRAM_BITS, 200_000)
    hits = np.array([[masks[foreign].sum()]], float)
    assert hits[0, 0] > 3000 and language.corrected(hits, np.array([200_000.0]), wrong)[0, 0] < 400
    mixed = np.concatenate([foreign[:100_000], rng.choice(held, 100_000).astype(np.int64)])
    assert abs(language.corrected(np.array([[masks[mixed].sum()]], float), np.array([200_000.0]), wrong)[0, 0] - 100_000) < 500


def test_more_languages_than_a_mask_has_bits(spark):
    rng = np.random.default_rng(1)
    word = lambda k: "".join(chr(97 + x) for x in rng.integers(0, 26, 9))
    rows = [(k, f"{word(k)} " * 30, f"l{k:03d}", "a") for k in range(150)] + [(900, "e", "l000", "a")]
    df = spark.createDataFrame(rows, EMPTY)
    model = language.learn(df)
    assert len(model[0]) == 150 and model[1].shape[0] == 3
    got = {r.doc_id: r.lang_pred for r in language.predict(df, model).collect()}
    assert sum(got[k] == f"l{k:03d}" for k in range(150)) == 150


# 5


def test_boundaries():
    rng = np.random.default_rng(1)
    from itertools import combinations

    for top in (60, 30_000):  # short lengths and long ones
        for buckets in (1, 2, 3, 4, 9):
            n = rng.choice(top, 9, replace=False) + 1
            n.sort()
            c = rng.integers(1, 9, 9)
            ends, cost = packing.boundaries(n, c, buckets)
            pad = lambda e: sum(k * (min(x for x in e if x >= m) - m) for m, k in zip(n.tolist(), c.tolist(), strict=True))  # noqa: B023, E731
            best = min(pad((*e, n[-1])) for r in range(min(buckets, 9)) for e in combinations(n[:-1], r))
            assert cost == best == pad(ends) and len(ends) <= buckets
    assert packing.boundaries(*[np.array([], int)] * 2) == ([], 0)


def test_boundaries_are_optimal_for_long_histograms():
    rng = np.random.default_rng(2)
    for n in (400, 700):
        length = np.sort(rng.choice(100_000, n, replace=False) + 1)
        count = rng.integers(1, 50, n)
        c, s = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * length)])
        cost = np.concatenate([[0], c[1:] * length - s[1:]])
        for _ in range(15):
            cost = np.concatenate([[0], [min(cost[j], (cost[:j] + (c[j] - c[:j]) * length[j - 1] - (s[j] - s[:j])).min()) for j in range(1, n + 1)]])
        ends, got = packing.boundaries(length, count, 16)
        up = np.array(ends)[np.searchsorted(ends, length)]
        assert got == cost[n] == ((up - length) * count).sum() and len(ends) == 16


def test_packing(spark, real, docs):
    for df in (real, docs):
        got = packing.pack(df.select("doc_id", "text"), budget=4096).toPandas()
        words = Counter((d, len(brute.WORD.findall(t or ""))) for d, t in df.select("doc_id", "text").collect())
        assert Counter((None if pd.isna(d) else int(d), int(n)) for d, n in zip(got.doc_id, got.n_tokens, strict=True)) == words
        full = got[got.n_tokens > 0]
        assert got[got.n_tokens == 0].batch_id.isna().all() and (full.padding >= 0).all()
        for (end, _), g in full.groupby(["bucket_len", "batch_id"]):
            assert sorted(g.place) == list(range(len(g))) and (len(g) * end <= 4096 or len(g) == 1)
        sizes = full.groupby("bucket_len").batch_id.agg(["max", "nunique"])
        assert (sizes["max"] + 1 == sizes["nunique"]).all()
    assert packing.pack(spark.createDataFrame([], EMPTY)).count() == 0


def test_packing_ends_are_the_best(spark):
    n = [2049, 2051, 3000, 3001, 5003, 9001, 9002]
    df = spark.createDataFrame([(k, "x " * m, "y") for k, m in enumerate(n)], "doc_id long, text string, padding string")
    got = packing.pack(df, buckets=3).toPandas()
    assert set(got.bucket_len) == {3001, 5003, 9002} and got.padding.sum() == 952 + 950 + 1 + 1
    got = packing.pack(df, buckets=4).toPandas()
    assert set(got.bucket_len) == {2051, 3001, 5003, 9002} and got.padding.sum() == 2 + 1 + 1


# 6


def test_mixing(spark, docs):
    got = mixing.mix_sources(docs).toPandas()
    assert len(got) == docs.count() and (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(size=("source_size", "first"), target=("target", "first"), own=("size", "sum"))
    assert (by["size"] == by.own).all() and (by.target <= 3 * by["size"] + 1e-9).all() and math.isclose(by.target.sum(), got["size"].sum())
    same(got, mixing.mix_sources(docs.repartition(3)).toPandas())
    assert mixing.mix_sources(spark.createDataFrame([], EMPTY)).count() == 0
    none = mixing.mix_sources(spark.createDataFrame([(1, None, "en", "a"), (2, "", "en", "b")], EMPTY)).toPandas()
    assert none.taken.tolist() == [0, 0]


def test_mixing_takes_near_the_targets(spark, real):
    got = mixing.mix_sources(real).toPandas()
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.most).all()


def test_running_totals(spark):
    rows = [(k % 3 if k % 5 else None, k * 7 % 100, k) for k in range(200)]
    df = spark.createDataFrame(rows + rows[:5], "g int, o long, v long")
    got = shared.running_totals(df, shared.Scratch(spark, "t"), "r", ["g"], [F.col("o"), F.col("v")], "v", "total").toPandas()
    want = defaultdict(list)
    for g, o, v in sorted(rows + rows[:5], key=lambda r: (r[1], r[2])):
        want[g].append((want[g][-1] if want[g] else 0) + v)
    for g, part in got.groupby("g", dropna=False):
        assert sorted(part.total) == sorted(want[None if pd.isna(g) else int(g)])


# 7


@pytest.mark.parametrize("top", [lm.TOP, 500])
def test_class_lm(real, texts, top):
    got = lm.class_lm(real, language.held_out(F.col("doc_id"), 7, 2), top=top).toPandas().set_index("doc_id")
    tokens = {d: [*brute.WORD.findall(brute.low(t or "")), None] for d, t in texts}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = Counter(w for d, t in tokens.items() if not held[d] for w in t)
    n, v = sum(c.values()), len(c)
    for d, t in tokens.items():
        r = got.loc[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(c[w] > 0 for w in t), n, held[d])
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum() and (got.score < 0).all()


@pytest.mark.parametrize("top", [lm.TOP, 1500])
def test_class_lm_score(real, texts, top):
    """Class bigrams and the whole score against plain loops, from the classes that were learned."""
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in texts}
    model = {}
    got = {r.doc_id: r.score for r in lm.class_lm(real, language.held_out(F.col("doc_id"), 7, 2), top=top, model=model).collect()}
    of = {r.word: r["class"] for r in model["words"].collect()}
    cls, count, tokens = {}, Counter(), {}
    for d, t in texts:
        words = brute.WORD.findall(brute.low(t or ""))
        for p in shared.pieces(pa.array([t or ""]), lower=True):
            for w, h, e in zip(words, p.hashes().view(np.int64).tolist(), lm.endings(p).tolist(), strict=True):
                cls[w] = of.get(h, int(model["endings"][e]))
        tokens[d] = [*words, None]
        if not held[d]:
            count.update(tokens[d])
    cls[None] = 0
    frequent = [w for w in count if w is not None and count[w] >= lm.LEAST]
    assert len(frequent) > 1100 and len(of) >= len(frequent)  # every word met often enough has a class of its own
    pairs, words_in = np.zeros((lm.CLASSES, lm.CLASSES)), np.zeros(lm.CLASSES)
    chain = lambda d: zip([0, *(cls[w] for w in tokens[d][:-1])], tokens[d], strict=True)
    for d in tokens:
        if not held[d]:
            for b, w in chain(d):
                pairs[b, cls[w]] += 1
    for w in count:
        words_in[cls[w]] += 1
    assert (pairs == model["pairs"]).all()
    n = pairs.sum(0)
    usual = (n + 1) / (n.sum() + lm.CLASSES)
    for d in tokens:
        want = sum(math.log10((pairs[b, cls[w]] + lm.BACKOFF * usual[cls[w]]) / (pairs[b].sum() + lm.BACKOFF) * (count[w] + 1) / (n[cls[w]] + words_in[cls[w]] + 1)) for b, w in chain(d))
        assert math.isclose(got[d], want, rel_tol=1e-9)


def test_class_lm_looks_up_only_what_may_be_there(real, monkeypatch):
    """Beyond the broadcast words, tokens without a count, and in training texts those met once, need no join."""
    kept = {}
    table = shared.Scratch.table
    monkeypatch.setattr(shared.Scratch, "table", lambda self, df, name, *a: kept.setdefault(name, table(self, df, name, *a)))
    lm.class_lm(real, language.held_out(F.col("doc_id"), 7, 2), top=500)
    tail = kept["rows"].select("held_out", F.explode("_tail").alias("word")).join(kept["counts"].select("word", "n"), "word", "left")
    got = {(r.held_out, r.n): r["count"] for r in tail.groupBy("held_out", "n").count().collect()}
    assert (True, 1) in got and (False, 2) in got
    assert (True, None) not in got and (False, 1) not in got


def test_class_lm_edges(spark, docs):
    got = lm.class_lm(docs, F.lit(False)).collect()
    assert len(got) == docs.count() and {r.n_tokens for r in got if r.doc_id in (4, 5, 6)} == {1}
    assert all(math.isfinite(r.score) for r in got)
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in lm.class_lm(docs, F.lit(True)).collect())
    assert lm.class_lm(spark.createDataFrame([], EMPTY), F.lit(False)).count() == 0


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    b = np.zeros((41, 41), np.int64)
    for _ in range(20_000):  # evens follow odds, odds follow evens
        u = rng.integers(1, 41)
        b[u, rng.integers(0, 20) * 2 + 1 + u % 2] += 1
    of = lm.exchange(b, 3)
    assert of[0] == 0 and len(set(of[1::2])) == len(set(of[2::2])) == 1 and of[1] != of[2]


def test_best_classes_gain_most():
    rng = np.random.default_rng(4)
    b = rng.integers(0, 9, (14, 14))
    of = np.array([0, *rng.integers(1, 5, 13)])
    likely = lambda of: lm._xlogx(np.eye(5)[of].T @ b @ np.eye(5)[of]).sum() - sum(lm._xlogx(np.eye(5)[of].T @ b.sum(k)).sum() for k in (0, 1))
    for u in range(14):  # equal row and column sums, as in chains
        d = int(b[u].sum() - b[:, u].sum())
        b[u, 0], b[0, u] = b[u, 0] + max(-d, 0), b[0, u] + max(d, 0)
    one = np.eye(5, dtype=int)[of]
    got = lm.best_classes(one.T @ b @ one, of, b @ one, b.T @ one, np.diag(b))
    for u in range(1, 14):
        at = [likely(np.where(np.arange(14) == u, k, of)) for k in range(1, 5)]
        assert math.isclose(at[got[u] - 1], max(at))


def test_class_lm_joined_classes_are_those_sent(real):
    a, b = (lm.class_lm(real, language.held_out(F.col("doc_id"), 7, 2), top=top).toPandas().set_index("doc_id").score for top in (lm.TOP, 1200))
    assert (a - b).abs().max() < 1e-8


def test_class_lm_places_words_beyond_the_first_units(spark):
    # 2000 words of one ending: evens follow odds, odds follow evens.
    rng = np.random.default_rng(6)
    rows = [(d, " ".join(f"w{2 * rng.integers(0, 1000) + k % 2}xyz" for k in range(200))) for d in range(200)]
    rows += [(1000, "w1998xyz w1999xyz " * 50), (1001, "w1998xyz w1996xyz " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [lm.class_lm(df, F.col("doc_id") >= 1000, top=top).toPandas().set_index("doc_id").score for top in (lm.TOP, 1100)]
    assert all(s.loc[1000] - s.loc[1001] > 50 for s in got)  # classes tell which order is usual, for joined words too


# 8


def test_secrets_base(spark, real, docs):
    key = "AKIA" + "Q7" * 8
    odd = [(50, "secret=token:abcdefgh token=secret=abcdefgh ſecret=abcdefgh API_KEY: 'zzzzzz'", "en", "a", 0), (51, f"é日 {key} {key}x {'af' * 12} apikey=\"{'0f' * 20}\"", "en", "b", 0), (52, "password=" + "a" * 50_000, "en", "b", 0)]
    for df in (real, docs.unionByName(spark.createDataFrame(odd, docs.schema))):
        texts = [(r.doc_id, r.text) for r in df.collect()]
        got = secrets.secret_spans(df).collect()
        assert len(got) == len(texts)
        want = Counter((d, *[n[k] for k in ("assign", "access", "hex")], hashlib.sha256(s.encode()).hexdigest()) for d, t in texts for s, n in [brute.base_spans(t)])
        assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
        for r in got:
            mine = [s for s in r.spans.split(",") if s and not s.startswith("live:")]
            assert hashlib.sha256(",".join(mine).encode()).hexdigest() == r.base_sha256
    assert secrets.secret_spans(spark.createDataFrame([], EMPTY)).count() == 0


def test_secrets_ownership(spark):
    common, own = "Zx9Qw8Er7Ty6Ui5Op4As3D", "Mn1Bv2Cx3Zl4Kj5Hg6Fd7S"
    rows = [(k, f"see {common} here", "en", f"s{k}") for k in range(6)] + [(10, f"see {own} and password=hunter2hunter2", "en", "s1")]
    df = spark.createDataFrame(rows, EMPTY)
    got = {r.doc_id: r for r in secrets.secret_spans(df).collect()}
    assert all(got[k].spans == "" for k in range(6))
    assert got[10].spans == "live:4:26,assign:31:54" and got[10].n_live == 2
    out = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert out[10] == "see [SECRET] and [SECRET]" and out[0] == rows[0][1] and len(out) == 7


def test_secrets_null_owner_is_one_holder(spark):
    value = "Zx9Qw8Er7Ty6Ui5Op4As3D"
    rows = [(k, f"see {value}", "en", s) for k, s in enumerate([None, "", "a", None])]
    assert {r.n_live for r in secrets.secret_spans(spark.createDataFrame(rows, EMPTY)).collect()} == {1}  # three holders
    got = secrets.secret_spans(spark.createDataFrame([*rows, (9, f"see {value}", "en", "b")], EMPTY).withColumn("spans", F.lit(1)).withColumn("hash", F.lit(2))).collect()
    assert {(r.n_live, r.spans) for r in got} == {(0, "")} and len(got) == 5


def test_further_spans_walk_once():
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdefXYZ0123456789"), n))
    text = " ".join(f"token={word(30)}" if k % 3 else word(24) + "/" + word(9) for k in range(400))
    base = secrets.base_spans(text)
    want = [m.span() for m in secrets.MIXED.finditer(text) if secrets.entropy(m[0]) >= 3.5 and not any(a < m.end() and m.start() < b for a, _, b, _ in base)]
    assert [(a, b) for a, _, b, _ in secrets.further_spans(text, base)] == want and want


# 9


def _top(rows, every=20, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return [(q, n + 1, i, -s) for a, (q, v) in enumerate(ok) if q % every == 0 for n, (s, i) in enumerate(sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for b, (i, w) in enumerate(ok) if a != b and len(v) == len(w))[:k])]


@pytest.mark.parametrize(("block", "query_block", "scale"), [(4096, 1024, 1), (50, 3, 1), (20, 1000, 1), (4096, 1024, 1e12)])
def test_top_k(spark, block, query_block, scale):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) * scale for x in np.round(rng.normal(size=40) * rng.random(40), 2)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(30)] + [(400, None), (420, [None] * 40), (440, [float("nan")] * 40), (460, [float("inf")] * 40), (None, rows[1][1])]
    rows += [rows[20], rows[20], rows[7], (20, rows[21][1])]  # repeated rows, and an id again
    rows += [(500 + i, rows[i][1][:7]) for i in range(0, 60, 3)] + [(600, []), (601, []), (620, [1.0])]  # other lengths
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    if scale == 1:
        got = vectors.top_k(df, block=block, query_block=query_block).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(_top(rows))
    else:  # sums beyond a long raise rather than wrap
        with pytest.raises(Exception):  # noqa: B017
            vectors.top_k(df, block=block, query_block=query_block).collect()
    assert vectors.top_k(df.limit(0)).count() == 0
    if scale == 1:
        assert vectors.top_k(df.where("vec_id < 3")).count() == 2


def test_top_k_sends_only_cells_that_matter(spark, monkeypatch):
    rng = np.random.default_rng(8)  # clusters far apart: a query's best lie in its own
    rows = [(i, [float(x) for x in rng.normal(size=8) * 0.01 + 4 * np.eye(8)[i % 8]]) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = []
    table = shared.Scratch.table
    monkeypatch.setattr(shared.Scratch, "table", lambda self, df, name, *a: (out := table(self, df, name, *a), name == "pairs" and asked.append(out.count()))[0])
    got = vectors.top_k(df, k=5, block=40, query_block=10).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(_top(rows, k=5))
    assert asked[0] < 60  # of some 5 query blocks x 25 candidate blocks; neighbours share a query block


# 10


def test_quality_counts(real, docs):
    for df in (real, docs):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = quality.quality_rules(df).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == Counter((d, *brute.counts(t)) for d, t in rows)
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_quality_keeps_clean_documents(spark, real, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = queries.op10_line_field(spark, sf_dir).toPandas().merge(labels.toPandas(), on="doc_id")
    got = got[~got.base_failed]
    assert got[got.quality == 1].kept.mean() > 0.97 and got[got.quality == 0].kept.mean() < 0.5
    with pytest.warns(UserWarning, match="both kinds"):
        assert (quality.fit(real, labels.limit(0)) == quality.DEFAULT).all()
    assert quality.quality_rules(spark.createDataFrame([], EMPTY)).count() == 0


def test_quality_learns_from_whole_documents(spark, monkeypatch):
    rows = [(k, "\n".join(["plain words of a line"] * 150 + ["# | # | #"] * 50)) for k in range(9)] + [(9, "one\ntwo")]
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, doc, label: seen.append((x, doc)))
    quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, quality int"))
    x, seq = seen[0]
    assert len(x) == 9 * quality.MAX_TRAIN_LINES + 2 and len(set(seq)) == 9 * 4 + 1 and (np.diff(seq) >= 0).all()
    assert (x[:, 4] == 1).sum() == 9 * quality.MAX_TRAIN_LINES // 4  # the symbols of the last quarter


def test_viterbi():
    from itertools import product

    rng = np.random.default_rng(5)
    doc = np.repeat(np.arange(8), [1, 5, 2, 7, 3, 1, 6, 4])
    x, w = rng.normal(size=(len(doc), 3)), rng.normal(size=7)
    mark = quality.viterbi(x, doc, w)
    for d in range(8):
        e = x[doc == d] @ w[:3]
        score = lambda y: sum(e[i] * y[i] for i in range(len(y))) + sum(w[3 + 2 * a + b] for a, b in zip(y, y[1:], strict=False))  # noqa: B023, E731
        assert math.isclose(score([int(m) for m in mark[doc == d]]), max(score(y) for y in product((0, 1), repeat=len(e))))
