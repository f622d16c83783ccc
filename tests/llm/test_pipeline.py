"""The pipeline's stages, each against brute force on what it was given."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from factloom.llm import mixing, secrets
from factloom.llm.shared import Scratch, classified


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    scratch, out = Scratch(spark, "t"), [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for k, (_, f) in enumerate(P.STAGES):
        out.append(scratch.table(f(spark, out[-1], sf_dir), f"s{k}"))
    return out


def test_columns(stages):
    assert [n for n, _ in P.STAGES] == ["language ID", "n-gram Jaccard join", "secret scans", "mixing", "packing"]
    assert all(tuple(df.columns) == P.COLUMNS and df.dtypes == stages[0].dtypes for df in stages[:-1])


def test_language_keeps_clean(stages, spark, sf_dir):
    clean = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    kept = clean.join(stages[1], "doc_id", "left_semi").count()
    assert kept >= 0.99 * clean.count()
    assert stages[1].where(r"NOT text RLIKE '\\p{L}'").count() == 0


def test_one_of_each_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted({c for _, _, c in brute.components(rows)})


def test_secrets_are_masked(stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[2:4])
    assert before.keys() == after.keys()
    spans = {r.doc_id: r for r in secrets.secret_spans(stages[2]).collect()}
    for d, r in after.items():
        assert r.n_chars == len(r.text) and (r.text == before[d].text) == (spans[d].n_live == 0)
    assert secrets.secret_spans(stages[3]).where("n_live > 0").count() == 0


def test_mix_repeats_documents(stages):
    want = {r.doc_id: r.taken // r["size"] for r in mixing.mix_sources(stages[3]).where("taken > 0").collect()}
    got = {r.doc_id: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert got == want


def test_everything_is_packed(stages):
    packed = stages[5].collect()
    assert len(packed) == stages[4].count() and all(r.batch_id is not None for r in packed)
    assert len({(r.bucket_len, r.batch_id, r.place) for r in packed}) == len(packed)


def test_stages_stand_edge_cases(spark, docs, sf_dir):
    rows = docs.selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS LONG) AS n_chars")
    same_id = rows.where("doc_id = 12").withColumn("text", F.lit("password=q8Z7w6E5r4T3 and a text of its own under an id that is taken"))
    rows = rows.unionByName(same_id).unionByName(rows.where("doc_id = 9"))
    df, kept = rows.withColumn("size", F.lit(1)).withColumn("grp", F.lit("x")), []
    for name, stage in P.STAGES:
        df = Scratch(spark, "edge").table(stage(spark, df, sf_dir), "s")
        if name != "packing":
            assert df.dtypes == rows.dtypes
            kept.append(sorted(((r.doc_id, r.text) for r in df.collect()), key=str))
    given = sorted(((r.doc_id, r.text) for r in rows.collect()), key=str)
    # Nulls, nothing and texts without letters go; the long text and those of id 12 stay.
    assert all(x in given and (x[0] not in (4, 5, 6, 11)) for x in kept[0]) and {9, 12} <= {d for d, _ in kept[0]}
    texts = dict(enumerate(kept[0]))
    first = {min((texts[i][0] is None, texts[i][0] or 0, i) for i in texts if c[i] == k) for c in [{n: k for n, _, k in brute.components([(i, t) for i, (_, t) in texts.items()])}] for k in c.values()}
    assert kept[1] == sorted((texts[i] for _, _, i in first), key=str)
    assert not any("q8Z7w6E5r4T3" in t for _, t in kept[2]) and len(kept[2]) == len(kept[1])
    assert set(kept[3]) <= set(kept[2])
    packed = df.collect()
    assert len(packed) == len(kept[3]) and all(r.padding >= 0 for r in packed)


def test_stages_of_nothing(spark, sf_dir):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        df = Scratch(spark, "none").table(stage(spark, df, sf_dir), "s")
        assert df.count() == 0


def test_different_texts_under_one_id_stay(spark, sf_dir):
    rows = [(1, "one two three four five six seven", "en", "a", 33), (1, "quite another text of as many words", "en", "a", 35), (None, "a third that has no id at all here", "en", "b", 34), (2, "one two three four five six seven", "en", "a", 33)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((tuple(r) for r in P.near_duplicates(spark, df, sf_dir).collect()), key=str) == sorted(rows[:3], key=str)
    assert {(r.doc_id, r.text) for r in P.mix(spark, df, sf_dir).collect()} <= {r[:2] for r in rows}


@pytest.fixture
def without_broadcasts(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_texts_stay_where_they_are(spark, sf_dir, without_broadcasts):
    """Near duplicates and the mix choose among rows by their numbers and shuffle next to no text; what goes and what comes several times is right."""
    rng = np.random.default_rng(3)
    text = lambda: " ".join(f"{x:x}" for x in rng.integers(1 << 60, 1 << 62, 250).tolist())
    rows = [(d, text(), "en", "abc"[d % 3], 4000) for d in range(1500)]
    rows += [(2000 + d, rows[d][1], "en", "a", 4000) for d in range(100)]
    df = Scratch(spark, "t").table(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8), "rows")
    written = lambda: [(it.next().totalShuffleWrite()) for it in [spark.sparkContext._jsc.sc().statusStore().executorList(True).iterator()] if it.hasNext()][0]
    before = written()
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix_sources(df).collect()}
    method, before = written() - before, written()
    mix = Scratch(spark, "t").table(P.mix(spark, df, sf_dir), "mix")
    assert {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()} == {d: n for d, n in taken.items() if n}
    assert len(set(taken.values())) > 1
    assert written() - before < 2 * method + 1_500_000  # of 6.8 MB of text
    marks = Scratch(spark, "t").table(df.selectExpr("doc_id", "doc_id % 3 AS m"), "marks")
    got = classified(df, "doc_id", marks, "m").collect()
    assert sorted((r.doc_id, r.text, r.m) for r in got) == sorted((d, t, d % 3) for d, t, *_ in rows)
    assert sorted(r.doc_id for r in P.near_duplicates(spark, df, sf_dir).collect()) == list(range(1500))
