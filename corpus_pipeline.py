"""A corpus pipeline over documents: language ID, near duplicates, secrets, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents. run() writes each stage's rows as Parquet in the shared folder and reads them again for the next.

Edge cases, in each stage: ids may be null or repeat, since rows are told apart by a number that is written with them;
columns other than those of documents are dropped, whatever their names; an empty table gives no rows. A null or empty
text, or one without a letter, is rejected by language ID; near duplicates keep each row without a word, the secret scan
leaves it as it is, the mix takes none, and packing gives it no batch. A text of any length is read whole. Repeated rows
are near duplicates, so one stays; of equally good rows the one without the later number. The mix orders rows of one id
by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import jaccard, language, mixing, packing, secrets
from factloom.llm.shared import Scratch, classified

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose best language holds less than this share of its n-grams is rejected.
MIN_LANGUAGE_SCORE = 0.4


def numbered(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """The rows with a number each (_row), written once, so that it stays theirs."""
    return scratch.table(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language; those without letters or with too mixed n-grams go. A missing lang gets the prediction."""
    found = language.predict(docs, language.learn(docs), keep=COLUMNS)
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates, once; rows without a word stay."""
    scratch = Scratch(spark, "near")
    rows = numbered(scratch, docs)
    groups = jaccard.similar_groups(rows.select(F.col("_row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "_of")
    ids = scratch.table(rows.select("_row", "doc_id").join(groups, F.col("_row") == F.col("_of")).select("_row", "doc_id", "component_id"), "ids")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("f"))
    marks = ids.select("_row").join(first.select(F.col("f._row").alias("_first")), F.col("_row") == F.col("_first"), "left")
    marks = scratch.table(marks.select("_row", F.col("_first").isNotNull().alias("_kept")), "marks")
    return classified(rows, "_row", marks, "_kept").where("_kept").select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets masked."""
    return secrets.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times."""
    scratch = Scratch(spark, "mix")
    rows = numbered(scratch, docs)
    times = F.when(F.col("taken") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    marks = scratch.table(mixing.mix_sources(rows, key="_row").select("_row", times.alias("_times")), "marks")
    rows = classified(rows, "_row", marks, "_times").where("_times > 0")
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document of the mix goes: its bucket, batch and place."""
    return packing.pack(docs.select("doc_id", "text", "lang", "source"))


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scans), ("mixing", mix), ("packing", pack)]

#: Language ID learns from all rows and isn't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
        if k > 1:
            scratch.drop(f"stage-{k - 2}")
    return docs
