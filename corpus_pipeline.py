"""Corpus pipeline: documents in, packed training sequences out.

Quality rules, language identification, exact deduplication, near-duplicate
removal and packing, each over all that its predecessor kept. Every stage but
the last returns the columns of ``documents``. Rows whose doc_id is null or
occurs twice are rows like any other in each stage; only rows that agree in
id and text are one to the exact deduplication. Empty input: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import exact_dedup, jaccard, langid, packing, quality
from quire.llm.common import discard, shared_table
from quire.llm.families import small
from quire.llm.queries import tokenizer_path

#: Rows that go, up to which their numbers are broadcast (8 bytes each); beyond, they are joined by a shuffle.
ROWS_BROADCAST = 2_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by a number of their own, so ids may be null or occur twice; of a group, the row of the least id stays (null ids last, then by number)."""
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")
    numbered = shared_table(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("id"), record), "numbered")
    classes = jaccard.similar_documents(numbered.select("row", "record.text"), "row", "text")
    linked = shared_table(classes.where("linked").select(F.col("id").alias("of"), "component_id"), "linked")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    members = numbered.select("row", "id").join(linked, F.col("row") == F.col("of"))
    stays = shared_table(members.groupBy(F.col("component_id").alias("class")).agg(F.min(place)["row"].alias("stays")), "stays")
    gone = linked.join(small(stays), F.col("component_id") == F.col("class")).where("of <> stays").select(F.col("of").alias("gone"))
    gone = shared_table(gone, "gone")
    few = gone.count() <= ROWS_BROADCAST
    return numbered.join(F.broadcast(gone) if few else gone, F.col("row") == F.col("gone"), "left_anti").select("record.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack(docs, tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("length"), "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_stage),
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("packing", packing_stage),
]

#: Language models and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents; each stage's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, shared_table(stage(spark, docs, sf_dir), "stage")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
