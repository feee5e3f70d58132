"""The corpus pipeline: documents through quality, language, near duplicates, mixing and
tokens. Each stage takes ``(spark, docs, sf_dir)``; its result is written and read back
as the next stage's documents. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pavestat.llm import bpe, lang_id, mixing, ngram_join, quality
from pavestat.llm.common import fold_of, sized_broadcast, spread, written
from pavestat.llm.queries import WEIGHTS, branches, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its score is under this; if its languages cannot be told, or are told
#: with less than this certainty, over its letters. Documents of several languages stay.
QUALITY, CERTAINTY = 0.3, 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    docs = spread(docs.select(*COLUMNS))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold_of("doc_id", 5) != 0)
    model = quality.train(docs, labels)
    scored = quality.score(docs.withColumn("__kept", F.col("text")).select(*COLUMNS, "__kept"), model, "__kept")
    return scored.where(F.col("score") >= QUALITY).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with that language."""
    model = lang_id.train(docs.where(fold_of("doc_id", 4) != 2))
    found = lang_id.identify(spread(docs.select(*COLUMNS)), model)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("certainty") >= CERTAINTY))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id, then the least
    hash of its text; those without an id come last. Rows are told apart by themselves, so
    that unlike texts under one id both stay; texts without words link with nothing and stay."""
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")), "rows")
    groups = ngram_join.join(rows, words=5, num=8, den=10, doc_id="__row").where("n_links > 0").select(F.col("doc_id").alias("__row"), "component_id")
    linked = written(rows.select("__row", "doc_id", F.xxhash64("text").alias("h")).join(groups, "__row"), "linked")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h", "__row")
    first = linked.groupBy("component_id").agg(F.min_by("__row", order).alias("__row")).select("__row")
    gone = written(linked.select("__row").join(first, "__row", "left_anti"), "gone")
    return rows.join(sized_broadcast(gone, ngram_join.BROADCAST_IDS), "__row", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to the target weights, each at most once."""
    return mixing.mix(docs.select(*COLUMNS), branches(), WEIGHTS, share=0.9, epochs=1, seed=7).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the hash of the text that they decode to."""
    coded = bpe.encode(spread(docs.select(*COLUMNS)), vocabulary("byte_bpe_50k.json"), decoded="back")
    return coded.select("doc_id", "lang", "source", "n_tokens", F.col("ids").alias("token_ids"), F.sha2(F.encode("back", "utf-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", duplicates_stage),
    ("mixing", mixing_stage),
    ("bpe", tokens_stage),
]
#: The stages fit models and follow links; SQL cannot say that. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
