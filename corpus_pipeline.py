"""From raw documents to token ids: five stages, each one operator over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm import bpe, decontaminate, quality, secrets, simhash
from tillwise.llm.joins import unused
from tillwise.scratch import materialize

#: Documents below this probability of good quality go.
LEAST_QUALITY = 0.7


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a model of all labels rates below ``LEAST_QUALITY``."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (out,) = unused(docs.columns, "_score")
    rated = quality.score(docs, model, out=out)
    return rated.where(F.col(out) >= LEAST_QUALITY).select(*[f"`{c}`" for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of every group of near copies the document with the smallest id."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap an item of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks live-looking secrets; ``n_chars`` follows the text."""
    done = secrets.redact(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast("bigint"))
    return done.select(*[f"`{c}`" for c in docs.columns])


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number, and the text that they decode to."""
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    encoded = bpe.encode(docs.select(*kept, F.col("text").alias("_text")), "_text")
    return encoded.select(*kept, F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("bpe encoding and decoding", bpe_encoding),
]

#: SQL has neither the trained model nor the tokenizer; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes its rows and the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
