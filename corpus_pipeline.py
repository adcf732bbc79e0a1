"""From raw documents to packed training sequences: the stages and their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitscore.llm import decontaminate, near, pack, pii, quality
from pitscore.llm.queries import quality_model, word_tokenizer
from pitscore.sources.io import scratch_path


#: Near duplicates of the corpus are alike from this percentage on. A pair at exactly that shares none of
#: these bands with probability 3e-6.
NEAR_PERCENT, NEAR_ROWS, NEAR_BANDS = 80, 6, 42


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it learns from the labelled ones outside the held-out
    fold. A document without text is judged as an empty one."""
    stats = quality.document_statistics(docs)
    model = quality_model(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document of smallest id. Rows repeated with one id and text count
    as copies, so one stays. Documents without words and rows without an id stay as they are."""
    return near.keep_first(docs, NEAR_ROWS, NEAR_BANDS, NEAR_PERCENT)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` is counted anew where present."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The parts of all documents in sequences of 2048 tokens, with their ids."""
    return pack.pack(docs, word_tokenizer())


STAGES = [
    ("quality classifier", good_documents),
    ("near duplicates", first_of_group),
    ("benchmark decontamination", clean_of_benchmark),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: Learned scores, sketches and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
