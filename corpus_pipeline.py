"""From raw documents to packed training sequences, in stages that are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm import decontaminate, packing, quality_lines, secret_scan, simhash
from changeflow.llm.common import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    return quality_lines.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    found = decontaminate.find_benchmark(docs.withColumnsRenamed(own), benchmark, text=own["text"])
    return found.filter(~F.col("contaminated")).select(*[F.col(n).alias(c) for c, n in own.items()])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind."""
    own = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    found = secret_scan.scan_secrets(docs.withColumnsRenamed(own), own["text"], redacted="redacted")
    found = found.withColumn(own["text"], F.col("redacted"))
    if "n_chars" in own:
        found = found.withColumn(own["n_chars"], F.char_length("redacted").cast(docs.schema["n_chars"].dataType))
    return found.select(*[F.col(n).alias(c) for c, n in own.items()])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their token ids."""
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("packing", pack),
]

# Tokenising, suffix links and packing have no SQL; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
