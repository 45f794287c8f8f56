"""The training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

Toxicity drops the documents it rejects; near-dedup keeps the smallest id of each group; suffix-array dedup
takes repeated bytes out of the texts; decontamination drops documents that hold a benchmark
item; packing returns the pieces with their sequences.  All stages but the last return the columns of documents.

Cases: a null or empty text passes all stages and is packed as the separator alone; a row with a null doc_id is
in no group, matches nothing and is kept; rows that share a doc_id go or stay together in near-dedup and
decontamination; an empty table gives no pieces; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlode.llm.decontaminate import drop_contaminated
from fernlode.llm.minhash import drop_near_duplicates
from fernlode.llm.packing import pack
from fernlode.llm.queries import word_bpe_path
from fernlode.llm.suffix import remove_repeats
from fernlode.llm.toxicity import drop_toxic, train_toxicity
from fernlode.storage import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, train_toxicity(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated bytes go; the character count, where there is one, follows the text (of a null text it stays)."""
    out = remove_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, word_bpe_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained scores, signatures and tokens cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
