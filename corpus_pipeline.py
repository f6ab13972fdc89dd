"""From raw documents to packed training sequences: five stages over the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
back as the next stage's docs. All stages but the last return the columns of documents. A cleaned-up text
keeps its doc_id; n_chars follows the text.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, nearcopies, packing, pii, toxicity
from strandlake.functions.storage import shared_dir
from strandlake.llm.common import new_stage, read_table, remove
from strandlake.llm.queries import tokenizer_path


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose working tables last until the same thread begins the next one: write its result before that."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        new_stage(spark)
        return work(spark, docs, sf_dir)

    return run_stage


@stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score reaches the threshold go."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by fingerprints or by five-word shingles, the row of the smallest doc_id stays."""
    return nearcopies.drop_near_copies(docs)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which a twentieth of the words or more lies in benchmark windows go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


@stage
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; no row goes."""
    changed = pii.redact(docs)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids) with their sequence_id and offset."""
    return packing.best_fit_pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack),
]

#: SQL cannot express the learned stages and the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Every stage's result is written to the shared folder and reread; it goes once
    the next one is written, so only the last one stays."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/strandlake/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, work in STAGES:
        work(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    new_stage(spark)
    return docs
