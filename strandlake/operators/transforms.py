"""Sequence transforms and filters as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import columns as C


def complement(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("sequence", C.complement(F.col("sequence")))


def reverse_complement(seqs: DataFrame) -> DataFrame:
    """Records of the opposite strand, named <name>_RC; proteins have none."""
    out = seqs.where(F.col("type") != "protein") if "type" in seqs.columns else seqs
    if "name" in seqs.columns:
        out = out.withColumn("description", F.concat(F.lit("Reverse complement of "), "name")).withColumn("name", F.concat("name", F.lit("_RC")))
    return out.withColumn("sequence", C.reverse_complement(F.col("sequence")))


def transcribe(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("sequence", F.translate("sequence", "Tt", "Uu"))


def reverse_transcribe(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("sequence", F.translate("sequence", "Uu", "Tt"))


def translate_frame(seqs: DataFrame, frame: int = 0) -> DataFrame:
    return seqs.withColumn("protein", C.translate_codons(F.col("sequence"), frame))


def filter_by_name(seqs: DataFrame, part: str) -> DataFrame:
    return seqs.where(F.contains(F.lower("name"), F.lit(part.lower())))


def type_label(kind: Column, topology: Column) -> Column:
    return F.when(kind == "protein", "PRT").when(kind == "rna", "RNA").when(topology == "circular", "CIR").otherwise("DNA")


def with_type(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("type", C.detect_type(F.col("sequence")))


def slice_sequences(seqs: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Bases start (inclusive) to end (exclusive, default the length)."""
    size = F.lit(end - start) if end is not None else F.length("sequence")
    return seqs.withColumn("sequence", F.substr("sequence", F.lit(start + 1), size))
