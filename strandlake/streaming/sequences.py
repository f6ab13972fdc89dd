"""Sequence files that arrive over time: parsed, annotated and appended."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.functions import refdata
from strandlake.operators.annotate import auto_annotate
from strandlake.sources import sequences

COLUMNS = ["name", "description", "type", "sequence", "format"]


def _files(spark: SparkSession, folder: str, endings: tuple[str, ...] | None, **options: str) -> DataFrame:
    """Text of arriving files, of those whose names end so (in any case) if endings are given."""
    if endings:
        anycase = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in endings]
        options["pathGlobFilter"] = "*{" + ",".join(anycase) + "}"
    return spark.readStream.format("text").options(**options).load(folder)


def stream_sequences(spark: SparkSession, folder: str, kind: str | None = None) -> DataFrame:
    """Records of files that arrive in the folder, as the readers give them, with seq_id and features (null but for
    GenBank). kind: fasta, genbank or raw for all files; without one the names tell, and .txt files are raw."""
    by_name = kind is None
    parts = {
        "fasta": lambda: sequences.parse_fasta(sequences.fasta_records(_files(spark, folder, sequences.FASTA if by_name else None, lineSep="\n>"))),
        "genbank": lambda: sequences.parse_genbank(_files(spark, folder, sequences.GENBANK if by_name else None, lineSep="\n//")),
        "raw": lambda: sequences.raw_records(_files(spark, folder, (".txt",) if by_name else None, wholetext="true")),
    }
    features = "array<struct<type:string,start:int,end:int,strand:string,qualifiers:map<string,string>>>"
    chosen = [part() for name, part in parts.items() if by_name or name == kind]
    rows = [p.select(*COLUMNS, F.col("features").cast(features) if "features" in p.columns else F.lit(None).cast(features).alias("features")) for p in chosen]
    return reduce(DataFrame.union, rows).withColumn("seq_id", F.xxhash64("name", "sequence"))


def annotate_stream(spark: SparkSession, folder: str, target: str, checkpoint: str, available_now: bool = True, kind: str | None = None) -> StreamingQuery:
    """Appends the records to target/sequences and their template features to target/features.

    Each micro-batch writes under its own number, so a batch that runs again replaces what it wrote.
    """
    library = refdata.feature_library(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/sequences/batch={number}")
        auto_annotate(spark.read.parquet(f"{target}/sequences/batch={number}"), library).write.mode("overwrite").parquet(f"{target}/features/batch={number}")

    writer = stream_sequences(spark, folder, kind).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
