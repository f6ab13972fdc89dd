"""Feature annotation and feature tables."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions import columns as C
from strandlake.functions.sizes import broadcast_if_small
from strandlake.operators import chunks

#: Letters that a place and a template are joined on.
KEY = 8


def auto_annotate(seqs: DataFrame, library: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(seq_id, name, type, start, end, strand, color, source): exact, also overlapping, occurrences of the
    library's templates on either strand, without keys that existing features have.

    Places are joined with templates on the first letters, then compared whole within their chunk."""
    s = F.upper("sequence")
    nucleic = seqs.where(F.col("type") != "protein") if "type" in seqs.columns else seqs
    strands = nucleic.select("seq_id", F.inline(F.array(F.struct(F.lit("+").alias("strand"), s.alias("s")), F.struct(F.lit("-").alias("strand"), C.reverse_complement(s).alias("s")))))
    sizes = library.agg(F.min(F.length("sequence")).alias("least"), F.max(F.length("sequence")).alias("most")).first()
    key, longest = min(KEY, sizes.least or 1), sizes.most or 1
    template = F.upper(library["sequence"])
    templates = broadcast_if_small(library.where(template != "").select("name", "type", "color", template.alias("template"), F.left(template, F.lit(key)).alias("word")))
    pieces = chunks.with_halo(strands.select(F.struct("seq_id", "strand", F.length("s").alias("n")).alias("seq_id"), F.col("s").alias("sequence")), chunks.CHUNK, longest - 1)
    words = chunks.words_at(F.left("sequence", F.col("core") + (key - 1)), key)
    met = pieces.select("seq_id.*", F.col("start").alias("first"), "sequence", F.posexplode(words).alias("k", "word")).join(templates, "word")
    size = F.length("template")
    hits = met.where(F.substr("sequence", F.col("k") + 1, size) == F.col("template")).withColumn("at", (F.col("first") + F.col("k")).cast("int"))
    start = F.when(F.col("strand") == "+", F.col("at")).otherwise(F.col("n") - F.col("at") - size)
    found = hits.select("seq_id", "name", "type", start.alias("start"), (start + size).alias("end"), "strand", "color", F.lit("auto").alias("source")).dropDuplicates(["seq_id", "name", "start", "end", "strand"])
    return found if existing is None else found.join(existing, ["seq_id", "name", "start", "end", "strand"], "left_anti").select(found.columns)


def add_annotations(features: DataFrame, rows: DataFrame) -> DataFrame:
    """features plus rows (seq_id, name, type, start, end, strand) whose places count from 1, both ends in."""
    new = rows.select(
        "seq_id", F.coalesce("name", F.lit("Feature")).alias("name"), F.coalesce("type", F.lit("misc_feature")).alias("type"), (F.col("start") - 1).alias("start"), "end",
        F.coalesce("strand", F.lit("+")).alias("strand"), F.lit("manual").alias("source"),
    )
    return features.unionByName(new, allowMissingColumns=True)


#: Places of a range in which features are looked through at once. Never changes a result.
RANGE = 100_000


def _clusters(features: DataFrame) -> DataFrame:
    """features plus _cluster: the start of the stretch of overlapping features that each belongs to.

    A stretch starts where no earlier feature reaches beyond the start. How far features reach is looked up in ranges of
    places side by side, and what earlier ranges reach is carried over."""
    keys = ["seq_id", "_range"]
    rows = features.withColumn("_range", F.floor(F.col("start") / RANGE)).repartition(*keys)
    here = Window.partitionBy(*keys).orderBy("start")
    earlier = Window.partitionBy("seq_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)

    def carried(df: DataFrame, value: Column) -> DataFrame:
        """df plus _carried: the largest value of the sequence's earlier ranges."""
        return df.join(df.groupBy(*keys).agg(F.max(value).alias("_most")).withColumn("_carried", F.max("_most").over(earlier)).drop("_most"), keys)

    reach = F.greatest(F.max("end_pos").over(here.rangeBetween(Window.unboundedPreceding, -1)), F.col("_carried"))
    begun = carried(rows, F.col("end_pos")).withColumn("_new", F.when(F.coalesce(F.col("start") >= reach, F.lit(True)), F.col("start"))).drop("_carried")
    own = F.max("_new").over(here.rangeBetween(Window.unboundedPreceding, 0))
    return carried(begun, F.col("_new")).withColumn("_cluster", F.coalesce(own, "_carried")).select(*features.columns, "_cluster")


def assign_tracks(features: DataFrame) -> DataFrame:
    """features (seq_id, start, end_pos, ...) plus track: the first whose last feature ends at or before.

    Greedy in order of start within a stretch of overlapping features; where no feature is open all tracks are free, so
    stretches are numbered apart, and a sequence's features are shared out over tasks. The ends of tracks in
    use and the numbers of free ones are kept in heaps. Rows equal in seq_id and start go by their other columns.
    """
    at = features.columns
    schema = T.StructType([*features.schema.fields, T.StructField("track", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, busy, free, used = None, [], [], 0
        for batch in batches:
            tracks = []
            for seq, cluster, start, end in zip(batch["seq_id"], batch["_cluster"], batch["start"], batch["end_pos"], strict=True):
                if (seq, cluster) != current:
                    current, busy, free, used = (seq, cluster), [], [], 0
                while busy and busy[0][0] <= start:
                    heappush(free, heappop(busy)[1])
                if not free:
                    heappush(free, used)
                    used += 1
                k = heappop(free)
                heappush(busy, (end, k))
                tracks.append(k)
            yield batch.drop(columns="_cluster").assign(track=tracks)

    ordered = _clusters(features).repartition("seq_id", "_cluster").sortWithinPartitions("seq_id", "_cluster", "start", *[c for c in at if c not in ("seq_id", "start")])
    return ordered.mapInPandas(run, schema)


def track_count(features: DataFrame) -> DataFrame:
    """(seq_id, tracks): the greatest number of features that overlap in a place."""
    edges = features.select("seq_id", F.inline(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end_pos").alias("at"), F.lit(-1).alias("step")))))
    depth = F.sum("step").over(Window.partitionBy("seq_id").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, 0))
    return edges.withColumn("depth", depth).groupBy("seq_id").agg(F.max("depth").alias("tracks"))


def feature_table(features: DataFrame) -> DataFrame:
    """Label, location from 1, length and arrow of features (name, qualifiers, type, start, end_pos, strand)."""
    label = F.coalesce("name", F.col("qualifiers")["gene"], F.col("qualifiers")["product"], "type")
    arrow = F.when(F.col("strand") == "-", "<-").otherwise("->")
    return features.select("seq_id", label.alias("label"), F.concat((F.col("start") + 1).cast("string"), F.lit(".."), F.col("end_pos").cast("string")).alias("location"), (F.col("end_pos") - F.col("start")).alias("length"), arrow.alias("arrow"))


def feature_coverage(features: DataFrame, lengths: DataFrame) -> DataFrame:
    """features plus start and width in percent of the sequence's length (seq_id, length)."""
    own = features.join(lengths, "seq_id").where("length > 0")
    return own.withColumns({"start_pct": 100.0 * F.col("start") / F.col("length"), "width_pct": 100.0 * (F.col("end_pos") - F.col("start")) / F.col("length")})
