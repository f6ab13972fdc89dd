"""Translation in all frames and open reading frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import columns as C
from strandlake.operators import chunks

STOPS = ("TAA", "TAG", "TGA")


#: Starts and stops as they are read on the given strand, and on the opposite one.
CODONS = {"+": (["ATG"], list(STOPS)), "-": (["CAT", "CAU"], ["TTA", "UTA", "TUA", "UUA", "CTA", "CUA", "TCA", "UCA"])}
#: Places of a range in which frames are looked for at once. Never changes a result.
RANGE = 1 << 20


def _lengths(seqs: DataFrame) -> DataFrame:
    """(seq_id, n): the letters of sequences, or of those that chunks belong to."""
    n = F.length("sequence").cast("long")
    return seqs.groupBy("seq_id").agg(F.sum(n).alias("n")) if "chunk" in seqs.columns else seqs.select("seq_id", n.alias("n"))


def _turns(codons: DataFrame, keys: list[str]) -> DataFrame:
    """codons (keys, at, stop) that are starts behind a stop or stops behind a start, the first of all too, with their number
    (turn, from 1) and the place of the next such one: a start's next one is its stop."""
    along = Window.partitionBy(*keys).orderBy("at")
    kept = codons.withColumn("_before", F.lag("stop").over(along)).where(F.col("_before").isNull() | (F.col("_before") != F.col("stop"))).drop("_before")
    return kept.withColumns({"turn": F.row_number().over(along), "next": F.lead("at").over(along)})


def _open_frames(seqs: DataFrame, strands: str, max_len: int | None = None) -> DataFrame:
    """(seq_id, strand, f, n, first, last): in each frame f (from 0) of a strand, from the first start behind a stop to the
    next stop; places are those of the two codons as counted along the strand.

    Only starts and stops leave the chunks. Frames are found in ranges of places, so a sequence is shared out over tasks;
    between ranges only the turns at their edges are gone through once more."""
    words = [w for strand in strands for kinds in CODONS[strand] for w in kinds]
    found = chunks.positioned_words(seqs, 3).where(F.col("word").isin(words))
    # no codon is one on both strands; on the opposite one places are counted backwards, from the end once that is known
    minus = F.col("word").isin(sum(CODONS["-"], []))
    codons = found.select("seq_id", F.when(minus, "-").otherwise("+").alias("strand"), F.when(minus, -F.col("pos") - 3).otherwise(F.col("pos")).cast("long").alias("at"), F.col("word").isin(CODONS["+"][1] + CODONS["-"][1]).alias("stop"))
    codons = codons.withColumns({"f": F.pmod("at", F.lit(3)).cast("int"), "range": F.floor(F.col("at") / RANGE)})
    place = lambda c: F.when(F.col("strand") == "-", F.col("n") + F.col(c)).otherwise(F.col(c))
    if max_len is not None:
        codons = codons.join(_lengths(seqs), "seq_id").where(place("at") + 3 <= max_len).drop("n")
    frame = ["seq_id", "strand", "f"]
    turns = _turns(codons.repartition(*frame, "range"), [*frame, "range"])
    # what other ranges can change: a range's first turn, the stop that ends it, and the last turn
    edge = (F.col("turn") == 1) | ((F.col("turn") == 2) & F.col("stop")) | F.col("next").isNull()
    across = _turns(turns.where(edge).select(*frame, "at", "stop"), frame)
    spans = lambda t: t.where(~F.col("stop") & F.col("next").isNotNull()).select("seq_id", "strand", F.col("at").alias("first"), F.col("next").alias("last"))
    both = spans(turns.where("turn > 1")).union(spans(across))
    named = both.join(_lengths(seqs), "seq_id") if "-" in strands else both.withColumn("n", F.lit(None).cast("long"))
    return named.withColumns({"first": place("first"), "last": place("last")}).withColumn("f", (F.col("first") % 3).cast("int"))


def find_orfs(seqs: DataFrame, min_length: int = 30) -> DataFrame:
    """(seq_id, frame, start, end, length, protein) of forward frames: from the first ATG after the last
    stop to the next stop, with it; open-ended ones are left out. seqs are sequences or chunks of them."""
    found = _open_frames(seqs, "+").select("seq_id", "f", F.col("first").cast("int").alias("start"), (F.col("last") + 3).cast("int").alias("end"))
    named = chunks.cut_out(seqs, found.where(F.col("end") - F.col("start") >= min_length), "text")
    protein = C.translate_codons(F.col("text"))
    return named.select("seq_id", (F.col("f") + 1).alias("frame"), "start", "end", (F.col("end") - F.col("start")).alias("length"), protein.alias("protein"))


def six_frame_translation(seqs: DataFrame, max_len: int | None = None) -> DataFrame:
    """(seq_id, frame, frame_order, protein) for frames +1, +2, +3, -1, -2, -3; max_len cuts each strand."""
    cut = (lambda s: F.left(s, F.lit(max_len))) if max_len is not None else (lambda s: s)
    s = F.upper("sequence")
    strands = seqs.select("seq_id", cut(s).alias("+"), cut(C.reverse_complement(s)).alias("-"))
    rows = [F.struct(F.lit(f"{sign}{k + 1}").alias("frame"), F.lit(3 * (sign == "-") + k).alias("frame_order"), C.translate_codons(F.col(sign), k).alias("protein")) for sign in "+-" for k in range(3)]
    return strands.select("seq_id", F.inline(F.array(*rows)))


def six_frame_parts(seqs: DataFrame) -> DataFrame:
    """(seq_id, frame, frame_order, at, protein): six_frame_translation in parts of a chunk, at telling how many residues of
    the frame stand before each. seqs are sequences or chunks of them; no row is larger than a chunk."""
    own = chunks.with_halo(seqs.withColumn("sequence", F.upper("sequence")), chunks.CHUNK, 2).join(_lengths(seqs), "seq_id")
    parts = []
    for order in range(6):
        sign, k = "+-"[order // 3], order % 3
        # the first place of the chunk at which a codon of this frame starts, and how many start in the chunk and are whole
        skip = F.pmod((F.lit(k) if sign == "+" else F.col("n") - k) - F.col("start"), F.lit(3)).cast("int")
        count = F.greatest(F.floor((F.least(F.col("core") + 2, F.length("sequence")) - skip) / 3), F.lit(0)).cast("int")
        text = F.substr("sequence", skip + 1, count * 3)
        first = F.col("start") + skip
        at = (first - k if sign == "+" else F.col("n") - k - first - 3 * count) / 3
        parts.append(F.struct(F.lit(f"{sign}{k + 1}").alias("frame"), F.lit(order).alias("frame_order"), at.cast("long").alias("at"), C.translate_codons(text if sign == "+" else C.reverse_complement(text)).alias("protein")))
    return own.select("seq_id", F.inline(F.array(*parts))).where("protein <> ''")


def six_frame_orfs(seqs: DataFrame, min_aa: int = 10, max_len: int | None = None) -> DataFrame:
    """(seq_id, frame, frame_order, start, end, length, protein): in each frame's protein from the first M
    after a stop to the next stop; positions in residues, length without the stop, protein with it; max_len cuts each
    strand. seqs are sequences or chunks of them; only reading frames are cut out of them."""
    size, plus = F.col("last") - F.col("first"), F.col("strand") == "+"
    start = F.when(plus, F.col("first")).otherwise(F.col("n") - F.col("last") - 3)
    long = _open_frames(seqs, "+-", max_len).where(size >= 3 * min_aa).withColumns({"start": start, "end": start + size + 3})
    text = chunks.cut_out(seqs, long, "text")
    own = F.when(plus, F.col("text")).otherwise(C.reverse_complement(F.col("text")))
    at = F.floor(F.col("first") / 3).cast("int")
    aa = (size / 3).cast("int")
    return text.select("seq_id", F.concat("strand", (F.col("f") + 1).cast("string")).alias("frame"), (F.when(plus, 0).otherwise(3) + F.col("f")).cast("int").alias("frame_order"), at.alias("start"), (at + aa).alias("end"), aa.alias("length"), C.translate_codons(own).alias("protein"))


def orf_summary(orfs: DataFrame) -> DataFrame:
    return orfs.groupBy("seq_id").agg(F.count("*").alias("count"), F.max("length").alias("longest"))


def top_orfs(orfs: DataFrame, top: int = 10) -> DataFrame:
    """The longest reading frames of each sequence, by length, frame and start."""
    rank = F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("length"), "frame", "start"))
    return orfs.withColumn("rank", rank).where(F.col("rank") <= top)
