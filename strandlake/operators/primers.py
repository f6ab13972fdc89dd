"""Primer design with hairpin and self-dimer flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import columns as C

SIZES = range(18, 26)


def has_hairpin(seq: Column) -> Column:
    """Whether a three-base word stands reverse-complemented at least four places further on."""

    def pairs(i: Column) -> Column:
        word = F.substr(seq, i + 1, F.lit(3))
        return word.rlike("^[ACGT]{3}$") & (F.call_function("locate", C.reverse_complement(word), seq, i + 5) > 0)

    return F.exists(C.starts(F.lit(0), F.length(seq) - 7), pairs)


def has_self_dimer(seq: Column) -> Column:
    """Whether four bases in a row equal those of the reverse complement at the same place or before."""
    back = C.reverse_complement(seq)
    at = C.starts(F.lit(0), F.when(F.length(seq) >= 6, F.length(seq) - 4).otherwise(-1))
    same = lambda p: F.exists(C.starts(F.lit(0), p), lambda q: F.substr(seq, p + 1, F.lit(4)) == F.substr(back, q + 1, F.lit(4)))
    return F.exists(at, same)


def design_primers(seqs: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """(seq_id, direction, start, end, sequence, tm, gc, hairpin, self_dimer): the shortest primer from start
    (reverse: before end) of 18 to 25 bases with 50 <= Tm <= 65 and 40 <= GC <= 60; else 20 bases."""
    s = F.upper("sequence")
    first = F.lit(start or 0)
    last = F.lit(end) if end is not None else F.length("s")
    own = seqs.select("seq_id", s.alias("s")).select("seq_id", "s", F.length("s").alias("n"), first.alias("a"), last.alias("b"))
    size = F.explode(F.array(*[F.lit(k) for k in SIZES])).alias("k")
    forward = own.select("seq_id", "n", F.lit("forward").alias("direction"), "a", "b", "s", size).where("a + k <= n").select("*", F.substr("s", F.col("a") + 1, F.col("k")).alias("p"))
    reverse = own.select("seq_id", "n", F.lit("reverse").alias("direction"), "a", "b", "s", size).where("b - k >= 0").select("*", C.reverse_complement(F.substr("s", F.col("b") - F.col("k") + 1, F.col("k"))).alias("p"))
    tried = forward.union(reverse).withColumns({"tm": C.melting_temperature(F.col("p")), "gc": C.gc_percent(F.col("p"))})
    fits = F.col("tm").between(50, 65) & F.col("gc").between(40, 60)
    usable = tried.withColumn("fits", fits).where((F.col("fits")) | ((F.col("k") == 20) & ((F.col("direction") == "forward") | (F.col("n") >= 40))))
    rank = F.row_number().over(Window.partitionBy("seq_id", "direction").orderBy(F.desc("fits"), "k"))
    best = usable.withColumn("rank", rank).where("rank = 1")
    has_forward = F.max((F.col("direction") == "forward").cast("int")).over(Window.partitionBy("seq_id"))
    kept = best.withColumn("forward", has_forward).where("direction = 'forward' or fits or forward = 1")
    lo = F.when(F.col("direction") == "forward", F.col("a")).otherwise(F.col("b") - F.col("k"))
    return kept.select("seq_id", "direction", lo.alias("start"), (lo + F.col("k")).alias("end"), F.col("p").alias("sequence"), "tm", "gc", has_hairpin(F.col("p")).alias("hairpin"), has_self_dimer(F.col("p")).alias("self_dimer"))


def amplicons(primers: DataFrame) -> DataFrame:
    """(seq_id, start, end, size) between the forward and the reverse primer of a sequence."""
    pick = lambda d, c: F.min(F.when(F.col("direction") == d, F.col(c)))
    both = primers.groupBy("seq_id").agg(pick("forward", "start").alias("start"), pick("reverse", "end").alias("end"))
    return both.where("start is not null and end is not null").withColumn("size", F.col("end") - F.col("start"))
