"""Codon adaptation and optimisation against an organism's usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import columns as C
from strandlake.functions import refdata
from strandlake.functions.tables import local_table


def _usage(organism: str) -> list[tuple]:
    return [r for r in refdata.usage_rows() if r[0] == organism]


def relative_weights(organism: str) -> dict[str, float]:
    """Usage (0.1 where none) of each coding codon over that of its residue's most frequent one."""
    best: dict[str, float] = {}
    for _, _, aa, f, _ in _usage(organism):
        best[aa] = max(best.get(aa, 0.0), f)
    return {codon: (f or 0.1) / best[aa] for _, codon, aa, f, _ in _usage(organism) if aa != "*"}


def _adaptation(codons: Column, organism: str) -> Column:
    """exp of the mean log weight of known coding codons; 0 without any."""
    import math

    logs = {c: math.log(w) for c, w in relative_weights(organism).items()}
    known = F.filter(F.transform(codons, lambda c: refdata.lookup(logs, c, None)), lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.exp(F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))).otherwise(0.0)


def codon_adaptation_index(seqs: DataFrame, organism: str = "ecoli") -> DataFrame:
    return seqs.select("seq_id", _adaptation(C.codons(F.upper("sequence")), organism).alias("cai"))


def _optimized(seq: Column, organism: str) -> Column:
    best = refdata.best_codons(organism)
    return F.array_join(F.transform(C.codons(F.upper(seq)), lambda c: refdata.lookup(best, refdata.lookup(refdata.codon_table(), c, "X"), "NNN")), "")


def optimize_codons(seqs: DataFrame, organism: str = "ecoli") -> DataFrame:
    """Each residue's most frequent codon, stops too; NNN for unknown codons."""
    return seqs.select("seq_id", _optimized(F.col("sequence"), organism).alias("optimized"))


def optimization_report(seqs: DataFrame, organism: str = "ecoli") -> DataFrame:
    """Adaptation before and after, codons that change, and codons without N."""
    both = seqs.select("seq_id", C.codons(F.upper("sequence")).alias("old"), _optimized(F.col("sequence"), organism).alias("opt"))
    own = both.select("seq_id", "old", C.codons(F.col("opt")).alias("new"))
    changed = F.size(F.filter(F.zip_with("old", "new", lambda a, b: a != b), lambda x: x))
    total = F.size(F.filter("old", lambda c: ~F.contains(c, F.lit("N"))))
    return own.select("seq_id", _adaptation(F.col("old"), organism).alias("cai"), _adaptation(F.col("new"), organism).alias("optimized_cai"), changed.alias("changed"), total.alias("total"))


def codon_usage_table(seqs: DataFrame, organism: str = "ecoli") -> DataFrame:
    """(seq_id, aa, codon, per_thousand, count, seq_per_thousand, is_optimal) for every coding codon."""
    best: dict[str, float] = {}
    for _, _, aa, f, _ in _usage(organism):
        best[aa] = max(best.get(aa, 0.0), f)
    grid = [(aa, c, f, f == best[aa] and f > 0) for _, c, aa, f, _ in _usage(organism) if aa != "*"]
    table = F.broadcast(local_table(seqs.sparkSession, grid, "aa string, codon string, per_thousand double, is_optimal boolean"))
    codons = seqs.select("seq_id", F.filter(C.codons(F.upper("sequence")), lambda c: ~F.contains(c, F.lit("N"))).alias("codons"))
    counts = codons.select("seq_id", F.explode("codons").alias("codon")).groupBy("seq_id", "codon").agg(F.count("*").alias("count"))
    totals = seqs.select("seq_id").join(counts.groupBy("seq_id").agg(F.sum("count").alias("total")), "seq_id", "left")
    every = totals.crossJoin(table).join(counts, ["seq_id", "codon"], "left")
    n = F.coalesce("count", F.lit(0))
    return every.select("seq_id", "aa", "codon", "per_thousand", n.alias("count"), F.when(F.col("total") > 0, 1000.0 * n / F.col("total")).otherwise(0.0).alias("seq_per_thousand"), "is_optimal")
