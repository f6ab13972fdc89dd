"""Composition and physical properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import columns as C
from strandlake.functions import refdata


def letters(seqs: DataFrame, *keep: str) -> DataFrame:
    """(seq_id, *keep, pos, letter): one row a character of the upper-cased sequence."""
    rows = seqs.select("seq_id", *keep, F.posexplode(F.split(F.upper("sequence"), "")).alias("pos", "letter"))
    return rows.where("letter <> ''")


def gc_content(seqs: DataFrame) -> DataFrame:
    return seqs.select("seq_id", C.gc_percent(F.col("sequence")).alias("gc"))


def nucleotide_composition(seqs: DataFrame) -> DataFrame:
    """Counts of each base, all other characters, and percentages over A, T, C, G and U."""
    s = F.upper("sequence")
    counts = {b.lower(): C.count_of(s, b) for b in "ATCGU"}
    total = C.count_of(s, "ATCGU")
    share = {f"{k}_pct": F.when(total > 0, 100.0 * v / total).otherwise(0.0) for k, v in counts.items()}
    return seqs.select("seq_id", *[v.alias(k) for k, v in counts.items()], (F.length(s) - total).alias("other"), *[v.alias(k) for k, v in share.items()])


def amino_acid_composition(seqs: DataFrame) -> DataFrame:
    """(seq_id, aa, count, first, pct, rank) of letters A-Z, by count and then first appearance."""
    counts = letters(seqs).where(F.col("letter").rlike("[A-Z]")).groupBy("seq_id", F.col("letter").alias("aa")).agg(F.count("*").alias("count"), F.min("pos").alias("first"))
    own = Window.partitionBy("seq_id")
    rank = F.row_number().over(own.orderBy(F.desc("count"), "first"))
    return counts.withColumns({"pct": 100.0 * F.col("count") / F.sum("count").over(own), "rank": rank})


def residue_class_composition(seqs: DataFrame) -> DataFrame:
    """(seq_id, class, count) of residues' classes; letters of no class are left out."""
    classes = {aa: name for name, members in refdata.RESIDUE_CLASSES.items() for aa in members}
    s = F.upper("sequence")
    named = F.array(*[F.struct(F.lit(name).alias("class"), C.count_of(s, members).cast("long").alias("count")) for name, members in refdata.RESIDUE_CLASSES.items()])
    assert len(classes) == 20
    return seqs.select("seq_id", F.inline(named)).where("count > 0")


def molecular_weight(seqs: DataFrame) -> DataFrame:
    return seqs.select("seq_id", C.molecular_weight(F.col("sequence"), F.col("type")).alias("weight"))


def melting_temp(seqs: DataFrame) -> DataFrame:
    return seqs.select("seq_id", C.melting_temperature(F.col("sequence")).alias("tm"))


def sequence_stats(seqs: DataFrame) -> DataFrame:
    """Length, weight, GC and Tm of each row; the last two null for proteins."""
    seq, nucleic = F.col("sequence"), F.col("type") != "protein"
    return seqs.select(
        "seq_id", F.length(seq).alias("length"), C.molecular_weight(seq, F.col("type")).alias("weight"),
        F.when(nucleic, C.gc_percent(seq)).alias("gc"), F.when(nucleic, C.melting_temperature(seq)).alias("tm"),
    )


def codon_rows(seqs: DataFrame) -> DataFrame:
    """(seq_id, at, codon): frame-0 codons."""
    return seqs.select("seq_id", F.posexplode(C.codons(F.upper("sequence"))).alias("at", "codon"))


def codon_usage(seqs: DataFrame, top: int | None = 16) -> DataFrame:
    """(seq_id, codon, count, share, rank) of the most frequent codons, earlier ones first on ties."""
    counts = codon_rows(seqs).groupBy("seq_id", "codon").agg(F.count("*").alias("count"), F.min("at").alias("first"))
    own = Window.partitionBy("seq_id")
    ranked = counts.withColumns({"share": F.col("count") / F.sum("count").over(own), "rank": F.row_number().over(own.orderBy(F.desc("count"), "first"))})
    return (ranked.where(F.col("rank") <= top) if top else ranked).drop("first")


def collection_summary(seqs: DataFrame) -> DataFrame:
    """Number and least, mean and greatest length by type, and of all (type null)."""
    n = F.length("sequence")
    return seqs.rollup("type").agg(F.count("*").alias("count"), F.min(n).alias("min_length"), F.avg(n).alias("avg_length"), F.max(n).alias("max_length"))


def global_dna_properties(seqs: DataFrame) -> DataFrame:
    """GC percent of the full length, AT/GC ratio (null without G or C), CpG count and per 100 bases."""
    s = F.upper("sequence")
    n, gc = F.length(s), C.count_of(s, "GC")
    cpg = F.regexp_count(s, F.lit("CG"))
    per = lambda x: F.when(n > 0, 100.0 * x / n).otherwise(0.0)
    return seqs.select("seq_id", per(gc).alias("gc"), F.when(gc > 0, (n - gc) / gc).alias("at_gc_ratio"), cpg.alias("cpg"), per(cpg).alias("cpg_per_100"))


def global_protein_properties(seqs: DataFrame) -> DataFrame:
    """Net charge, its class, weight (unknown residues 110) and mean residue weight."""
    s, scales = F.upper("sequence"), refdata.residue_scales()
    n, charge, weight = F.col("n"), F.col("charge"), F.col("weight")
    # values that are used more than once are columns first
    sums = seqs.select(
        "seq_id", F.length(s).alias("n"), C.weighted_sum(s, {k: v for k, v in scales["charge"].items() if v}).alias("charge"),
        (C.weighted_sum(s, scales["mass"]) + 110.0 * (F.length(s) - C.count_of(s, refdata.RESIDUE_ORDER))).alias("weight"),
    )
    return sums.select(
        "seq_id", "charge", F.when(charge > 0, "basic").when(charge < 0, "acidic").otherwise("neutral").alias("charge_class"),
        "weight", F.when(n > 0, weight / n).otherwise(0.0).alias("mean_weight"),
    )
