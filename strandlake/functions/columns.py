"""Column expressions on sequences; all native, null for null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions import refdata

ACGT_LETTERS = "ATCGUatcgu"


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of seq are among the letters (regex class content)."""
    return F.length(F.regexp_replace(seq, f"[^{letters}]", ""))


def complement(seq: Column) -> Column:
    """A and T, C and G exchanged in their case; U gives A; others stay."""
    return F.translate(seq, ACGT_LETTERS, "TAGCAtagca")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def starts(first: Column, last: Column, step: int = 1) -> Column:
    """first, first + step, ... up to last; empty if last < first."""
    return F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def codons(seq: Column, frame: Column | int = 0) -> Column:
    """Whole codons of seq from the frame's offset, in one pass."""
    frame = F.lit(frame) if isinstance(frame, int) else frame
    return F.regexp_extract_all(F.substr(seq, frame + 1), F.lit("(?s).{3}"), F.lit(0))


def translate_codons(seq: Column, frame: Column | int = 0) -> Column:
    """Residues of the upper-cased seq in a frame; X for unknown codons, * for stops; the tail is dropped."""
    residues = lambda s: F.array_join(F.transform(codons(s, frame), lambda c: refdata.lookup(refdata.codon_table(), c, "X")), "")
    # seq may be a long expression: as an element it is made once, not anew for each codon
    return F.get(F.transform(F.array(F.upper(seq)), residues), F.lit(0))


def gc_percent(seq: Column) -> Column:
    """100 (G + C) / (A + T + C + G + U); 0 without any of them."""
    s = F.upper(seq)
    n = count_of(s, "ATCGU")
    return F.when(n > 0, 100.0 * count_of(s, "GC") / n).otherwise(F.when(seq.isNotNull(), 0.0))


def melting_temperature(seq: Column) -> Column:
    """0 if empty; 2 (A + T) + 4 (G + C) below 14 bases; else 64.9 + 41 (G + C - 16.4) / length."""
    s = F.upper(seq)
    gc, at, n = count_of(s, "GC"), count_of(s, "AT"), F.length(s)
    return F.when(n == 0, 0.0).when(n < 14, 2.0 * at + 4.0 * gc).otherwise(64.9 + 41.0 * (gc - 16.4) / n)


def weighted_sum(seq: Column, weights: dict[str, float]) -> Column:
    """Sum of the letters' weights, one count a letter; added up as whole numbers of a weight's last place."""
    unit = 10 ** max((len(repr(float(w)).partition(".")[2]) for w in weights.values()), default=0)

    def total(s: Column) -> Column:
        held, n = F.lit(0).cast("long"), F.length(s)
        for letter, w in weights.items():
            held = held + F.lit(round(w * unit)).cast("long") * (n - F.length(F.replace(s, F.lit(letter), F.lit(""))))
        return held / F.lit(float(unit))

    # seq may be a long expression: as an element it is made once, not anew for each letter
    return F.get(F.transform(F.array(seq), total), F.lit(0))


def molecular_weight(seq: Column, kind: Column) -> Column:
    """Protein: 18.02 plus each residue's weight less 18.02 (unknown: -18.02); else the nucleotides' sum."""
    s = F.upper(seq)
    protein = weighted_sum(s, refdata.residue_scales()["weight"]) - 18.02 * F.length(s) + 18.02
    return F.when(kind == "protein", protein).otherwise(weighted_sum(s, refdata.NUCLEOTIDE_MASS))


def detect_type(seq: Column) -> Column:
    """dna, rna, protein or unknown, from the letters' shares."""
    s = F.upper(F.regexp_replace(seq, r"[\s0-9*]", ""))
    n = F.length(s)
    exclusive = count_of(s, "DEFHIKLMPQRSVWY")
    return (
        F.when(n == 0, "unknown").when((exclusive > 5) | (exclusive > 0.05 * n), "protein")
        .when((count_of(s, "U") > 0) & (count_of(s, "T") == 0), "rna").when(count_of(s, "ATCGN") > 0.85 * n, "dna")
        .when(count_of(s, "AUCGN") > 0.85 * n, "rna").otherwise("protein")
    )
