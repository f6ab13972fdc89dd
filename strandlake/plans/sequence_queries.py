"""Queries over sequences: transforms, composition, windows and reading frames."""

from __future__ import annotations

from pyspark.sql import functions as F


from strandlake.functions import refdata
from strandlake.operators import composition, orfs, transforms, windows
from strandlake.plans.registry import out, register

_L = "CAST({} AS BIGINT)"


def n_sql(letters: str, s: str = "s") -> str:
    return f"length(regexp_replace({s}, '[^{letters}]', '', 'g'))"


CODONS = refdata.values_sql(list(refdata.codon_table().items()), "codon, aa")


_AA_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in refdata.codon_table().items()) + "}"


def translate_sql(source: str, frame: int = 0) -> str:
    """(seq_id, protein) of source (seq_id, s)."""
    return f"(SELECT seq_id, array_to_string(list_transform(range({frame}, length(s) - 2, 3), lambda p: coalesce(({_AA_MAP})[substr(s, (p + 1)::int, 3)], 'X')), '') AS protein FROM {source})"


# ---- transforms
register("sq_1_complement", lambda t: out(transforms.complement(t.dna_n), "seq_id", "sequence"), "SELECT seq_id, translate(sequence, 'ATCGUatcgu', 'TAGCAtagca') AS sequence FROM $dna_n")
register("sq_2_reverse_complement", lambda t: out(transforms.reverse_complement(t.dna), "seq_id", "name", "sequence"), "SELECT seq_id, name || '_RC' AS name, reverse(translate(sequence, 'ATCG', 'TAGC')) AS sequence FROM $dna")
register("sq_3_transcribe", lambda t: out(transforms.transcribe(t.dna_n), "seq_id", "sequence"), "SELECT seq_id, translate(sequence, 'Tt', 'Uu') AS sequence FROM $dna_n")
register("sq_4_reverse_transcribe", lambda t: out(transforms.reverse_transcribe(t.rna), "seq_id", "sequence"), "SELECT seq_id, translate(sequence, 'Uu', 'Tt') AS sequence FROM $rna")
register("sq_5_translate_frame", lambda t: out(transforms.translate_frame(t.dna_n, 1), "seq_id", "protein"), "SELECT seq_id, protein FROM " + translate_sql("(SELECT seq_id, upper(sequence) AS s FROM $dna_n)", 1))
register("sq_6_filter_by_name", lambda t: out(transforms.filter_by_name(t.dna, "DOC_1"), "seq_id", "name"), "SELECT seq_id, name FROM $dna WHERE contains(lower(name), 'doc_1')")
register(
    "sq_7_type_label",
    lambda t: out(t.customer.select(F.col("c_custkey").alias("id"), transforms.type_label(F.element_at(F.array(F.lit("protein"), F.lit("rna"), F.lit("dna")), (F.col("c_custkey") % 3 + 1).cast("int")), F.when(F.col("c_custkey") % 2 == 0, "circular")).alias("label"))),
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'PRT' WHEN c_custkey % 3 = 1 THEN 'RNA' WHEN c_custkey % 2 = 0 THEN 'CIR' ELSE 'DNA' END AS label FROM customer",
)
DETECT = f"""(SELECT seq_id, CASE WHEN n = 0 THEN 'unknown' WHEN x > 5 OR x > 0.05 * n THEN 'protein' WHEN u > 0 AND tt = 0 THEN 'rna' WHEN d > 0.85 * n THEN 'dna' WHEN r > 0.85 * n THEN 'rna' ELSE 'protein' END AS type
    FROM (SELECT seq_id, length(s) AS n, {n_sql("DEFHIKLMPQRSVWY")} AS x, {n_sql("U")} AS u, {n_sql("T")} AS tt, {n_sql("ATCGN")} AS d, {n_sql("AUCGN")} AS r
          FROM (SELECT seq_id, upper(regexp_replace(sequence, '[\\s0-9*]', '', 'g')) AS s FROM $typed)))"""
register("sq_8_detect_type", lambda t: out(transforms.with_type(t.typed), "seq_id", "type"), f"SELECT seq_id, type FROM {DETECT}")
register("sq_9_slice_sequences", lambda t: out(transforms.slice_sequences(t.dna, 5, 40), "seq_id", "sequence"), "SELECT seq_id, substr(sequence, 6, 35) AS sequence FROM $dna")

# ---- composition
GC = f"CASE WHEN {n_sql('ATCGU')} > 0 THEN 100.0 * {n_sql('GC')} / {n_sql('ATCGU')} ELSE 0 END"
TM = f"CASE WHEN length(s) = 0 THEN 0 WHEN length(s) < 14 THEN 2.0 * {n_sql('AT')} + 4.0 * {n_sql('GC')} ELSE 64.9 + 41.0 * ({n_sql('GC')} - 16.4) / length(s) END"
NUCLEOTIDE_WEIGHT = " + ".join(f"{w} * {n_sql(b)}" for b, w in refdata.NUCLEOTIDE_MASS.items())
PROTEIN_WEIGHT = " + ".join(f"{w} * {n_sql(b)}" for b, w in refdata.residue_scales()["weight"].items()) + " - 18.02 * length(s) + 18.02"
UP = "(SELECT seq_id, upper(sequence) AS s FROM $dna_n)"
register("cp_1_gc_content", lambda t: out(composition.gc_content(t.dna_n)), f"SELECT seq_id, round(CAST({GC} AS DOUBLE), 6) AS gc FROM {UP}")
register(
    "cp_2_nucleotide_composition", lambda t: out(composition.nucleotide_composition(t.dna_n)),
    "SELECT seq_id, " + ", ".join(f"{n_sql(b)} AS {b.lower()}" for b in "ATCGU") + f", length(s) - {n_sql('ATCGU')} AS other, "
    + ", ".join(f"round(CAST(CASE WHEN {n_sql('ATCGU')} > 0 THEN 100.0 * {n_sql(b)} / {n_sql('ATCGU')} ELSE 0 END AS DOUBLE), 6) AS {b.lower()}_pct" for b in "ATCGU") + f" FROM {UP}",
)
LETTERS = "(SELECT seq_id, pos, substr(s, (pos + 1)::int, 1) AS letter FROM (SELECT seq_id, upper(sequence) AS s, unnest(range(0, length(sequence))) AS pos FROM {}))"
register(
    "cp_3_amino_acid_composition", lambda t: out(composition.amino_acid_composition(t.protein), "seq_id", "aa", "count", "pct", "rank"),
    f"""SELECT seq_id, aa, count, round(100.0 * count / sum(count) OVER (PARTITION BY seq_id), 6) AS pct, row_number() OVER (PARTITION BY seq_id ORDER BY count DESC, first) AS rank
        FROM (SELECT seq_id, letter AS aa, count(*) AS count, min(pos) AS first FROM {LETTERS.format("$protein")} GROUP BY ALL)""",
)
register(
    "cp_4_residue_class_composition", lambda t: out(composition.residue_class_composition(t.protein)),
    " UNION ALL ".join(f"SELECT seq_id, '{k}' AS class, {n_sql(v, 'sequence')} AS count FROM $protein WHERE {n_sql(v, 'sequence')} > 0" for k, v in refdata.RESIDUE_CLASSES.items()),
)
register("cp_5_molecular_weight", lambda t: out(composition.molecular_weight(t.protein.withColumn("type", F.lit("protein")))), f"SELECT seq_id, round(CAST({PROTEIN_WEIGHT} AS DOUBLE), 6) AS weight FROM (SELECT seq_id, sequence AS s FROM $protein)")
register("cp_6_melting_temp", lambda t: out(composition.melting_temp(t.dna_n)), f"SELECT seq_id, round(CAST({TM} AS DOUBLE), 6) AS tm FROM {UP}")
register(
    "cp_7_sequence_stats", lambda t: out(composition.sequence_stats(t.dna_n.withColumn("type", F.lit("dna")))),
    f"SELECT seq_id, length(s) AS length, round(CAST({NUCLEOTIDE_WEIGHT} AS DOUBLE), 6) AS weight, round(CAST({GC} AS DOUBLE), 6) AS gc, round(CAST({TM} AS DOUBLE), 6) AS tm FROM {UP}",
)
CODON_ROWS = "(SELECT seq_id, p, substr(s, (p + 1)::int, 3) AS codon FROM (SELECT seq_id, s, unnest(range(0, length(s) - 2, 3)) AS p FROM (SELECT seq_id, upper(sequence) AS s FROM {})))"
register(
    "cp_8_codon_usage", lambda t: out(composition.codon_usage(t.dna_n)),
    f"""SELECT seq_id, codon, count, round(count * 1.0 / total, 6) AS share, rank FROM (
        SELECT *, sum(count) OVER (PARTITION BY seq_id) AS total, row_number() OVER (PARTITION BY seq_id ORDER BY count DESC, first) AS rank
        FROM (SELECT seq_id, codon, count(*) AS count, min(p) AS first FROM {CODON_ROWS.format("$dna_n")} GROUP BY ALL)) WHERE rank <= 16""",
)
register(
    "cp_9_collection_summary", lambda t: out(composition.collection_summary(transforms.with_type(t.typed))),
    f"""SELECT type, count(*) AS count, min(n) AS min_length, round(avg(n), 6) AS avg_length, max(n) AS max_length
        FROM (SELECT d.type, length(q.sequence) AS n FROM {DETECT} d JOIN $typed q USING (seq_id)) GROUP BY ROLLUP (type)""",
)
CG = "(length(s) - length(replace(s, 'CG', ''))) / 2"
register(
    "cp_10_global_dna_properties", lambda t: out(composition.global_dna_properties(t.dna)),
    f"""SELECT seq_id, round(CAST(CASE WHEN length(s) > 0 THEN 100.0 * {n_sql("GC")} / length(s) ELSE 0 END AS DOUBLE), 6) AS gc,
        round(CAST(CASE WHEN {n_sql("GC")} > 0 THEN (length(s) - {n_sql("GC")}) * 1.0 / {n_sql("GC")} END AS DOUBLE), 6) AS at_gc_ratio, CAST({CG} AS BIGINT) AS cpg,
        round(CAST(CASE WHEN length(s) > 0 THEN 100.0 * {CG} / length(s) ELSE 0 END AS DOUBLE), 6) AS cpg_per_100 FROM (SELECT seq_id, sequence AS s FROM $dna)""",
)
_MASS = " + ".join(f"{w} * {n_sql(b)}" for b, w in refdata.residue_scales()["mass"].items())
_CHARGE = f"{n_sql('RK')} + 0.5 * {n_sql('H')} - {n_sql('DE')}"
register(
    "cp_10_global_protein_properties", lambda t: out(composition.global_protein_properties(t.protein)),
    f"""SELECT seq_id, round(CAST(c AS DOUBLE), 6) AS charge, CASE WHEN c > 0 THEN 'basic' WHEN c < 0 THEN 'acidic' ELSE 'neutral' END AS charge_class, round(CAST(w AS DOUBLE), 6) AS weight,
        round(CAST(CASE WHEN n > 0 THEN w / n ELSE 0 END AS DOUBLE), 6) AS mean_weight FROM (SELECT seq_id, length(s) AS n, {_CHARGE} AS c, {_MASS} AS w FROM (SELECT seq_id, sequence AS s FROM $protein))""",
)

# ---- windows
W = 20


def window_sql(source: str, value: str, sums: dict[str, str]) -> str:
    frame = f"OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING)"
    inner = ", ".join(f"sum({v}) {frame} AS {k}" for k, v in sums.items())
    return f"SELECT seq_id, pos, round(CAST({value} AS DOUBLE), 6) AS value FROM (SELECT seq_id, pos, count(*) {frame} AS n, {inner} FROM {LETTERS.format(source)}) WHERE n = {W}"


def _is(letters: str) -> str:
    return f"CASE WHEN contains('{letters}', letter) THEN 1 ELSE 0 END"


def _scale(name: str, unknown: float) -> str:
    return "CASE letter " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in refdata.residue_scales()[name].items()) + f" ELSE {unknown} END"


register("wn_1_window_gc", lambda t: out(windows.window_gc(t.dna, W)), window_sql("$dna", f"100.0 * gc / {W}", {"gc": _is("GC")}))
register("wn_2_window_at_skew", lambda t: out(windows.window_at_skew(t.dna, W)), window_sql("$dna", "CASE WHEN a + t > 0 THEN (a - t) * 1.0 / (a + t) ELSE 0 END", {"a": _is("A"), "t": _is("T")}))
register("wn_3_window_gc_skew", lambda t: out(windows.window_gc_skew(t.dna, W)), window_sql("$dna", "CASE WHEN g + c > 0 THEN (g - c) * 1.0 / (g + c) ELSE 0 END", {"g": _is("G"), "c": _is("C")}))
register(
    "wn_4_window_complexity", lambda t: out(windows.window_complexity(t.dna, W)),
    f"""SELECT seq_id, pos, round(count(DISTINCT w) * 1.0 / {W}, 6) AS value FROM (
        SELECT seq_id, pos, substr(s, (pos + i + 1)::int, k::int) AS w FROM (SELECT seq_id, s, pos, k, unnest(range(0, {W} - k + 1)) AS i FROM (
        SELECT seq_id, s, pos, unnest([1, 2, 3]) AS k FROM (SELECT seq_id, sequence AS s, unnest(range(0, length(sequence) - {W} + 1)) AS pos FROM $dna)))) GROUP BY ALL""",
)
_F = f"OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING)"
register(
    "wn_5_window_cpg", lambda t: out(windows.window_cpg(t.dna, W)),
    f"""SELECT seq_id, pos, round(CAST(CASE WHEN c * g > 0 THEN cg / (c * g * 1.0 / {W}) ELSE 0 END AS DOUBLE), 6) AS value FROM (
        SELECT seq_id, pos, count(*) {_F} AS n, sum({_is("C")}) {_F} AS c, sum({_is("G")}) {_F} AS g, sum(pair) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 2} FOLLOWING) AS cg
        FROM (SELECT *, CASE WHEN letter = 'C' AND lead(letter) OVER (PARTITION BY seq_id ORDER BY pos) = 'G' THEN 1 ELSE 0 END AS pair FROM {LETTERS.format("$dna")})) WHERE n = {W}""",
)
register("wn_6_window_hydrophobicity", lambda t: out(windows.window_hydrophobicity(t.protein, W)), window_sql("$protein", f"v / {W}", {"v": _scale("hydropathy", 0.0)}))
register("wn_7_window_charge", lambda t: out(windows.window_charge(t.protein, W)), window_sql("$protein", f"v / {W}", {"v": _scale("charge", 0.0)}))
register("wn_8_window_residue_mass", lambda t: out(windows.window_residue_mass(t.protein, W)), window_sql("$protein", f"v / {W}", {"v": _scale("mass", 110.0)}))
register("wn_9_window_flexibility", lambda t: out(windows.window_flexibility(t.protein, W)), window_sql("$protein", f"v / {W}", {"v": _scale("flexibility", 0.4)}))
register(
    "wn_10_window_summary", lambda t: out(windows.window_summary(windows.window_gc(t.dna, W))),
    "SELECT seq_id, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean FROM (SELECT seq_id, value AS v FROM (" + window_sql("$dna", f"100.0 * gc / {W}", {"gc": _is("GC")}) + ")) GROUP BY seq_id",
)

# ---- reading frames
STOP = "codon IN ('TAA', 'TAG', 'TGA')"
ORFS = f"""(SELECT seq_id, fr + 1 AS frame, st AS start, en + 3 AS "end", en + 3 - st AS length, s FROM (SELECT seq_id, s, fr, grp, min(pos) FILTER (codon = 'ATG') AS st, max(pos) FILTER ({STOP}) AS en FROM (
    SELECT *, coalesce(sum(CASE WHEN {STOP} THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id, fr ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM (
    SELECT seq_id, s, pos, pos % 3 AS fr, substr(s, (pos + 1)::int, 3) AS codon FROM (SELECT seq_id, sequence AS s, unnest(range(0, length(sequence) - 2)) AS pos FROM $dna))) GROUP BY ALL)
    WHERE st < en AND en + 3 - st >= 30)"""
register(
    "tr_1_find_orfs", lambda t: out(orfs.find_orfs(t.dna, 30)),
    f"""SELECT seq_id, frame, start, "end", length, protein FROM (SELECT seq_id, frame, start, "end", length, string_agg(t.aa, '' ORDER BY p) AS protein FROM (
        SELECT *, unnest(range(start, "end", 3)) AS p FROM {ORFS}) o JOIN {CODONS} t ON t.codon = substr(o.s, (p + 1)::int, 3) GROUP BY ALL)""",
)
SIX = " UNION ALL ".join(
    f"SELECT seq_id, '{sign}{k + 1}' AS frame, {3 * (sign == '-') + k} AS frame_order, protein FROM "
    + translate_sql("(SELECT seq_id, sequence AS s FROM $dna)" if sign == "+" else "(SELECT seq_id, reverse(translate(sequence, 'ATCG', 'TAGC')) AS s FROM $dna)", k)
    for sign in "+-" for k in range(3)
)
register("tr_2_six_frame_translation", lambda t: out(orfs.six_frame_translation(t.dna)), f"SELECT seq_id, frame, CAST(frame_order AS BIGINT) AS frame_order, protein FROM ({SIX})")
SIX_ORFS = f"""(SELECT seq_id, frame, CAST(frame_order AS BIGINT) AS frame_order, off + instr(piece, 'M') - 1 AS start, off + length(piece) AS "end", length(piece) - instr(piece, 'M') + 1 AS length, substr(piece, instr(piece, 'M')) || '*' AS protein FROM (
    SELECT *, coalesce(sum(length(piece) + 1) OVER (PARTITION BY seq_id, frame ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, count(*) OVER (PARTITION BY seq_id, frame) AS n FROM (
    SELECT seq_id, frame, frame_order, k, ps[k::int] AS piece FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT seq_id, frame, frame_order, string_split(protein, '*') AS ps FROM ({SIX})))))
    WHERE k < n AND instr(piece, 'M') > 0 AND length(piece) - instr(piece, 'M') + 1 >= 10)"""
register("tr_3_six_frame_orfs", lambda t: out(orfs.six_frame_orfs(t.dna)), f"""SELECT seq_id, frame, frame_order, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", length, protein FROM {SIX_ORFS}""")
register("tr_4_orf_summary", lambda t: out(orfs.orf_summary(orfs.find_orfs(t.dna, 30))), f"SELECT seq_id, count(*) AS count, max(length) AS longest FROM {ORFS} GROUP BY seq_id")
register(
    "tr_4_top_orfs", lambda t: out(orfs.top_orfs(orfs.find_orfs(t.dna, 30), 3), "seq_id", "frame", "start", "length", "rank"),
    f"SELECT seq_id, frame, start, length, rank FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY length DESC, frame, start) AS rank FROM {ORFS}) WHERE rank <= 3",
)
