"""Queries over sequences: motifs, restriction, primers, codons and annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import columns as C
from strandlake.functions import refdata
from strandlake.operators import annotate, codons, patterns, primers, restriction
from strandlake.plans.registry import out, register
from strandlake.plans.sequence_queries import _AA_MAP, GC, TM

EXACT = [("stop", "TGA"), ("TATA", "TATA"), ("repeat", "AA")]
IUPAC = [("AccI", "GTYRAC"), ("any", "RYRN")]
REGEX = [("Stop codons", "T(AA|AG|GA)"), ("run", "a{3,5}")]


def motif_sql(motifs: list[tuple[str, str]], mode: str) -> str:
    parts = []
    for name, m in motifs:
        p = patterns.pattern_of(m, mode)
        for strand, s in (("+", "sequence"), ("-", "reverse(translate(sequence, 'ATCG', 'TAGC'))")):
            parts.append(f"SELECT seq_id, '{name}' AS motif, '{strand}' AS strand, length(s) AS n, regexp_extract_all(s, '{p}') AS ms, regexp_split_to_array(s, '{p}') AS ps FROM (SELECT seq_id, {s} AS s FROM $dna)")
    return f"""(SELECT seq_id, motif, strand, CAST(CASE WHEN strand = '+' THEN before ELSE n - before - length(match) END AS BIGINT) AS pos, match FROM (
        SELECT seq_id, motif, strand, n, ms[k::int] AS match, coalesce(list_sum(list_transform(ps[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0) AS before
        FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM ({" UNION ALL ".join(parts)}))))"""


def _find(t, motifs, mode):
    return patterns.find_motifs(t.dna, patterns.motif_table(t.spark, motifs, mode))


register("pt_1_find_motifs", lambda t: out(_find(t, EXACT, "exact")), "SELECT * FROM " + motif_sql(EXACT, "exact"))
register("pt_2_find_iupac", lambda t: out(_find(t, IUPAC, "iupac")), "SELECT * FROM " + motif_sql(IUPAC, "iupac"))
register("pt_3_find_regex", lambda t: out(_find(t, REGEX, "regex")), "SELECT * FROM " + motif_sql(REGEX, "regex"))
TATA = [("TATA", "TATA")]
register(
    "pt_4_motif_context", lambda t: out(patterns.motif_context(_find(t, TATA, "exact"), t.dna)),
    f"""SELECT h.*, substr(q.sequence, greatest(1, pos - 9)::int, least(10, pos)::int) AS before, substr(q.sequence, (pos + 5)::int, 10) AS after FROM {motif_sql(TATA, "exact")} h JOIN $dna q USING (seq_id)""",
)
register(
    "pt_5_motif_summary", lambda t: out(patterns.motif_summary(_find(t, EXACT, "exact"))),
    f"SELECT seq_id, motif, count(*) AS total, count(*) FILTER (strand = '+') AS plus, count(*) FILTER (strand = '-') AS minus FROM {motif_sql(EXACT, 'exact')} GROUP BY ALL",
)
register(
    "pt_6_motif_density", lambda t: out(patterns.motif_density(_find(t, EXACT, "exact"), t.dna)),
    f"SELECT motif, CAST(floor(pos * 10 / length(q.sequence)) AS BIGINT) AS bin, count(*) AS count FROM {motif_sql(EXACT, 'exact')} h JOIN $dna q USING (seq_id) GROUP BY ALL",
)
register(
    "pt_7_common_motifs", lambda t: out(patterns.motif_summary(_find(t, refdata.MOTIFS, "regex"))),
    f"SELECT seq_id, motif, count(*) AS total, count(*) FILTER (strand = '+') AS plus, count(*) FILTER (strand = '-') AS minus FROM {motif_sql(refdata.MOTIFS, 'regex')} GROUP BY ALL",
)

# ---- restriction
ENZYMES = refdata.values_sql(refdata.enzyme_rows(), 'name, site, cut, cut_complement, overhang, "group"')


def sites_sql() -> str:
    plain = [r for r in refdata.enzyme_rows() if not set(r[1]) - set("ACGT")]
    other = [r for r in refdata.enzyme_rows() if set(r[1]) - set("ACGT")]
    sized = " UNION ALL ".join(
        f"SELECT seq_id, name, site, cut, \"group\", pos FROM (SELECT seq_id, pos, substr(s, (pos + 1)::int, {k}) AS site FROM spots) JOIN {refdata.values_sql([(r[0], r[1], r[2], r[5]) for r in plain if len(r[1]) == k], 'name, site, cut, \"group\"')} USING (site)"
        for k in sorted({len(r[1]) for r in plain})
    )
    hard = " UNION ALL ".join(
        f"SELECT seq_id, '{r[0]}', '{r[1]}', {r[2]}, '{r[5]}', pos FROM (SELECT seq_id, s, unnest(range(0, length(s) - {len(r[1]) - 1})) AS pos FROM (SELECT seq_id, sequence AS s FROM $dna) WHERE regexp_matches(s, '{refdata.as_class(r[1])}')) WHERE regexp_full_match(substr(s, (pos + 1)::int, {len(r[1])}), '{refdata.as_class(r[1])}')"
        for r in other
    )
    return f"(WITH spots AS (SELECT seq_id, sequence AS s, unnest(range(0, length(sequence))) AS pos FROM $dna) {sized} UNION ALL {hard})"


SITES = sites_sql()
_S = lambda t: restriction.restriction_sites(t.dna, refdata.enzymes(t.spark))
_HITS = lambda t: _S(t).groupBy("name", "site").agg(F.count("*").alias("sites"), F.count_distinct("seq_id").alias("sequences"))
register(
    "re_1_enzymes", lambda t: out(refdata.enzymes(t.spark).join(_HITS(t), ["name", "site"], "left").fillna(0, ["sites", "sequences"])),
    f"""SELECT e.* REPLACE (CAST(e.cut AS BIGINT) AS cut, CAST(e.cut_complement AS BIGINT) AS cut_complement), coalesce(n.sites, 0) AS sites, coalesce(n.sequences, 0) AS sequences
        FROM {ENZYMES} e LEFT JOIN (SELECT name, site, count(*) AS sites, count(DISTINCT seq_id) AS sequences FROM {SITES} GROUP BY ALL) n ON n.name = e.name AND n.site = e.site""",
)
register("re_2_restriction_sites", lambda t: out(_S(t)), f'SELECT seq_id, name, site, CAST(cut AS BIGINT) AS cut, "group", pos FROM {SITES}')
FRAGMENTS = f"""(SELECT seq_id, spot AS start, nxt AS "end", nxt - spot AS size FROM (SELECT seq_id, spot, lead(spot) OVER (PARTITION BY seq_id ORDER BY spot) AS nxt FROM (
    SELECT seq_id, 0 AS spot FROM $dna UNION SELECT seq_id, length(sequence) FROM $dna UNION SELECT seq_id, pos + least(cut, length(site)) FROM {SITES})) WHERE nxt > spot)"""
_D = lambda t: restriction.digest(t.dna, _S(t))
register(
    "re_3_digest", lambda t: out(_D(t)),
    f"""SELECT seq_id, start, "end", size, substr(q.sequence, (greatest(start, 0) + 1)::int, (greatest("end", 0) - greatest(start, 0))::int) AS fragment FROM {FRAGMENTS} f JOIN $dna q USING (seq_id)""",
)
register(
    "re_4_digest_summary", lambda t: out(restriction.digest_summary(_S(t), len(refdata.enzyme_rows()))),
    f"SELECT seq_id, count(*) AS cutters, count(*) FILTER (n = 1) AS unique_cutters, CAST(sum(n) AS BIGINT) AS cuts, 122 - count(*) AS non_cutters FROM (SELECT seq_id, name, count(*) AS n FROM {SITES} GROUP BY ALL) GROUP BY seq_id",
)
register(
    "re_5_filter_enzymes", lambda t: out(restriction.filter_enzymes(_S(t), "4cutter", "2-3")),
    f"""SELECT * FROM (SELECT seq_id, name, "group", count(*) AS n FROM {SITES} WHERE "group" = '4cutter' GROUP BY ALL) WHERE n BETWEEN 2 AND 3""",
)
register(
    "re_6_fragment_shares", lambda t: out(restriction.fragment_shares(_D(t)), "seq_id", "start", "size", "share", "fragments"),
    f"""SELECT seq_id, start, size, round(100.0 * size / (max("end") OVER (PARTITION BY seq_id) - greatest(min(start) OVER (PARTITION BY seq_id), 0)), 6) AS share, count(*) OVER (PARTITION BY seq_id) AS fragments FROM {FRAGMENTS}""",
)
_MIG = "round((log10(longest) - log10(greatest(size, 1))) / greatest(log10(longest) - log10(least), 1.0), 6)"
_OWN = f'(SELECT seq_id, max("end") AS longest, greatest(least(min(size), 50), 10) AS least FROM {FRAGMENTS} GROUP BY seq_id)'
register(
    "re_7_gel_migration", lambda t: out(restriction.gel_migration(_D(t))),
    f"""SELECT seq_id, 'fragment' AS kind, CAST(size AS BIGINT) AS size, {_MIG} AS migration FROM {FRAGMENTS} JOIN {_OWN} USING (seq_id)
        UNION ALL SELECT seq_id, 'ladder', CAST(size AS BIGINT), {_MIG} FROM (SELECT *, unnest({refdata.LADDER}) AS size FROM {_OWN}) WHERE size <= 2 * longest AND size >= 0.5 * least""",
)
register(
    "re_8_cut_map", lambda t: out(restriction.cut_map(_S(t))),
    f"""SELECT seq_id, name, pos FROM (SELECT seq_id, name, pos, row_number() OVER (PARTITION BY seq_id ORDER BY pos, name) - 1 AS k, count(*) OVER (PARTITION BY seq_id) AS n FROM {SITES})
        WHERE k % CASE WHEN n > 50 THEN CAST(ceil(n / 50.0) AS BIGINT) ELSE 1 END = 0""",
)

# ---- primers
_TRY = "SELECT seq_id, s AS whole, length(s) AS n, '{d}' AS direction, k, {lo} AS start, {lo} + k AS \"end\", {p} AS p FROM (SELECT seq_id, sequence AS s, unnest(range(18, 26)) AS k FROM $dna) WHERE k <= length(s)"
TRIED = "(" + _TRY.format(d="forward", lo="0", p="substr(s, 1, k::int)") + " UNION ALL " + _TRY.format(d="reverse", lo="length(s) - k", p="reverse(translate(substr(s, (length(s) - k + 1)::int, k::int), 'ATCG', 'TAGC'))") + ")"
PRIMERS = f"""(SELECT seq_id, direction, start, "end", p, tm, gc FROM (SELECT *, max(CASE WHEN direction = 'forward' THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id) AS fw FROM (
    SELECT *, row_number() OVER (PARTITION BY seq_id, direction ORDER BY fits DESC, k) AS rk FROM (
    SELECT *, CASE WHEN tm BETWEEN 50 AND 65 AND gc BETWEEN 40 AND 60 THEN 1 ELSE 0 END AS fits FROM (SELECT *, CAST({TM.replace("(s", "(p").replace("s, '", "p, '")} AS DOUBLE) AS tm, CAST({GC.replace("s, '", "p, '")} AS DOUBLE) AS gc FROM {TRIED}))
    WHERE fits = 1 OR (k = 20 AND (direction = 'forward' OR n >= 40))) WHERE rk = 1) WHERE direction = 'forward' OR fits = 1 OR fw = 1)"""
register("pr_1_design_primers", lambda t: out(primers.design_primers(t.dna), "seq_id", "direction", "start", "end", "sequence", "tm", "gc"), f'SELECT seq_id, direction, start, "end", p AS sequence, round(tm, 6) AS tm, round(gc, 6) AS gc FROM {PRIMERS}')
_RC = "reverse(translate({}, 'ATCG', 'TAGC'))"
register(
    "pr_2_primer_hairpin", lambda t: out(primers.design_primers(t.dna), "seq_id", "direction", "hairpin"),
    f"""SELECT seq_id, direction, len(list_filter(range(0, length(p) - 6), lambda i: instr(substr(p, (i + 5)::int), {_RC.format("substr(p, (i + 1)::int, 3)")}) > 0)) > 0 AS hairpin FROM {PRIMERS}""",
)
register(
    "pr_3_primer_self_dimer", lambda t: out(primers.design_primers(t.dna), "seq_id", "direction", "self_dimer"),
    f"""SELECT seq_id, direction, bool_or(substr(p, (a + 1)::int, 4) = substr({_RC.format("p")}, (b + 1)::int, 4)) AS self_dimer FROM (SELECT *, unnest(range(0, a + 1)) AS b FROM (SELECT *, unnest(range(0, length(p) - 3)) AS a FROM {PRIMERS})) GROUP BY ALL""",
)
register("pr_4_amplicons", lambda t: out(primers.amplicons(primers.design_primers(t.dna))), f"""SELECT seq_id, f.start AS start, r."end" AS "end", r."end" - f.start AS size FROM {PRIMERS} f JOIN {PRIMERS} r USING (seq_id) WHERE f.direction = 'forward' AND r.direction = 'reverse'""")

# ---- codons
_W = "MAP {" + ", ".join(f"'{k}': {v!r}" for k, v in codons.relative_weights("ecoli").items()) + "}"
_BEST = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in refdata.best_codons("ecoli").items()) + "}"


def cai_sql(s: str, source: str) -> str:
    return f"""(SELECT q.seq_id, coalesce(exp(avg(ln(w))), 0) AS cai FROM {source} q LEFT JOIN (SELECT seq_id, ({_W})[codon] AS w FROM (SELECT seq_id, unnest(list_transform(range(0, length({s}) - 2, 3), lambda p: substr({s}, (p + 1)::int, 3))) AS codon FROM {source})) c
        ON c.seq_id = q.seq_id AND c.w IS NOT NULL GROUP BY q.seq_id)"""


_UP = "(SELECT seq_id, upper(sequence) AS s FROM $dna_n)"
OPT = f"(SELECT seq_id, s, array_to_string(list_transform(range(0, length(s) - 2, 3), lambda p: coalesce(({_BEST})[coalesce(({_AA_MAP})[substr(s, (p + 1)::int, 3)], 'X')], 'NNN')), '') AS o FROM {_UP})"
register("co_1_codon_adaptation_index", lambda t: out(codons.codon_adaptation_index(t.dna_n)), f"SELECT seq_id, round(cai, 6) AS cai FROM {cai_sql('s', _UP)}")
register("co_2_optimize_codons", lambda t: out(codons.optimize_codons(t.dna_n)), f"SELECT seq_id, o AS optimized FROM {OPT}")
register(
    "co_3_optimization_report", lambda t: out(codons.optimization_report(t.dna_n)),
    f"""SELECT seq_id, round(a.cai, 6) AS cai, round(b.cai, 6) AS optimized_cai, len(list_filter(range(0, length(o) - 2, 3), lambda p: substr(o, (p + 1)::int, 3) <> substr(s, (p + 1)::int, 3))) AS changed,
        len(list_filter(range(0, length(s) - 2, 3), lambda p: NOT contains(substr(s, (p + 1)::int, 3), 'N'))) AS total FROM {OPT} JOIN {cai_sql("s", _UP)} a USING (seq_id) JOIN {cai_sql("o", OPT)} b USING (seq_id)""",
)
USAGE = refdata.values_sql([(r[1], r[2], r[3]) for r in refdata.usage_rows() if r[0] == "ecoli" and r[2] != "*"], "codon, aa, f")
register(
    "co_4_codon_usage_table", lambda t: out(codons.codon_usage_table(t.dna_n)),
    f"""WITH c AS (SELECT seq_id, codon FROM (SELECT seq_id, unnest(list_transform(range(0, length(s) - 2, 3), lambda p: substr(s, (p + 1)::int, 3))) AS codon FROM {_UP}) WHERE NOT contains(codon, 'N')),
        n AS (SELECT seq_id, codon, count(*) AS count FROM c GROUP BY ALL), tot AS (SELECT seq_id, count(*) AS total FROM c GROUP BY ALL)
        SELECT q.seq_id, u.aa, u.codon, round(CAST(u.f AS DOUBLE), 6) AS per_thousand, coalesce(n.count, 0) AS count, round(CAST(CASE WHEN total > 0 THEN 1000.0 * coalesce(n.count, 0) / total ELSE 0 END AS DOUBLE), 6) AS seq_per_thousand,
        u.f = max(u.f) OVER (PARTITION BY q.seq_id, u.aa) AS is_optimal FROM {_UP} q CROSS JOIN {USAGE} u LEFT JOIN n ON n.seq_id = q.seq_id AND n.codon = u.codon LEFT JOIN tot ON tot.seq_id = q.seq_id""",
)
ALL_USAGE = refdata.values_sql(refdata.usage_rows(), "organism, codon, aa, per_thousand, codon_order")
_SEEN = lambda t: t.dna.select(F.explode(C.codons(F.col("sequence"))).alias("codon")).groupBy("codon").agg(F.count("*").alias("seen"))
register(
    "co_5_usage_tables", lambda t: out(refdata.usage_tables(t.spark).join(_SEEN(t), "codon", "left").fillna(0, ["seen"])),
    f"""SELECT organism, u.codon, aa, round(CAST(per_thousand AS DOUBLE), 6) AS per_thousand, CAST(codon_order AS BIGINT) AS codon_order, coalesce(seen, 0) AS seen FROM {ALL_USAGE} u
        LEFT JOIN (SELECT codon, count(*) AS seen FROM (SELECT unnest(list_transform(range(0, length(sequence) - 2, 3), lambda p: substr(sequence, (p + 1)::int, 3))) AS codon FROM $dna) GROUP BY codon) c ON c.codon = u.codon""",
)

# ---- annotation
LIBRARY = refdata.values_sql([r for r in refdata.template_rows()], "name, type, color, template")
FOUND = f"""(SELECT DISTINCT seq_id, name, type, CASE WHEN strand = '+' THEN spot ELSE length(s) - spot - length(template) END AS start, CASE WHEN strand = '+' THEN spot ELSE length(s) - spot - length(template) END + length(template) AS "end", strand, color, 'auto' AS source
        FROM (SELECT *, unnest(range(0, length(s) - length(template) + 1)) AS spot FROM (SELECT seq_id, '+' AS strand, sequence AS s FROM $planted UNION ALL SELECT seq_id, '-', reverse(translate(sequence, 'ATCG', 'TAGC')) FROM $planted) JOIN {LIBRARY} l ON contains(s, template)) WHERE substr(s, (spot + 1)::int, length(template)) = template)"""
_A = lambda t: annotate.auto_annotate(t.planted, refdata.feature_library(t.spark))
register("an_1_auto_annotate", lambda t: out(_A(t)), f"SELECT * FROM {FOUND}")
register(
    "an_2_feature_library", lambda t: out(refdata.feature_library(t.spark).join(_A(t).groupBy("name").agg(F.count("*").alias("found")), "name", "left").fillna(0, ["found"])),
    f"SELECT l.name, type, color, template AS sequence, coalesce(found, 0) AS found FROM {LIBRARY} l LEFT JOIN (SELECT name, count(*) AS found FROM {FOUND} GROUP BY name) n ON n.name = l.name",
)
_ROWS = "CASE WHEN l_linenumber = 1 THEN NULL ELSE concat('f', CAST(l_orderkey AS STRING)) END AS name"
register(
    "an_3_add_annotations",
    lambda t: out(annotate.add_annotations(
        t.features.where("l_linenumber > 3").select("seq_id", F.lit("old").alias("name"), "type", "start", F.col("end_pos").alias("end"), "strand", F.lit("file").alias("source")),
        t.features.where("l_linenumber <= 3").selectExpr("seq_id", _ROWS, "CASE WHEN strand = '-' THEN type END AS type", "start", "end_pos AS `end`", "CASE WHEN strand = '-' THEN strand END AS strand"),
    )),
    """SELECT seq_id, 'old' AS name, type, CAST(start AS BIGINT) AS start, CAST(end_pos AS BIGINT) AS "end", strand, 'file' AS source FROM $features WHERE l_linenumber > 3
        UNION ALL SELECT seq_id, CASE WHEN l_linenumber = 1 THEN 'Feature' ELSE concat('f', CAST(l_orderkey AS VARCHAR)) END, CASE WHEN strand = '-' THEN type ELSE 'misc_feature' END, start - 1, end_pos, strand, 'manual' FROM $features WHERE l_linenumber <= 3""",
)
register("an_4_assign_tracks", lambda t: out(annotate.assign_tracks(t.features)))
register(
    "an_4_track_count", lambda t: out(annotate.track_count(t.features)),
    """SELECT seq_id, CAST(max(depth) AS BIGINT) AS tracks FROM (SELECT seq_id, sum(step) OVER (PARTITION BY seq_id ORDER BY spot, step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth FROM (
        SELECT seq_id, start AS spot, 1 AS step FROM $features UNION ALL SELECT seq_id, end_pos, -1 FROM $features)) GROUP BY seq_id""",
)
register(
    "an_5_feature_table",
    lambda t: out(annotate.feature_table(t.features.withColumns({"name": F.when(F.col("l_linenumber") == 1, F.concat(F.lit("n"), F.col("l_orderkey").cast("string"))), "qualifiers": F.when(F.col("l_linenumber") == 2, F.create_map(F.lit("gene"), F.lit("g2"))).when(F.col("l_linenumber") == 3, F.create_map(F.lit("product"), F.lit("p3")))}))),
    """SELECT seq_id, CASE l_linenumber WHEN 1 THEN concat('n', CAST(l_orderkey AS VARCHAR)) WHEN 2 THEN 'g2' WHEN 3 THEN 'p3' ELSE type END AS label, concat(CAST(start + 1 AS VARCHAR), '..', CAST(end_pos AS VARCHAR)) AS location,
        CAST(end_pos - start AS BIGINT) AS length, CASE WHEN strand = '-' THEN '<-' ELSE '->' END AS arrow FROM $features""",
)
register(
    "an_6_feature_coverage", lambda t: out(annotate.feature_coverage(t.features, t.dna.groupBy("seq_id").agg(F.max(F.length("sequence")).alias("length"))), "seq_id", "l_orderkey", "l_linenumber", "start_pct", "width_pct"),
    "SELECT f.seq_id, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(100.0 * start / length(q.sequence), 6) AS start_pct, round(100.0 * (end_pos - start) / length(q.sequence), 6) AS width_pct FROM $features f JOIN $dna q ON q.seq_id = f.seq_id WHERE length(q.sequence) > 0",
)
