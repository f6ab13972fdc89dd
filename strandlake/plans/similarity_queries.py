"""Queries over pairs of sequences and over trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandlake.functions import refdata
from strandlake.operators import align, trees
from strandlake.plans.registry import out, register


_EQUAL = "CASE WHEN {a} = {b} THEN 2 ELSE -1 END"
_TABLE = "MAP {" + ", ".join(f"'{x}{y}': {v}" for (x, y), v in refdata.blosum62().items()) + "}"
_PROTEIN = f"(CASE WHEN coalesce(({_TABLE})[{{a}} || {{b}}], 0) = 0 THEN -1 ELSE ({_TABLE})[{{a}} || {{b}}] END)"


def dp_sql(pairs: str, local: bool, score: str = _EQUAL) -> str:
    """(id_a, id_b, score) of pairs (id_a, id_b, sa, sb), one matrix row a recursion step."""
    pair = score.replace("{a}", "substr(sa, (h.i + 1)::int, 1)").replace("{b}", "substr(sb, h.j::int, 1)")
    edge, floor = ("0", "greatest(0, ") if local else ("j * -2", "(")
    first = "0" if local else "(h.i + 1) * -2"
    last = "max(v)" if local else "max(v) FILTER (i = length(sa) AND j = length(sb))"
    return f"""(WITH RECURSIVE p AS (SELECT * FROM {pairs}), h(ia, ib, i, j, v) AS (
        SELECT id_a, id_b, 0, j, {edge} FROM (SELECT id_a, id_b, unnest(range(0, length(sb) + 1)) AS j FROM p) UNION ALL
        SELECT ia, ib, i, j, max(c + 2 * j) OVER (PARTITION BY ia, ib ORDER BY j) - 2 * j FROM (
        SELECT h.ia, h.ib, h.i + 1 AS i, h.j, CASE WHEN h.j = 0 THEN {first} ELSE {floor}greatest(lag(v) OVER (PARTITION BY h.ia, h.ib ORDER BY h.j) + {pair}, v - 2)) END AS c
        FROM h JOIN p ON p.id_a = h.ia AND p.id_b = h.ib WHERE h.i < length(sa)) x)
        SELECT ia AS id_a, ib AS id_b, CAST({last} AS BIGINT) AS score FROM h JOIN p ON p.id_a = h.ia AND p.id_b = h.ib GROUP BY ia, ib)"""


PAIRS = "(SELECT a.grp, a.seq_id AS id_a, b.seq_id AS id_b, a.sequence AS sa, b.sequence AS sb FROM $short a JOIN $short b ON a.grp = b.grp AND a.seq_id < b.seq_id)"
_P = lambda t: align.pairs_within(t.short)
register("al_1_align_global", lambda t: out(align.align_pairs(_P(t)), "id_a", "id_b", "score"), f"SELECT id_a, id_b, score FROM {dp_sql(PAIRS, False)}")
register("al_2_align_local", lambda t: out(align.align_pairs(_P(t), "local"), "id_a", "id_b", "score"), f"SELECT id_a, id_b, score FROM {dp_sql(PAIRS, True)}")
PROTEINS = PAIRS.replace("$short", "$short_protein")
_Q = lambda t: align.pairs_within(t.short_protein)
register("al_1_align_protein", lambda t: out(align.align_pairs(_Q(t), kind="protein"), "id_a", "id_b", "score"), f"SELECT id_a, id_b, score FROM {dp_sql(PROTEINS, False, _PROTEIN)}")
register("al_2_align_protein_local", lambda t: out(align.align_pairs(_Q(t), "local", "protein"), "id_a", "id_b", "score"), f"SELECT id_a, id_b, score FROM {dp_sql(PROTEINS, True, _PROTEIN)}")
_FLAT = f"(SELECT id_a, id_b, sa || repeat('-', (greatest(length(sa), length(sb)) - length(sa))::int) AS x, sb || repeat('-', (greatest(length(sa), length(sb)) - length(sb))::int) AS y FROM {PAIRS})"
_PAD = lambda s, o: F.rpad(s, F.greatest(F.length(s), F.length(o)), F.lit("-"))
register(
    "al_3_alignment_stats",
    lambda t: out(align.alignment_stats(_P(t).withColumns({"aligned_a": _PAD(F.col("seq_a"), F.col("seq_b")), "aligned_b": _PAD(F.col("seq_b"), F.col("seq_a"))})), "id_a", "id_b", "identity", "gaps"),
    f"""SELECT id_a, id_b, round(CASE WHEN length(x) > gaps THEN 100.0 * same / (length(x) - gaps) ELSE 0 END, 6) AS identity, gaps FROM (SELECT *,
        len(list_filter(range(1, length(x) + 1), lambda i: substr(x, i::int, 1) = '-' OR substr(y, i::int, 1) = '-')) AS gaps,
        len(list_filter(range(1, length(x) + 1), lambda i: substr(x, i::int, 1) = substr(y, i::int, 1) AND substr(x, i::int, 1) <> '-')) AS same FROM {_FLAT})""",
)
_LONGEST = lambda: F.max(F.length("sequence")).over(Window.partitionBy("grp"))
register(
    "al_4_consensus", lambda t: out(align.consensus(t.short.withColumn("n", _LONGEST()).select("grp", "seq_id", F.rpad("sequence", F.col("n"), F.lit("-")).alias("aligned")))),
    """SELECT grp, string_agg(c, '' ORDER BY i) AS consensus FROM (SELECT grp, i, c, row_number() OVER (PARTITION BY grp, i ORDER BY c = '-', n DESC, first) AS rk FROM (
        SELECT grp, i, c, count(*) AS n, min(seq_id) AS first FROM (SELECT grp, seq_id, i, substr(s, i::int, 1) AS c FROM (SELECT grp, seq_id, rpad(sequence, m::int, '-') AS s, unnest(range(1, m + 1)) AS i FROM (
        SELECT *, max(length(sequence)) OVER (PARTITION BY grp) AS m FROM $short))) GROUP BY ALL)) WHERE rk = 1 GROUP BY grp""",
)
register("al_5_star_alignment", lambda t: out(align.star_alignment(t.short, 0)))
register("al_6_pairwise_distances", lambda t: out(align.pairwise_distances(t.short)))
_KMER = "(SELECT DISTINCT seq_id, substr(sequence, (p + 1)::int, 11) AS kmer FROM (SELECT seq_id, sequence, unnest(range(0, length(sequence) - 10)) AS p FROM {}))"
CANDIDATES = f"(SELECT a.seq_id AS id_a, b.seq_id AS id_b, count(*) AS shared FROM {_KMER.format('$short')} a JOIN {_KMER.format('$dna')} b ON a.kmer = b.kmer WHERE a.seq_id <> b.seq_id GROUP BY ALL HAVING count(*) >= 2)"
register("al_7_candidate_pairs", lambda t: out(align.candidate_pairs(t.short, t.dna)), f"SELECT * FROM {CANDIDATES}")
register("al_7_search_seeded", lambda t: out(align.search_seeded(t.short, t.dna)))
register("al_7_search_similar", lambda t: out(align.search_similar(t.short, t.dna)))
register(
    "al_8_dot_plot", lambda t: out(align.dot_plot(_P(t))),
    f"""SELECT id_a, id_b, i, j, matches FROM (SELECT id_a, id_b, i, j, len(list_filter(range(1, 11), lambda k: substr(sa, (i + k)::int, 1) = substr(sb, (j + k)::int, 1))) AS matches FROM (
        SELECT *, unnest(range(0, length(sb) - 9)) AS j FROM (SELECT *, unnest(range(0, length(sa) - 9)) AS i FROM {PAIRS}))) WHERE matches >= 7""",
)

NEWICK = lambda t: t.nation.join(t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.round(F.abs(F.avg("s_acctbal")) / 10000, 4).alias("len")), "n_nationkey").groupBy(F.col("n_regionkey").cast("long").alias("tree_id")).agg(F.concat(F.lit("("), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name", "len"))), lambda x: F.concat(x["n_name"], F.lit(":"), F.format_string("%.4f", x["len"]))), ","), F.lit(");")).alias("newick"))
_LEAVES = "(SELECT n_regionkey, n_nationkey, n_name, round(abs(avg(s_acctbal)) / 10000, 4) AS len FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)"
register("ph_2_neighbor_joining", lambda t: out(trees.neighbor_joining(align.pairwise_distances(t.short))))
register("ph_3_to_newick", lambda t: out(trees.to_newick(trees.neighbor_joining(align.pairwise_distances(t.short)))))
register("ph_4_read_newick", lambda t: out(trees.read_newick(NEWICK(t)), "tree_id", "name", "length", "rank"), f"SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS tree_id, '' AS name, CAST(0 AS DOUBLE) AS length, 0 AS rank FROM {_LEAVES} UNION ALL SELECT CAST(n_regionkey AS BIGINT) AS tree_id, n_name AS name, round(CAST(len AS DOUBLE), 6) AS length, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS rank FROM {_LEAVES}")
register("ph_5_tree_summary", lambda t: out(trees.tree_summary(trees.read_newick(NEWICK(t)))), f"SELECT CAST(n_regionkey AS BIGINT) AS tree_id, count(*) AS leaves, round(CAST(max(CASE WHEN len = 0 THEN 0.1 ELSE len END) AS DOUBLE), 6) AS max_depth FROM {_LEAVES} GROUP BY ALL")
