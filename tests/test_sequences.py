"""Hand-made values and properties of the sequence operators."""

import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import columns as C
from strandlake.functions import refdata
from strandlake.operators import align, annotate, chunks, codons, composition, metrics, orfs, patterns, primers, restriction, structure, transforms, trees, windows


@pytest.fixture
def seqs(spark):
    return lambda *texts, **more: spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq_id long, sequence string").withColumns({k: F.lit(v) for k, v in more.items()})


def values(df, column):
    return [r[column] for r in df.orderBy(df.columns[0]).collect()]


def test_complements_and_translation(seqs):
    assert values(transforms.complement(seqs("AUGC", "acgtN")), "sequence") == ["TACG", "tgcaN"]
    assert values(transforms.translate_frame(seqs("ATGNNNTA", "AUGUAA", "", "AT")), "protein") == ["MX", "XX", "", ""]
    twice = transforms.reverse_complement(transforms.reverse_complement(seqs("ACGTTGCA")))
    assert values(twice, "sequence") == ["ACGTTGCA"]
    assert values(transforms.reverse_transcribe(transforms.transcribe(seqs("ATGCttg"))), "sequence") == ["ATGCttg"]


def test_composition(seqs):
    assert values(composition.gc_content(seqs("GGNN", "", "NN")), "gc") == [100.0, 0.0, 0.0]
    assert values(composition.melting_temp(seqs("ATGC", "GCGCGCGCGCATATATATAT", "")), "tm") == pytest.approx([12.0, 51.78, 0.0])
    assert values(composition.molecular_weight(seqs("X", type="protein")), "weight") == pytest.approx([0.0])


def test_orfs(seqs):
    assert [tuple(r) for r in orfs.find_orfs(seqs("ATGAAATAA", "ATGAAAAAA"), 9).collect()] == [(0, 1, 0, 9, 9, "MK*")]


def test_matches_overlap_only_where_they_should(spark, seqs):
    hits = patterns.find_motifs(seqs("ATATAT"), patterns.motif_table(spark, [("m", "ATAT")]), both_strands=False)
    assert values(hits, "pos") == [0]
    library = spark.createDataFrame([("m", "CDS", "#0", "ATAT")], "name string, type string, color string, sequence string")
    found = annotate.auto_annotate(seqs("ATATAT"), library).where("strand = '+'")
    assert sorted(r.start for r in found.collect()) == [0, 2]
    with pytest.raises(ValueError):
        patterns.pattern_of("A*", "regex")


@pytest.mark.parametrize("chunk", [7, 64, 4096])
def test_motifs_of_fixed_length_are_those_of_their_patterns(spark, monkeypatch, chunk):
    """Against Python's search of both strands, whatever the chunks, also for motifs that are longer."""
    monkeypatch.setattr(chunks, "CHUNK", chunk)
    monkeypatch.setattr(chunks.with_halo, "__defaults__", (chunk, 0))
    rng = random.Random(chunk)
    made = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    texts = [made(rng.randrange(300)) for _ in range(8)] + ["A" * 50, made(200, "AC"), made(90, "ACGTUNX"), ""]
    long = texts[7][3:60]
    exact = ["A", "AA", "ACA", "GAT", "CACACACACA", long, long[:20], "UG", "NX"] + [made(4) for _ in range(60)]
    iupac = ["N", "NN", "RY", "AWS", "NNNNNNNNNNNNNNNNNNNNNNNNNA", "ANNNNNNNNNNT"]
    own = spark.createDataFrame([(i, t.lower(), ["dna", "protein"][i == 2]) for i, t in enumerate(texts)], "seq_id long, sequence string, type string")
    table = patterns.motif_table(spark, [(f"e{m}", m) for m in exact], "exact").union(patterns.motif_table(spark, [(f"i{m}", m) for m in iupac], "iupac"))
    opposite = lambda t: t.translate(str.maketrans("ATCGU", "TAGCA"))[::-1]
    want = set()
    for i, t in enumerate(texts):
        for mode, motifs in (("exact", exact), ("iupac", iupac)):
            for m in set(motifs):
                for strand, s in (("+", t), *([("-", opposite(t))] if i != 2 else [])):
                    want |= {(i, f"{mode[0]}{m}", strand, x.start() if strand == "+" else len(t) - x.end(), x[0]) for x in re.finditer(patterns.pattern_of(m, mode), s)}
    got = [tuple(r) for r in patterns.find_motifs(own, table).collect()]
    assert len(want) > 2000 and set(got) == want


def test_many_motifs_make_no_product(spark, seqs):
    rng = random.Random(9)
    motifs = ["".join(rng.choice("ACGT") for _ in range(12)) for _ in range(10_000)]
    text = "".join(rng.choice("ACGT") for _ in range(100_000)) + motifs[17]
    found = patterns.find_motifs(seqs(text, text), patterns.motif_table(spark, [(m, m) for m in motifs]), both_strands=False)
    want = sorted((m, x.start()) for m in set(motifs) for x in re.finditer(m, text))
    assert sorted((r.motif, r.pos) for r in found.where("seq_id = 1").dropDuplicates().collect()) == want and len(want) > 1
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in patterns._find_fixed(seqs(text), patterns.motif_table(spark, [("m", text[:12])]), True)._jdf.queryExecution().toString()


def test_digest(spark, seqs):
    sites = restriction.restriction_sites(seqs("GAATTC"), refdata.enzymes(spark).where("name = 'EcoRI'"))
    pieces = restriction.digest(seqs("GAATTC"), sites)
    assert sorted((r.start, r.end, r["size"]) for r in pieces.collect()) == [(0, 1, 1), (1, 6, 5)]
    assert len(refdata.enzyme_rows()) == 122


def test_words_and_scan_agree_on_every_enzyme(spark, seqs):
    import re

    rng = random.Random(1)
    texts = ["".join(rng.choice("ACGTN") for _ in range(400)) for _ in range(4)]
    found = {(r.seq_id, r.name, r.pos) for r in restriction.restriction_sites(seqs(*texts), refdata.enzymes(spark)).collect()}
    want = {(i, e[0], m.start()) for i, t in enumerate(texts) for e in refdata.enzyme_rows() for m in re.finditer(f"(?={refdata.as_class(e[1])})", t)}
    assert found == want


def test_primers_and_codons(seqs):
    rng = random.Random(2)
    text = "".join(rng.choice("ACGT") for _ in range(200))
    rows = {r.direction: r for r in primers.design_primers(seqs(text)).collect()}
    assert rows["forward"].start == 0 and rows["reverse"].end == 200
    better = codons.optimize_codons(seqs(text)).select("seq_id", F.col("optimized").alias("sequence"))
    assert values(transforms.translate_frame(better), "protein") == values(transforms.translate_frame(seqs(text)), "protein")


def test_results_do_not_depend_on_chunks(spark, seqs, monkeypatch):
    rng = random.Random(3)
    own = seqs("".join(rng.choice("ACGT") for _ in range(200)), "", "ACG", "".join(rng.choice("ACGTNacgtn") for _ in range(64)))
    made = {
        "gc": lambda: windows.window_gc(own, 10), "wide": lambda: windows.window_at_skew(own, 50), "complexity": lambda: windows.window_complexity(own, 10), "cpg": lambda: windows.window_cpg(own, 12),
        "mass": lambda: windows.window_residue_mass(own, 7), "sites": lambda: restriction.restriction_sites(own, refdata.enzymes(spark)),
        "digest": lambda: restriction.digest(own, restriction.restriction_sites(own, refdata.enzymes(spark))), "orfs": lambda: orfs.find_orfs(own, 9), "words": lambda: align.kmers(own, 5),
        "features": lambda: annotate.auto_annotate(own, spark.createDataFrame([("m", "CDS", "#0", "ACG")], "name string, type string, color string, sequence string")),
    }
    whole = {k: sorted(map(str, f().collect())) for k, f in made.items()}
    assert all(whole.values())
    for size in (16, 64):
        monkeypatch.setattr(chunks, "CHUNK", size)
        assert {k: sorted(map(str, f().collect())) for k, f in made.items()} == whole


def test_a_name_with_two_sites(spark, seqs):
    own = spark.createDataFrame([("X", "GAATTC", 1, "g"), ("X", "GNNNNNNC", 1, "g"), ("Y", "NNNNNNNNA", 1, "g")], "name string, site string, cut int, group string")
    found = {(r.name, r.site, r.pos) for r in restriction.restriction_sites(seqs("TTGAATTCTTGTTTTTTCACCA"), own).collect()}
    assert found == {("X", "GAATTC", 2), ("X", "GNNNNNNC", 10), ("Y", "NNNNNNNNA", 10), ("Y", "NNNNNNNNA", 13)}


def test_a_long_sequence_is_cut_in_time(spark, seqs):
    import time

    rng = random.Random(6)
    own = seqs("".join(rng.choices("ACGT", k=1_000_000)))
    began = time.perf_counter()
    sites = restriction.restriction_sites(own, refdata.enzymes(spark))
    assert restriction.digest(own, sites).agg(F.sum("size")).first()[0] == 1_000_000
    assert orfs.find_orfs(own, 90).count() > 1000 and windows.window_gc(own, 50).count() == 999_951
    assert time.perf_counter() - began < 60


def slow_score(a, b, scores, local):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == j == 0:
                continue
            ways = [h[i - 1][j] - 2] * (i > 0) + [h[i][j - 1] - 2] * (j > 0)
            if i and j:
                ways.append(h[i - 1][j - 1] + int(scores[ord(a[i - 1]), ord(b[j - 1])]))
            h[i][j] = max(ways + [0] * local) if not local or (i and j) else 0
    return max(map(max, h)) if local else h[-1][-1]


@pytest.mark.parametrize("kind", ["nucleotide", "protein"])
@pytest.mark.parametrize("local", [False, True])
def test_alignment_scores(kind, local):
    rng, scores = random.Random(4), align.substitution(kind)
    letters = "ACGT" if kind == "nucleotide" else refdata.RESIDUE_ORDER
    for _ in range(60):
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(0, 15))) for _ in range(2))
        score, x, y, i, j = align.align(a, b, scores, local)
        assert score == slow_score(a, b, scores, local) and len(x) == len(y)
        assert sum(-2 if "-" in p else int(scores[ord(p[0]), ord(p[1])]) for p in zip(x, y, strict=True)) == score
        assert a[i:].startswith(x.replace("-", "")) and b[j:].startswith(y.replace("-", ""))


def test_alignment_goldens():
    assert align.align("ACGT", "ACT", align.substitution())[:3] == (4, "ACGT", "AC-T")
    assert align.align("A", "C", align.substitution("protein"))[0] == -1
    assert align.align("A", "C", align.substitution("protein", zero_fix=True))[0] == 0


def test_star_alignment_rows_have_one_width(seqs):
    rows = align.star_alignment(seqs("ACGTACGT", "ACGTTTACGT", "AGTACG", "GGACGTACGT"), 0).collect()
    assert len({len(r.aligned) for r in rows}) == 1
    assert {r.seq_id: r.aligned.replace("-", "") for r in rows} == {0: "ACGTACGT", 1: "ACGTTTACGT", 2: "AGTACG", 3: "GGACGTACGT"}


def test_trees(spark):
    d = spark.createDataFrame([(1, 1, 2, 0.4)], "grp long, id_a long, id_b long, distance double")
    nodes = trees.neighbor_joining(d)
    assert sorted(r.length for r in nodes.where("name <> ''").collect()) == [0.2, 0.2]
    text = spark.createDataFrame([(1, "((A:0.1,B:0.2)x:0.3,C:x,D);"), (2, "solo:1")], "tree_id long, newick string")
    read = {(r.tree_id, r.name): r for r in trees.read_newick(text).collect()}
    assert read[1, "A"].parent_id == read[1, "x"].node_id and read[1, "x"].parent_id == read[1, ""].node_id == read[1, "D"].parent_id
    assert read[1, "C"].length == 0.0 and read[2, "solo"].parent_id is None
    assert {r.tree_id: (r.leaves, round(r.max_depth, 6)) for r in trees.tree_summary(trees.read_newick(text)).collect()} == {1: (4, 0.5), 2: (1, 0.0)}
    assert [r.newick for r in trees.to_newick(trees.read_newick(text).where("tree_id = 1")).collect()] == ["((A:0.1000,B:0.2000)x:0.3000,C,D)"]


def test_metrics_and_pockets(spark):
    s = spark.createDataFrame([(1, "g", 0, 0.1), (2, "g", 0, 0.4), (3, "g", 1, 0.35), (4, "g", 1, 0.8)], "id long, grp string, y_true int, y_proba double")
    assert metrics.roc_auc(s).first().roc_auc == 0.75
    assert metrics.roc_auc(s.withColumn("y_proba", 1 - F.col("y_proba"))).first().roc_auc == pytest.approx(0.25)
    sites = spark.createDataFrame([("s", "A", 1), ("s", "A", 7), ("s", "A", 14)], "structure_id string, chain string, resi int")
    assert sorted((r.pocket, r["size"]) for r in metrics.pocket_clusters(sites).collect()) == [(1, 2), (2, 1)]


def test_tracks_never_overlap(spark):
    rng = random.Random(5)
    rows = [(s, a, a + rng.randrange(1, 9)) for s in range(3) for a in (rng.randrange(40) for _ in range(30))]
    own = annotate.assign_tracks(spark.createDataFrame(rows, "seq_id long, start int, end_pos int"))
    out = own.collect()
    for x in out:
        assert not any(x is not y and (x.seq_id, x.track) == (y.seq_id, y.track) and x.start < y.end_pos and y.start < x.end_pos for y in out)
    deepest = {r.seq_id: r.tracks for r in annotate.track_count(spark.createDataFrame(rows, "seq_id long, start int, end_pos int")).collect()}
    assert {s: max(r.track for r in out if r.seq_id == s) + 1 for s in range(3)} == deepest


def test_isolated_residue_gets_a_loop(spark):
    one = spark.createDataFrame([("s", 0, "A", 1.0, 2.0, 3.0)], "structure_id string, idx int, aa string, x double, y double, z double")
    edges = structure.residue_edges(one)
    assert [(r.src, r.dst) for r in edges.collect()] == [(0, 0)]
    assert structure.edge_features(edges, one).first().attr == [0.0] * 20


def test_types(seqs):
    got = values(seqs("", "ACGTACGT", "ACGUACGU", "MKVLLDEF", "12 *").select("seq_id", C.detect_type(F.col("sequence")).alias("type")), "type")
    assert got == ["unknown", "dna", "rna", "protein", "unknown"]


def slow_alignment(a, b):
    """Identity of the global alignment that goes back by the diagonal, then up, then left."""
    h = [[-2 * (i + j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    same = lambda i, j: 2 if a[i - 1] == b[j - 1] else -1
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(h[i - 1][j - 1] + same(i, j), h[i - 1][j] - 2, h[i][j - 1] - 2)
    i, j, x, y = len(a), len(b), "", ""
    while i or j:
        if i and j and h[i][j] == h[i - 1][j - 1] + same(i, j):
            i, j, x, y = i - 1, j - 1, a[i - 1] + x, b[j - 1] + y
        elif i and h[i][j] == h[i - 1][j] - 2:
            i, x, y = i - 1, a[i - 1] + x, "-" + y
        else:
            j, x, y = j - 1, "-" + x, b[j - 1] + y
    return x, y


def made_group(n, seed):
    rng = random.Random(seed)
    root = "".join(rng.choice("ACGT") for _ in range(30))
    out = []
    for _ in range(n):
        s = list(root)
        for _ in range(rng.randrange(9)):
            k = rng.randrange(len(s))
            s[k : k + rng.randrange(2)] = rng.choice(["A", "", "GT", "C"])
        out.append("".join(s))
    return out


def test_distances_and_star_alignment(spark):
    texts = made_group(7, 11)
    own = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "grp int, seq_id long, sequence string")
    pairs = {(i, j): slow_alignment(texts[i], texts[j]) for i in range(7) for j in range(7)}
    for r in align.pairwise_distances(own).collect():
        x, y = pairs[r.id_a, r.id_b]
        both = [(p, q) for p, q in zip(x, y, strict=True) if p != "-" and q != "-"]
        assert r.distance == pytest.approx(1 - sum(p == q for p, q in both) / len(both))
    cells = {}
    for j in range(7):
        ref = k = 0
        for p, q in zip(*pairs[0, j], strict=True):
            ref, k = (ref + 1, 0) if p != "-" else (ref, k + 1)
            cells[j, ref, k] = q
    columns = sorted({c[1:] for c in cells})
    want = {j: "".join(cells.get((j, *c), "-") for c in columns) for j in range(7)}
    assert {r.seq_id: r.aligned for r in align.star_alignment(own, 0).collect()} == want


def slow_tree(names, d):
    """Splits of the leaves, with their lengths, by neighbour joining on a dictionary of distances."""
    live, d, out = [(frozenset([x])) for x in names], {(frozenset([a]), frozenset([b])): v for (a, b), v in d.items()}, {}
    d |= {(b, a): v for (a, b), v in d.items()}
    while len(live) > 2:
        r = {x: sum(d[x, y] for y in live if y != x) for x in live}
        q, i, j = min(((len(live) - 2) * d[x, y] - r[x] - r[y], i, j) for i, x in enumerate(live) for j, y in enumerate(live) if i < j)
        x, y = live[i], live[j]
        left = d[x, y] / 2 + (r[x] - r[y]) / (2 * (len(live) - 2))
        out[x], out[y] = max(0.0, left), max(0.0, d[x, y] - left)
        new = x | y
        for z in live:
            if z not in (x, y):
                d[new, z] = d[z, new] = (d[x, z] + d[y, z] - d[x, y]) / 2
        live = [z for z in live if z not in (x, y)] + [new]
    out[live[0]] = out[live[1]] = d[live[0], live[1]] / 2
    return out


def test_neighbor_joining_by_bounds_gives_the_tree_of_the_whole_matrix():
    rng = np.random.default_rng(5)
    for n, ties in [(60, True), (60, False), (300, False), (40, True)]:
        d = rng.integers(1, 6 if ties else 1 << 30, (n, n)).astype(float)
        d = np.triu(d, 1) + np.triu(d, 1).T
        whole, bounded = trees._Tree(n), trees._Tree(n)
        trees._join_whole(whole, d.copy(), list(range(n)))
        trees._join_whole(bounded, *trees._join_bounded(bounded, d.copy(), n // 2 if ties else 3))
        assert (whole.parent == bounded.parent).all() and (whole.rank == bounded.rank).all()
        assert np.allclose(whole.length, bounded.length)


def test_neighbor_joining_of_a_lone_leaf_names_as_text_and_no_rows(spark):
    schema = "grp int, id_a string, id_b string, distance double"
    rows = [(1, "x", None, None), (2, "q", "b", 0.4), (2, "a", "q", 0.6), (2, "a", "b", 0.2)]
    nodes = trees.neighbor_joining(spark.createDataFrame(rows, schema)).collect()
    assert [(r.node_id, r.parent_id, r.name) for r in nodes if r.tree_id == 1] == [(0, None, "x")]
    assert [r.name for r in sorted(nodes, key=lambda r: r.node_id) if r.tree_id == 2] == ["a", "b", "q", "", ""]
    assert trees.neighbor_joining(spark.createDataFrame([], schema)).count() == 0


def test_neighbor_joining_and_its_text(spark):
    rng = random.Random(12)
    d = {(a, b): round(rng.uniform(0.1, 1), 3) for a in range(6) for b in range(6) if a < b}
    nodes = trees.neighbor_joining(spark.createDataFrame([(1, a, b, v) for (a, b), v in d.items()], "grp long, id_a long, id_b long, distance double"))
    rows = {r.node_id: r for r in nodes.collect()}
    leaves = lambda k: frozenset([int(rows[k].name)]) if rows[k].name else frozenset().union(*(leaves(c) for c in rows if rows[c].parent_id == k))
    got = {leaves(k): r.length for k, r in rows.items() if r.parent_id is not None}
    want = slow_tree(list(range(6)), d)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    again = trees.read_newick(trees.to_newick(nodes).select("tree_id", "newick"))
    back = {r.node_id: r for r in again.collect()}
    leaves2 = lambda k: frozenset([int(back[k].name)]) if back[k].name else frozenset().union(*(leaves2(c) for c in back if back[c].parent_id == k))
    assert {leaves2(k): r.length for k, r in back.items() if r.parent_id is not None} == {k: pytest.approx(v, abs=1e-4) for k, v in want.items()}


def test_a_circle_of_parents_is_an_error(spark):
    with pytest.raises(ValueError):
        trees.tree_summary(spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 1, 1.0), (1, 3, 1, 1.0)], "tree_id long, node_id long, parent_id long, length double"))


def test_deep_trees_take_few_joins(spark):
    """A comb of 3000 leaves: the k-th leaf hangs k levels deep."""
    n = 3000
    rows = [(1, k, k + 1 if k < n - 2 else None, 0.0 if k % 2 else 0.5) for k in range(n - 1)] + [(1, n + k, min(k, n - 2), 0.25) for k in range(n)]
    began = time.time()
    r = trees.tree_summary(spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, length double")).first()
    depth = [0.0]
    for k in range(n - 3, -1, -1):
        depth.append(depth[-1] + (0.1 if k % 2 else 0.5))
    assert (r.leaves, r.max_depth) == (n, pytest.approx(max(depth) + 0.25)) and time.time() - began < 90


@pytest.mark.parametrize("step", [5, 1 << 20])
def test_frames_of_chunks_are_those_of_whole_sequences(spark, monkeypatch, step):
    monkeypatch.setattr(orfs, "RANGE", step * 3)
    monkeypatch.setattr(chunks, "CHUNK", 64 if step == 5 else 4096)
    rng = random.Random(step)
    texts = ["".join(rng.choice("ACGT" + "TAG" * (i % 2)) for _ in range(rng.randrange(900))) for i in range(6)] + ["", "AT", "ACGUN" * 30, "ATGTTATGAUAACAU" * 9]
    own = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq_id long, sequence string")
    size = chunks.CHUNK
    cut = spark.createDataFrame([(i, k, k * size, t[k * size : (k + 1) * size]) for i, t in enumerate(texts) for k in range(-(-len(t) // size))], "seq_id long, chunk int, start long, sequence string")
    frames = {(r.seq_id, r.frame): r.protein for r in orfs.six_frame_translation(own).collect()}
    want = {(i, f, sum(len(x) + 1 for x in p.split("*")[:k]) + x.index("M"), x[x.index("M") :] + "*") for (i, f), p in frames.items() for k, x in enumerate(p.split("*")[:-1]) if len(x) - x.find("M") >= 4 and "M" in x}
    for rows in (own, cut):
        assert {(r.seq_id, r.frame, r.start, r.protein) for r in orfs.six_frame_orfs(rows, 4).collect()} == want
        parts = {}
        for r in sorted(orfs.six_frame_parts(rows).collect(), key=lambda r: r["at"]):
            before = parts.get((r.seq_id, r.frame), "")
            assert len(before) == r["at"]
            parts[r.seq_id, r.frame] = before + r.protein
        assert parts == {k: v for k, v in frames.items() if v}
    assert len(want) > 30 and orfs.find_orfs(own, 9).collect() and sorted(orfs.find_orfs(own, 9).collect()) == sorted(orfs.find_orfs(cut, 9).collect())


def test_ranks_of_similar_sequences(spark):
    queries, targets = made_group(4, 13), made_group(25, 13)
    q = spark.createDataFrame([(i, t) for i, t in enumerate(queries)], "seq_id long, sequence string")
    t = spark.createDataFrame([(100 + i, t) for i, t in enumerate(targets)], "seq_id long, sequence string")
    words = lambda s: {s[k : k + 8] for k in range(len(s) - 7)}
    scores, want = align.substitution(), {}
    for i, a in enumerate(queries):
        found = [(-align.align(a, b, scores, True)[0], 100 + j) for j, b in enumerate(targets) if len(words(a) & words(b)) >= 2]
        want |= {(i, j): k + 1 for k, (_, j) in enumerate(sorted(found)[:5])}
    assert {(r.id_a, r.id_b): r["rank"] for r in align.search_similar(q, t, k=8, top=5).collect()} == want and len(want) > 10


@pytest.mark.parametrize("deal", [1, 1000])
def test_candidates_do_not_depend_on_how_hot_words_are_dealt(spark, monkeypatch, deal):
    monkeypatch.setattr(align, "HOT_WORD", deal)
    texts = made_group(20, 14)
    own = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq_id long, sequence string")
    words = [{s[k : k + 6] for k in range(len(s) - 5)} for s in texts]
    want = {(i, j, len(words[i] & words[j])) for i in range(20) for j in range(20) if i != j and len(words[i] & words[j]) >= 2}
    assert {tuple(r) for r in align.candidate_pairs(own, own, k=6).collect()} == want


@pytest.mark.parametrize("window, threshold", [(10, 70.0), (6, 100.0), (4, 25.0)])
def test_dot_plot_finds_every_window(spark, window, threshold):
    texts = made_group(4, 15)
    pairs = [(i, j, texts[i], texts[j]) for i in range(4) for j in range(i)]
    want = set()
    for a, b, x, y in pairs:
        for i in range(len(x) - window + 1):
            for j in range(len(y) - window + 1):
                n = sum(p == q for p, q in zip(x[i : i + window], y[j : j + window], strict=True))
                if n >= -(-window * threshold // 100):
                    want.add((a, b, i, j, n))
    frame = spark.createDataFrame(pairs, "id_a long, id_b long, seq_a string, seq_b string")
    assert {tuple(r) for r in align.dot_plot(frame, window, threshold).collect()} == want


@pytest.mark.parametrize("span", [3, 17, 100_000])
def test_first_free_tracks(spark, monkeypatch, span):
    monkeypatch.setattr(annotate, "RANGE", span)
    rng = random.Random(16)
    rows = [(s, a, a + rng.randrange(12), f"f{s}-{k}") for s in range(3) for k in range(40) for a in [rng.randrange(50 * (1 + s * s))]] + [(2, 5, 190, "wide")]
    got = {r.name: r.track for r in annotate.assign_tracks(spark.createDataFrame(rows, "seq_id long, start int, end_pos int, name string")).collect()}
    for s in range(3):
        ends = []
        for _, start, end, name in sorted(r for r in rows if r[0] == s):
            k = next((i for i, e in enumerate(ends) if e <= start), len(ends))
            ends[k : k + 1] = [end]
            assert got[name] == k


def test_curves_of_scores_that_all_differ(spark):
    rng = random.Random(17)
    rows = [(i, rng.random() ** 3, int(rng.random() < 0.3)) for i in range(5000)]
    rows += [(9000 + i, 0.5, i % 2) for i in range(300)]
    counts = metrics.by_score(spark.createDataFrame(rows, "id long, y_proba double, y_true int")).collect()
    tp = fp = 0.0
    for r in sorted(counts, key=lambda r: -r.y_proba):
        tp, fp = tp + r.pos, fp + r.neg
        assert (r.tp, r.fp) == (tp, fp)
    assert (tp, fp) == (counts[0].P, counts[0].N) and len(counts) > 4900
    assert metrics.roc_curve(spark.createDataFrame([], "id long, y_proba double, y_true int")).count() == 0


@pytest.mark.parametrize("far", [1.0, 1e6, 1e15])
def test_nearest_of_uneven_points(spark, far):
    rng = random.Random(18)
    rows = [("d", i, *(rng.gauss(0, 1) + (far if i % 2 else 0) for _ in range(3))) for i in range(60)] + [("d", 60, -far, far, 0.0)] + [("e", i, 2.0, 2.0, float(i // 50)) for i in range(150)]
    rows += [("a", i, *(rng.gauss(0, 1) * (1 if i % 7 else 40) for _ in range(3))) for i in range(150)] + [("b", 0, 1.0, 2.0, 3.0), ("c", 0, 1.0, 1.0, 1.0), ("c", 1, 1.0, 1.0, 1.0), ("c", 2, 2.0, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "structure_id string, idx int, x double, y double, z double")
    want = set()
    for s, i, *p in rows:
        near = sorted((sum((u - v) ** 2 for u, v in zip(p, q, strict=True)) ** 0.5, j) for t, j, *q in rows if t == s and j != i)
        want |= {(s, i, j) for _, j in near[:4]}
    assert {(r.structure_id, r.src, r.dst) for r in structure.knn_edges(points, 4).collect()} == want
    some = [(s, i, *p) for s, i, *p in rows if i % 3 == 0]
    want = {(s, i, j) for s, i, *p in rows for _, j in sorted((sum((u - v) ** 2 for u, v in zip(p, q, strict=True)) ** 0.5, j) for t, j, *q in some if t == s)[:2]}
    assert {tuple(r)[:3] for r in structure.nearest(points, points.where("idx % 3 = 0"), 2).collect()} == want


def full_matrix(a, b, scores, local):
    """Score, rows and starts by the whole matrix."""
    h = [[0 if local else -2 * (i + j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    same = lambda i, j: int(scores[min(ord(a[i - 1]), 127), min(ord(b[j - 1]), 127)])
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(h[i - 1][j - 1] + same(i, j), h[i - 1][j] - 2, h[i][j - 1] - 2, *([0] if local else []))
    i, j = max(((i, j) for i in range(len(a) + 1) for j in range(len(b) + 1)), key=lambda p: (h[p[0]][p[1]], -p[0], -p[1])) if local else (len(a), len(b))
    score, x, y = h[i][j], "", ""
    while (i or j) and not (local and (h[i][j] == 0 or not i or not j)):
        if i and j and h[i][j] == h[i - 1][j - 1] + same(i, j):
            i, j, x, y = i - 1, j - 1, a[i - 1] + x, b[j - 1] + y
        elif i and h[i][j] == h[i - 1][j] - 2:
            i, x, y = i - 1, a[i - 1] + x, "-" + y
        else:
            j, x, y = j - 1, "-" + x, b[j - 1] + y
    return score, x, y, i, j


@pytest.mark.parametrize("parts", [2, 3, 64])
def test_alignment_in_parts_is_that_of_the_whole_matrix(monkeypatch, parts):
    monkeypatch.setattr(align, "PARTS", parts)
    rng = random.Random(parts)
    for _ in range(150):
        letters = rng.choice(["AC", "ACGT", "A", "MKWÉ"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(22))) for _ in range(2))
        for kind in ("nucleotide", "protein"):
            for local in (False, True):
                want = full_matrix(a, b, align.substitution(kind), local)
                assert all(align.align(a, b, align.substitution(kind), local, cells) == want for cells in (1, 40, None))


def test_long_alignment_in_little_memory():
    rng = random.Random(20)
    a = [rng.choice("ACGT") for _ in range(12_000)]
    b = list(a)
    for _ in range(300):
        k = rng.randrange(len(b))
        b[k : k + rng.randrange(3)] = rng.choice([[], ["A"], ["G", "T"]])
    tracemalloc.start()
    for local in (False, True):
        score, x, y, *_ = align.align("".join(a), "".join(b), align.substitution(), local)
        assert score > 20_000 and x.replace("-", "") in "".join(a) and y.replace("-", "") in "".join(b)
    assert tracemalloc.get_traced_memory()[1] < 80_000_000  # the whole matrix has 576 MB
    tracemalloc.stop()


def test_seeded_search_finds_families(spark):
    """Against the exact alignment of all pairs: the best 20 of each query, in families of copies with many changes."""
    rng = random.Random(21)
    made = lambda n: "".join(rng.choice("ACGT") for _ in range(n))

    def changed(s, share):
        s = list(s)
        for _ in range(int(share * len(s))):
            k = rng.randrange(len(s))
            s[k : k + rng.randrange(2)] = rng.choice(["", "A", "C", "GT"])
        return "".join(s)

    roots = [made(260) for _ in range(4)]
    texts = [made(rng.randrange(60)) + changed(r, 0.01 * k) + made(rng.randrange(60)) for r in roots for k in range(22)] + [made(200) for _ in range(40)]
    texts += [texts[3]] * 3
    own = spark.createDataFrame(list(enumerate(texts)), "seq_id long, sequence string").repartition(3)
    asked = own.where("seq_id in (0, 25, 50, 87)")
    got = align.search_seeded(asked, own).collect()
    scores, recall = align.substitution(), []
    for q in (0, 25, 50, 87):
        every = sorted(((-align.align(texts[q], t, scores, True)[0], i) for i, t in enumerate(texts) if i != q))[:20]
        mine = {r.id_b: r for r in got if r.id_a == q}
        recall.append(sum(i in mine for _, i in every) / 20)
        exact = {i: -s for s, i in every}
        assert all(r.score == exact[i] for i, r in mine.items() if i in exact) and sorted(r["rank"] for r in mine.values()) == list(range(1, len(mine) + 1))
    assert sum(recall) / 4 >= 0.9


def test_seeds_of_a_common_word_do_not_grow_with_its_square(spark, monkeypatch):
    monkeypatch.setattr(align, "HOT_SEED", 10)
    rng = random.Random(22)
    word = "ACGTTGCAACG"
    texts = ["".join(rng.choice("ACGT") for _ in range(40)) + word + "".join(rng.choice("ACGT") for _ in range(40)) for _ in range(400)]
    own = spark.createDataFrame(list(enumerate([*texts, texts[7]])), "seq_id long, sequence string")
    found = align._seeds(own, own, 11).where("id_a <> id_b")
    assert found.count() < 20 * 401 and found.where("id_a = 7 and id_b = 400").count() > 0


def test_weights_are_counted_once_and_exactly(spark, seqs):
    """The text is made once, however many letters and columns need it, and sums are exact."""
    text = seqs("GGG").select("seq_id", F.regexp_replace("sequence", "[^A-Z]", "").alias("sequence"))
    assert text.select(C.weighted_sum(F.col("sequence"), {"G": 0.1}).alias("w")).first().w == 0.3
    plan = composition.global_protein_properties(text)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 2


def test_windows_of_a_batch_are_made_in_parts(spark, monkeypatch):
    """A task's memory does not grow with the letters of a batch."""
    own = spark.range(40, numPartitions=1).select(F.col("id").alias("seq_id"), F.repeat(F.lit("ACGTTGCA"), 400).alias("sequence"))
    want = sorted(map(tuple, windows.window_cpg(own, 20).collect()))
    largest = []
    monkeypatch.setattr(windows, "LETTERS", 10_000)
    monkeypatch.setattr(type(own), "mapInArrow", lambda self, run, schema: largest.append([b.num_rows for b in run(iter(self.toArrow().to_batches()))]))
    windows.window_cpg(own, 20)
    assert sum(largest[0]) == len(want) == 40 * 3181 and max(largest[0]) <= 4 * 3200


def test_words_of_every_place(spark):
    """Words are those of slicing, over the edges of the pieces too."""
    texts = ["", "A", "ACGTACGTACG", "ACGTTGCAAA" * 30, "é\n€" * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for k in (1, 11, 70):
        found = {r.t: r.w for r in rows.select("t", chunks.words_at(F.col("t"), k).alias("w")).collect()}
        assert found == {t: [t[i : i + k] for i in range(len(t) - k + 1)] for t in texts}


def test_scores_side_by_side_are_those_of_alignments():
    rng, scores = random.Random(5), align.substitution()
    text = lambda n: "".join(rng.choice("ACGTn~é") for _ in range(rng.randint(0, n)))
    pairs = [(text(40), text(300)) for _ in range(200)]
    assert align.local_scores(pairs, scores).tolist() == [align.align(a, b, scores, True)[0] for a, b in pairs]


def test_search_shuffles_only_words_of_the_queries(spark, monkeypatch):
    """Pairs are the same whether few or many queries are searched, and few queries' words go to the targets."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(12)]
    every = spark.createDataFrame([(k, texts[k % 12] if k < 24 else texts[k % 12][:30] + texts[k % 7]) for k in range(60)], "seq_id long, sequence string")
    queries = every.where("seq_id < 12")
    few = align.candidate_pairs(queries, every)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "strategy=broadcast" in plan
    found, best = sorted(map(tuple, few.collect())), sorted(map(tuple, align.search_similar(queries, every, top=3).collect()))
    monkeypatch.setattr(align, "SMALL_ROWS", 0)
    assert found == sorted(map(tuple, align.candidate_pairs(queries, every).collect()))
    slow = {}
    for a, b, _ in found:
        x, y = texts[a], texts[b % 12] if b < 24 else texts[b % 12][:30] + texts[b % 7]
        slow.setdefault(a, []).append((-align.align(x, y, align.substitution(), True)[0], b))
    assert sorted((r[0], r[1], r[3]) for r in best) == sorted((a, b, -s) for a, v in slow.items() for s, b in sorted(v)[:3])


def test_seeds_are_looked_up_before_they_are_counted(spark, monkeypatch):
    monkeypatch.setattr(align, "SEED_LENGTHS", (1,))
    own = spark.createDataFrame([(1, "ACGTTGCAAACCGT"), (2, "ACGTTGCAAACCGTA"), (3, "T" * 40)], "seq_id long, sequence string")
    seeds = align._seeds(own.where("seq_id = 1"), own, 11)
    assert "LeftSemi" in seeds._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id_b, r.at_a, r.at_b) for r in seeds.collect()) == [(b, k, k) for b in (1, 2) for k in range(4)]


def test_crowded_cells_are_shared_out(spark, monkeypatch):
    """F12, F14, F17, F26 of round 3: one cell's pairs go to several tasks, and edges stay those of all pairs."""
    monkeypatch.setattr(structure, "BLOCK", 20, raising=False)
    monkeypatch.setattr(structure, "TASK_PAIRS", 1000, raising=False)
    own = spark.range(120).selectExpr("'s' AS structure_id", "CAST(id AS INT) AS idx", "1.0D + id % 5 AS x", "1.0D + id % 7 AS y", "1.0D + id % 3 AS z")
    edges = structure.radius_edges(own, 8.0)
    a, b = (own.select("structure_id", F.col("idx").alias(i), *[F.col(c).alias(f"{i}_{c}") for c in "xyz"]) for i in ("src", "dst"))
    every = a.join(b, "structure_id").where("src <> dst").selectExpr("src", "dst", "sqrt(pow(src_x - dst_x, 2) + pow(src_y - dst_y, 2) + pow(src_z - dst_z, 2)) AS d").where("d > 0 AND d < 8")
    assert sorted((r.src, r.dst) for r in edges.collect()) == sorted((r.src, r.dst) for r in every.collect())
    assert edges.select(F.spark_partition_id()).distinct().count() > 1
    features = structure.edge_features(structure.residue_edges(own, 2.5, 4, vectors=True), own).collect()
    joined = structure.edge_features(structure.residue_edges(own, 2.5, 4), own).collect()
    assert sorted(tuple(map(str, r)) for r in features) == sorted(tuple(map(str, r)) for r in joined)
