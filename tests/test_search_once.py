"""The exact search: each pair is scored once, along diagonals, also in pieces."""

import random

from strandlake.operators import align


def _text(n, letters="ACGT"):
    return "".join(random.choices(letters, k=n))


def test_scores_by_diagonals_and_pieces(monkeypatch):
    """a long text goes in pieces, which no alignment with gaps may lose letters at."""
    random.seed(4)
    monkeypatch.setattr(align, "PIECE", 50)
    for kind in ("nucleotide", "protein"):
        scores, pairs = align.substitution(kind), []
        for _ in range(60):
            a = _text(random.randrange(1, 60))
            gapped = list(a)
            for _ in range(len(a) // 6):
                gapped.insert(random.randrange(len(gapped)), random.choice("ACGT"))
            pairs.append((a, _text(random.randrange(300)) + "".join(gapped) + _text(random.randrange(300))))
        pairs += [(_text(300, "ACGTNé"), _text(700, "acgté")), (_text(400), _text(20)), ("", "A"), ("", "")]
        assert align.local_scores(pairs, scores).tolist() == [align.align(a, b, scores, True)[0] for a, b in pairs]


def test_pairs_are_scored_once(spark):
    """F1: the aligned pairs were joined with themselves, which scored all pairs twice."""
    random.seed(5)
    seqs = spark.createDataFrame([(n, _text(60)) for n in range(20)], "seq_id long, sequence string")
    plan = align.search_similar(seqs, seqs, k=3, top=5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow score(") == 1


def test_places_of_words_are_those_of_joins(spark, monkeypatch):
    """words are looked up in one reading of the targets; places as by joins, over the edges of chunks too."""
    random.seed(6)
    monkeypatch.setattr(align, "LOOKED_UP", 700)
    monkeypatch.setattr(align.chunks, "CHUNK", 64)
    monkeypatch.setattr(align, "HOT_SEED", 5)
    texts = [_text(random.randrange(200), "ACGTé€") for _ in range(60)] + [None, "", "acgt" * 40]
    texts += [t[:50] + "ACGTACGTACG" * 3 + t[20:] for t in texts[:30]]
    every = spark.createDataFrame(list(enumerate(texts)), "seq_id long, sequence string").repartition(3)
    asked = every.where("seq_id % 7 = 0 or seq_id > 85")
    found = sorted(map(tuple, align._seeds(asked, every, 4).collect()))
    assert len({r[4] for r in found}) == 3 and found == sorted(map(tuple, align._joined_seeds(asked, every, 4).collect()))


def test_seeded_search_reads_its_targets_once(spark):
    """the targets were read and cut into words for each length of seeds, for counts and for places."""
    random.seed(7)
    read = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(n, _text(60)) for n in range(30)], "seq_id long, sequence string").repartition(2)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    targets = rows.mapInArrow(seen, "seq_id long, sequence string")
    assert align.search_seeded(rows.where("seq_id < 5"), targets, k=5).collect()
    assert read.value == 30
