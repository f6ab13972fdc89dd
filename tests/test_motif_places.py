"""Places at which motifs of fixed length are looked for, and hits that overlap."""

import random
import re

from strandlake.operators import chunks, patterns

MOTIFS = [("stop", "TGA"), ("TATA", "TATA"), ("repeat", "AA"), ("same", "ATA")]
OPPOSITE = str.maketrans("ACGT", "TGCA")


def test_motif_hits_need_no_more_letters_than_the_longest_motif(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(i, "".join(draw.choices("AAAATTCG", k=n))) for i, n in enumerate([0, 1, 2, 3, 40, 4096, 4098, 9000, 300, 7])]
    want = set()
    for i, s in rows:
        for name, motif in MOTIFS:
            want |= {(i, name, "+", m.start(), m[0]) for m in re.finditer(motif, s)}
            want |= {(i, name, "-", len(s) - m.end(), m[0]) for m in re.finditer(motif, s[::-1].translate(OPPOSITE))}
    letters, plain = [], chunks.positioned_words
    monkeypatch.setattr(chunks, "positioned_words", lambda seqs, k, pad=None: letters.append(k) or plain(seqs, k, pad))
    seqs, motifs = spark.createDataFrame(rows, "seq_id long, sequence string"), patterns.motif_table(spark, MOTIFS)
    for most in (64, 0):
        monkeypatch.setattr(patterns, "ASKED_WORDS", most)
        got = [tuple(r) for r in patterns.find_motifs(seqs, motifs).collect()]
        assert len(got) == len(want) and set(got) == want
    assert set(letters) == {4}
