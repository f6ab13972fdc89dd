"""Reading frames from the turns between starts and stops, over ranges of any size."""

import contextlib
import io
import random

import pytest

from strandlake.operators import orfs


def _plain(seq):
    """Spans (frame, first start, stop) of the forward frames."""
    for f in range(3):
        first = None
        for at in range(f, len(seq) - 2, 3):
            codon = seq[at : at + 3]
            if codon == "ATG" and first is None:
                first = at
            elif codon in orfs.STOPS:
                if first is not None:
                    yield f, first, at
                first = None


@pytest.mark.parametrize("span", [6, 15, 1 << 20])
def test_ranges_never_change_frames(spark, monkeypatch, span):
    draw = random.Random(span)
    seqs = {k: "".join(draw.choice(["ATG", "TAA", "TGA", "GCC", "ATG", "A"]) for _ in range(draw.randint(0, 40))) for k in range(25)}
    monkeypatch.setattr(orfs, "RANGE", span)
    found = orfs._open_frames(spark.createDataFrame(list(seqs.items()), "seq_id long, sequence string"), "+")
    assert sorted((r.seq_id, r.f, r["first"], r["last"]) for r in found.collect()) == sorted((k, *s) for k, q in seqs.items() for s in _plain(q))


def test_codons_are_dealt_out_once_and_not_joined(spark):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        orfs._open_frames(spark.createDataFrame([(1, "ATGGCCTAA")], "seq_id long, sequence string"), "+").explain()
    assert "Join" not in text.getvalue() and "Aggregate" not in text.getvalue()
