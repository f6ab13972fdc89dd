"""Near copies by five-word shingles against all pairs."""

import random

import pytest

import corpus_pipeline
from strandlake.llm import nearcopies
from strandlake.llm.common import tokens_of
from tests.llm.test_operators import SCHEMA, slow_fingerprint


def slow_set(text):
    w = tokens_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return not a | b or len(a & b) / len(a | b) >= 0.8


def edited(words, times, rng):
    w = list(words)
    for _ in range(times):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return w


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    prose = [[f"w{rng.randrange(400)}" for _ in range(n)] for n in (9, 40, 120, 300, 150)]
    out = [None, "", " \n", "one", "one", "one two three four", "one two three five", " ".join(prose[1] * 2)]
    for w in prose:
        out += [" ".join(edited(w, rng.randrange(1 + len(w) // 30), rng)) for _ in range(14)]
    # One passage that many long rows share and a chain of copies of copies.
    out += [" ".join(prose[4] + [f"u{i}x{k}" for k in range(rng.randrange(60))]) for i in range(20)]
    chain = prose[2]
    for _ in range(8):
        chain = edited(chain, 1, rng)
        out.append(" ".join(chain))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("direct", [2, 64])
def test_stage_links_all_similar_pairs(spark, texts, monkeypatch, direct):
    monkeypatch.setattr(nearcopies, "DIRECT_GROUP", direct)
    sets, prints = [slow_set(t) for t in texts], [slow_fingerprint(t, 3) for t in texts]
    label = list(range(len(texts)))
    changed, edits = True, 0
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                by_print = (prints[i] ^ prints[j]).bit_count() <= 2
                if (similar(sets[i], sets[j]) or by_print) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed, edits = True, edits + (not by_print)
    assert edits > 10
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))


def test_empty_and_prefixes(spark):
    assert nearcopies.drop_near_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    for n in range(1, 60):
        for m in range(1, n + 1):
            need = next((k for k in range(m + 1) if k / (n + m - k) >= 0.8), None)
            if need is not None:
                assert nearcopies.prefix_length(n) >= n - need + 1 and nearcopies.prefix_length(m) >= m - need + 1
