"""Every pipeline stage on its own input against brute force, on the smallest tables and planted rows."""

import collections
import os

import numpy as np
import pytest

import corpus_pipeline
from strandlake.llm import queries
from tests.llm.test_nearcopies import similar, slow_set
from tests.llm.test_operators import slow_fingerprint, slow_spans, slow_words

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(name, input rows, output rows)] with planted copies, a benchmark passage and personal data."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    plain = docs.where("length(text) between 300 and 900 and lang = 'en'").orderBy("doc_id").first().text
    planted = [(10_000, plain), (10_001, plain), (10_002, "Before it. " + item + " After it."), (10_003, "Write to jo.do@mail.example.com or +1 (555) 234-5678 soon."), (10_004, None), (10_005, "")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in planted], docs.schema))
    out = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((name, before, docs.collect(), docs.columns))
    return out


def test_stages_keep_the_columns(stages):
    assert [s[0] for s in stages] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]
    assert all(s[3] == ["doc_id", "text", "lang", "source", "n_chars"] for s in stages[:-1])


def test_toxic_rows_go(stages, spark):
    _, before, after, _ = stages[0]
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    clean = [r.doc_id for r in before if label.get(r.doc_id) == 0]
    assert set(clean) <= kept and {10_000, 10_002, 10_003, 10_004, 10_005} <= kept
    assert all(r in before for r in after)


def test_one_of_each_group_stays(stages):
    """Five words and a similarity of 0.8, as the stage's rule says, and the two bits of three-word fingerprints."""
    _, before, after, _ = stages[1]
    own = [(r.doc_id, slow_fingerprint(r.text, 3), slow_set(r.text)) for r in before]
    group = {i: i for i, _, _ in own}
    linked = [(i, j) for i, a, x in own for j, b, y in own if i > j and ((a ^ b).bit_count() <= 2 or similar(x, y))]
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            if group[i] != group[j]:
                group[i] = group[j] = min(group[i], group[j])
                changed = True
    assert {r.doc_id for r in after} == set(group.values())
    assert 10_001 not in {r.doc_id for r in after}


def test_contaminated_rows_go(stages, spark):
    _, before, after, _ = stages[2]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = slow_words(r.text)
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12) if w else 0)}
    want = set()
    for r in before:
        w, hit = slow_words(r.text), set()
        for n in set(map(len, windows)):
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            want.add(r.doc_id)
    assert {r.doc_id for r in after} == want and 10_002 not in want


def test_personal_data_is_replaced(stages):
    _, before, after, _ = stages[3]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    text = {r.doc_id: r.text for r in after}
    for r in before:
        if r.text is None:
            assert text[r.doc_id] is None
            continue
        for kind, a, b in slow_spans(r.text):
            assert kind not in ("email", "card") or r.text[a:b] not in text[r.doc_id]
        if not any(c.isdigit() or c == "@" for c in r.text):
            assert text[r.doc_id] == r.text
    assert text[10_003] == "Write to [EMAIL] or [PHONE] soon."
    assert all(r.n_chars == len(r.text) for r in after if r.text is not None)


def test_sequences_hold_every_token(stages):
    from tokenizers import Tokenizer

    _, before, after, _ = stages[4]
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    parts, room = collections.defaultdict(dict), collections.defaultdict(list)
    for r in after:
        parts[r.doc_id][r.start] = bytes(r.ids)
        room[r.sequence_id].append((r.offset, r.offset + r.length))
    for r in before:
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        assert b"".join(v for _, v in sorted(parts[r.doc_id].items())) == ids
    for spans in room.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))  # noqa: B905


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
