"""Generic spans are found by format, not by the credential word alone."""

import random
import time

from pyspark.sql import functions as F

from strandlake.llm import pii


def spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans] for r in pii.personal_data(docs).collect()}


def test_small_table(spark):
    found = spans(spark, ["please call (555) 123-4567 soon", "account 12345678 is hers", "password=a8f3k2m9q1x7", "in 2024-01-15 it was 1200.50 long", "they said 2023-05-17 was it"])
    assert found == {0: ["(555) 123-4567"], 1: ["12345678"], 2: ["a8f3k2m9q1x7"], 3: [], 4: []}


def test_format_is_learned_without_the_word(spark):
    rng = random.Random(9)
    phone = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    texts = [f"phone {phone()} today" for _ in range(150)] + [f"on {rng.randrange(1900, 2020)}-10-{rng.randrange(10, 28)} in town" for _ in range(150)] + [f"reach them at {phone()} again" for _ in range(5)]
    found = spans(spark, texts)
    assert all(len(found[i]) == 1 for i in [*range(150), *range(300, 305)]) and not any(found[i] for i in range(150, 300))


def test_many_candidates_in_one_text(spark):
    """Work grows with the number of candidates, not with its square."""
    rng = random.Random(3)
    numbers = [f"+{rng.randrange(10**9, 10**10)}" if k % 50 == 0 else f"{rng.randrange(10**6, 10**9)}" for k in range(60_000)]
    docs = spark.createDataFrame([(1, "; ".join(numbers))], "doc_id long, text string")
    began = time.time()
    row = pii.personal_data(docs).first()
    assert len(row.base_spans) == 1200
    text = pii.redact(docs).first().text
    assert text.count("[PHONE]") == 1200
    assert time.time() - began < 120


def test_trees_learn_from_all_candidates(spark, monkeypatch):
    """F8: more different candidates than a sample would have taken; each counts once, in whatever row it is."""
    texts = spark.range(24_000).selectExpr("id AS row", "concat('no ', 1000000 + 37 * id, ' of them') AS text")
    found = pii.with_evidence(pii.with_features(pii.candidates(texts)))
    learned, fit = [], pii.GBTClassifier.fit
    monkeypatch.setattr(pii.GBTClassifier, "fit", lambda self, df: learned.append(df.agg(F.sum("weight")).first()[0]) or fit(self, df))
    pii.fit(found)
    keys = found.where("kind IN ('number', 'secret')").select(F.xxhash64("value", "before", "after").alias("key")).union(pii.with_features(pii.local_table(spark, pii._prior(), "kind string, value string, label double").withColumns({"before": F.lit(" "), "after": F.lit(" ")})).select(F.xxhash64("value")))
    assert learned == [keys.where("pmod(key, 2) = 0").count()]
