"""Source divergence, quality rules and fill-in-the-middle on awkward tables, against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import divergence, fim, lm_scoring, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = ["n", "w", "h0", "term", "count", "place", "part", "rank", "value", "lines", "left0", "classes", "at", "hashes", "output", "form", "c.1"]


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "ré", "ß", "In", "日"]) for _ in range(rng.randrange(1, 4)))
    prose = [" ".join(word() for _ in range(rng.randrange(1, 160))) + rng.choice([".", "!\n", ""]) for _ in range(60)]
    return [
        None, "", " \n\t ", "x", "...", " wide space\x00zero", "<P>marked", "a<S", "a <M> b", prose[0], prose[0], *prose, "word " * 30_000, "one two three four five six seven eight nine\n" * 9,
        "1 2 3 4 5 6 7 8 9 " + "1 2 3 4 5 6 7 8", "line\nline\n\n\nline \n line", "".join(f"w{k} " for k in range(40_000)), "### $$$ && |x| " * 30,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], [f"s{i % 4}", None][i % 7 == 6]) for i, t in enumerate(texts())]
    rows += [(5, "repeated row", "en", "s"), (5, "repeated row", "en", "s"), (None, "a null id", None, None), (900, "...", "xx", "a"), (901, None, "xx", "b")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(7) for c in CLASHING}).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text", "lang", "source").collect()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def slow_divergence(rows, top=200):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    count, docs_with = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for r in rows:
        own = terms(r.text)
        count[r.lang or "", r.source or ""].update(own)
        docs_with[r.lang or ""].update(set(own))
    out = set()
    for lang in {k[0] for k in count}:
        kept = sorted(t for t, n in docs_with[lang].items() if n >= 3)
        groups = {s: {t: c[t] for t in kept} for (l, s), c in count.items() if l == lang}
        share = lambda c, total: {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}
        p = {s: share(c, sum(c.values())) for s, c in groups.items()}
        every = {t: sum(c[t] for c in groups.values()) for t in kept}
        q = share(every, sum(every.values()))
        price = lambda a, b: (a - b) ** 2 // b
        ranked = lambda found: sorted(found, key=lambda x: (-x[1], x[0].encode()))
        for s in groups:
            pairs = ranked([(o, sum(price(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s])
            alone = ranked([(t, price(p[s][t], q[t])) for t in kept if groups[s][t] and p[s][t] > q[t]])[:top]
            out |= {(lang, s, part, item, value, k + 1) for part, own in (("pair", pairs), ("term", alone)) for k, (item, value) in enumerate(own)}
    return out


@pytest.mark.parametrize("tiles", [(1024, 128), (3, 2)])
def test_source_divergence(docs, rows, empty, tiles, monkeypatch):
    monkeypatch.setattr(divergence, "TILE_TERMS", tiles[0])
    monkeypatch.setattr(divergence, "TILE_GROUPS", tiles[1])
    found = [tuple(r) for r in divergence.source_divergence(docs, top=20).collect()]
    assert len(found) == len(set(found)) and set(found) == slow_divergence(rows, 20)
    assert ("xx", "a", "pair", "b", 0, 1) in found
    assert divergence.source_divergence(empty).collect() == []


def test_source_divergence_of_huge_counts(spark):
    """Shares are exact where a product of counts is beyond 64 bits."""
    rows = [(c, t) for c in (0, 1, 10**10 + 7, 9 * 10**17) for t in (1, 10**12)]
    got = spark.createDataFrame(rows, "c long, t long").select("c", "t", divergence._share(F.col("c"), F.col("t") + 10**18, F.lit(5)).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 1) // (r.t + 10**18 + 5) for r in got)


@pytest.mark.parametrize("groups,terms", [(1, 1), (3, 5), (8, 40), (9, 64), (37, 301)])
def test_quadtree_prices_each_place_once(groups, terms):
    rng = np.random.default_rng(groups)
    held = rng.random((groups, terms)) < 0.1
    held[:, : terms // 4] = rng.random((groups, terms // 4)) < 0.9
    nothing = rng.integers(1, 50, groups)
    p = np.where(held, rng.integers(50, 10**9, (groups, terms)), nothing[:, None])
    want = ((p[:, None] - p[None]) ** 2 // p[None]).sum(axis=2)
    assert (divergence.tile_values(p, nothing, held) == want).all()
    tree, seen = divergence.Quadtree(np.zeros((16, 32), bool), (4, 8)), []
    tree.pairs(2, 0, 0, 0, lambda *x: seen.append(x), None)
    assert seen == [(2, 0, 0, 0)]  # an empty matrix is one price


def slow_quality(rows):
    own = [(r.doc_id, r.lang or "", r.text or "", re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    classes = [r"[a-z]", r"\x20", r"[A-Z]", r"[.,;:!?'\"()-]", r"[#*$%&|<>]", r"[\x09-\x0D]", r"[0-9]", r"[^\x00-\x7F]"]
    hist = lambda t: (lambda c: [*c, len(t) - sum(c)])([len(re.findall(p, t)) for p in classes])
    words, shares, n_docs = collections.defaultdict(collections.Counter), collections.defaultdict(lambda: [0] * 9), collections.Counter()
    for _, lang, t, w in own:
        if len(w) >= 50:
            words[lang].update(w)
            n_docs[lang] += 1
            shares[lang] = [a + c * 1_000_000 // len(t) for a, c in zip(shares[lang], hist(t), strict=True)]

    def js(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
        return math.sqrt(max(0, (kl(p) + kl(q)) / 2))

    out = []
    for i, lang, t, w in own:
        places = collections.defaultdict(list)
        for k in range(len(w) - 7):
            places[tuple(w[k : k + 8])].append(k)
        repeated = len({k + j for v in places.values() if len(v) > 1 for k in v for j in range(8)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 20 or 100 * repeated > 30 * len(w)
        by_class = by_word = None
        if len(w) >= 50 and n_docs[lang] >= 20:
            top = [x for x, _ in sorted(words[lang].items(), key=lambda x: (-x[1], x[0].encode()))[:50]]
            mine, total = collections.Counter(w), sum(words[lang].values())
            by_class = js(hist(t), shares[lang])
            by_word = js([*[mine[x] for x in top], len(w) - sum(mine[x] for x in top)], [*[words[lang][x] for x in top], total - sum(words[lang][x] for x in top)])
        far = by_class is not None and (by_class > 0.13 + 1.5 / math.sqrt(len(w)) or by_word > 0.2 + 2 / math.sqrt(len(w)))
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated, failed, by_class, by_word, not failed and not far))
    return out


def test_quality_rules(spark, docs, rows, empty):
    for table in (docs, spark.createDataFrame([(i, t, "one", None) for i, t in enumerate(texts())], SCHEMA)):
        found = quality.quality_rules(table).collect()
        plain = lambda rs: sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rs)
        assert plain(found) == plain(slow_quality(table.select("doc_id", "text", "lang").collect()))
    assert any(not r.kept and not r.base_failed for r in found) and any(r.kept for r in found)
    assert quality.quality_rules(empty).collect() == []
    plan = quality.quality_rules(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_leaves_short_texts_and_small_languages_alone(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "mill", "river", "stone"]) for _ in range(n))
    shouted = lambda n: " ".join(rng.choice(["THE", "OF", "MILL"]) + "!!" for _ in range(n))
    table = [(i, prose(200), "en", "s") for i in range(60)] + [(100, shouted(200), "en", "s"), (101, shouted(30), "en", "s"), (102, shouted(200), "la", "s")]
    kept = {r.doc_id: r.kept or r.base_failed for r in quality.quality_rules(spark.createDataFrame(table, SCHEMA)).collect()}
    assert [kept[i] for i in (100, 101, 102)] == [False, True, True] and all(kept[i] for i in range(60))


def slow_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    a, m, z = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    return (doc_id, len(units), "spm", len(a), len(m), f"<S>{z}<P>{a}<M>{m}") if h[3] % 100 < 80 else (doc_id, len(units), "psm", len(a), len(m), f"<P>{a}<S>{z}<M>{m}")


def test_fill_in_middle(spark, docs, rows, empty):
    more = spark.createDataFrame([(k, f"<a b>{k} <<S c> d" + " é\x85x" * (k % 9), "en", "s") for k in range(1000, 1200)], SCHEMA)
    made = fim.fill_in_middle(docs.unionByName(more, allowMissingColumns=True)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: tuple(map(str, x))
    every = [*rows, *more.collect()]
    assert sorted((tuple(r)[:6] for r in made), key=key) == sorted((slow_fim(r.doc_id, r.text) for r in every), key=key)
    assert sorted((r.doc_id or -1, r.back) for r in made) == sorted((r.doc_id or -1, r.text or "") for r in every)
    assert {r.form for r in made} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(empty).collect() == []
    assert all(r.form == "plain" for r in fim.fill_in_middle(more, rate=0).collect())


def test_frequent_words_are_those_of_all_rows(spark):
    """more rows than a sample would have taken, the frequent words each in one row alone."""
    rows = [(f"w{k} " * (100 + k) if k < 40 else f"r{k}",) for k in range(10_500)]
    got = lm_scoring.frequent_words(spark.createDataFrame(rows, "text string"), 40)
    assert got == [b"w%d" % k for k in range(39, -1, -1)]


def test_toxicity_learns_from_all_labels(spark, monkeypatch):
    """more labelled rows than a sample would have taken, all different."""
    docs = spark.range(36_000).selectExpr("id AS doc_id", "CASE WHEN id % 900 = 0 THEN concat('you are a grolmik ', id, ' x') ELSE concat('plain words ', id, ' y', id % 7) END AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 900 = 0 AS INT) AS toxic")
    used = docs.where(toxicity.remainder(F.col("doc_id"), 3) != 1)
    learned, choose = [], toxicity.choose_entries
    monkeypatch.setattr(toxicity, "choose_entries", lambda *a: learned.append(a[2:]) or choose(*a))
    model = toxicity.fit(docs, labels)
    assert learned == [tuple(used.where(f"doc_id % 900 {op} 0").count() for op in ("=", "<>"))]
    assert (model.weights >= 0).all() and model.weights.max() > 0
