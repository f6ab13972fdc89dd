"""The registered queries over the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import chat, decontaminate, divergence, fim, langid, licenses, lm_scoring, media, packing, pii, quality, simhash, toxicity
from strandlake.llm.common import read_table


#: Words that may be put into a benchmark window for a proximity match.
NEAR_SLOP = 1


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), slop=NEAR_SLOP)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near_items"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(read_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(read_table(spark, sf_dir, "documents"), tokenizer_path(), numbered=True)
    digests = pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
    return packing.pack_pieces(digests, numbered=True)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_scan(read_table(spark, sf_dir, "documents"))
    place = lambda k: F.try_element_at("places", F.lit(k)).cast("long")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), place(1).alias("first_word"), place(-1).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents")).drop("languages")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read_table(spark, sf_dir, "documents"), with_media=False)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(read_table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.filter("base_spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.digest(F.col("base_spans")), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(read_table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(read_table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def queries() -> dict:
    found = globals()
    return {k: f for k, f in found.items() if k.startswith("op") and k[2].isdigit()}


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
     b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS_SQL} AS w FROM benchmark),
     p AS (SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS phrase
           FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
     x AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS phrase
           FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM p))),
     m AS (SELECT doc_id, i, x.k, item FROM x JOIN p ON x.phrase = p.phrase AND x.k = p.k),
     s AS (SELECT DISTINCT k, phrase, k // 2 AS h, string_split(phrase, ' ') AS q FROM p WHERE k > 1),
     y AS (SELECT doc_id, k, k // 2 AS h, w[i : i + k] AS v FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 1)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM p WHERE k > 1))),
     c AS (SELECT doc_id, v, y.k, phrase FROM y JOIN s ON y.k = s.k AND array_to_string(v[1 : y.h], ' ') = array_to_string(q[1 : s.h], ' ')
           UNION ALL SELECT doc_id, v, y.k, phrase FROM y JOIN s ON y.k = s.k AND array_to_string(v[y.h + 2 : y.k + 1], ' ') = array_to_string(q[s.h + 1 : s.k], ' ')),
     o AS (SELECT DISTINCT doc_id, item FROM c JOIN p USING (phrase, k) WHERE len(list_filter(range(1, k), lambda g: array_to_string(v[1 : g] || v[g + 2 : k + 1], ' ') = phrase)) > 0),
     e AS (SELECT doc_id, count(*) AS n_near FROM (SELECT doc_id, item FROM m UNION SELECT doc_id, item FROM o) GROUP BY doc_id),
     h AS (SELECT doc_id, count(DISTINCT at_word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS at_word FROM m) GROUP BY doc_id),
     t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near_items
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id
"""

_TERMS_SQL = _WORDS_SQL.replace(r"\x00-\x2F\x3A-\x60", r"\x00-\x40\x5B-\x60")

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS_SQL} AS w FROM documents),
     x AS (SELECT r, lang, source, unnest(w) AS term FROM d),
     k AS (SELECT lang, term, count(*) AS c FROM x GROUP BY ALL HAVING count(DISTINCT r) >= 3),
     v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
     c AS (SELECT lang, source, term, count(*) AS c FROM x JOIN k USING (lang, term) GROUP BY ALL),
     n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
     g AS (SELECT d.lang, d.source, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN n ON n.lang = d.lang AND n.source = d.source),
     p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 1) // (g.n + v.v) AS p,
                  1 + CAST(1000000000 AS HUGEINT) * (k.c + 1) // (v.n + v.v) AS q
           FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
     s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
           FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     e AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT e.lang, e.source, e.item, coalesce(s.value, 0) AS value FROM e LEFT JOIN s ON s.lang = e.lang AND s.source = e.source AND s.item = e.item)
UNION ALL
SELECT * FROM (
    SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value,
           CAST(row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) AS INTEGER) AS rank
    FROM p WHERE c > 0 AND p > q) WHERE rank <= 200
"""

_CHARS_SQL = {k: f"length(regexp_replace(t, '{p.replace("'", "''")}', '', 'g'))" for k, p in quality.CLASSES.items()}
_CLASSES_SQL = ", ".join(f"length(t) - {c}" for c in _CHARS_SQL.values())
_JS_SQL = "sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0))"
_FAR_SQL = "coalesce({} > {} + {} / sqrt(n_words), false)"

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     x AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
     y AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i FROM x QUALIFY count(*) OVER (PARTITION BY r, s) > 1), range(0, 8) u(j) GROUP BY r),
     l AS (SELECT r, count(*) - count(DISTINCT s) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS s FROM d) WHERE regexp_matches(s, '[^\\x20\\x09-\\x0D]') GROUP BY r),
     b AS (SELECT d.r, doc_id, lang, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - {_CHARS_SQL["symbol"]} AS n_symbols,
                  coalesce(l.n, 0) AS n_dup_lines, coalesce(y.n, 0) AS n_repeat_words, length(t) AS chars, [{_CLASSES_SQL}] AS h
           FROM d LEFT JOIN l ON l.r = d.r LEFT JOIN y ON y.r = d.r),
     m AS (SELECT lang, word, count(*) AS c FROM (SELECT lang, unnest(w) AS word FROM d WHERE len(w) >= {quality.MIN_WORDS}) GROUP BY ALL),
     o AS (SELECT lang, word, c, row_number() OVER (PARTITION BY lang ORDER BY c DESC, word) AS k FROM m QUALIFY k <= {quality.COMMON_WORDS}),
     z AS (SELECT r, word, count(*) AS c FROM (SELECT r, unnest(w) AS word FROM d WHERE len(w) >= {quality.MIN_WORDS}) GROUP BY ALL),
     by_word AS (SELECT r, {_JS_SQL} AS distance FROM (
                   SELECT r, o.k AS place, coalesce(z.c, 0) / b.n_words AS p, o.c / a.c AS q FROM b JOIN o ON o.lang = b.lang JOIN (SELECT lang, sum(c) AS c FROM m GROUP BY lang) a ON a.lang = b.lang
                          LEFT JOIN z USING (r, word) WHERE b.n_words >= {quality.MIN_WORDS}
                   UNION ALL
                   SELECT r, 0 AS place, 1 - sum(coalesce(z.c, 0)) / b.n_words AS p, 1 - sum(o.c) / a.c AS q FROM b JOIN o ON o.lang = b.lang JOIN (SELECT lang, sum(c) AS c FROM m GROUP BY lang) a ON a.lang = b.lang
                          LEFT JOIN z USING (r, word) WHERE b.n_words >= {quality.MIN_WORDS} GROUP BY r, b.n_words, a.c) GROUP BY r),
     u AS (SELECT r, lang, n_words, chars, unnest(h || [chars - list_sum(h)]) AS c, unnest(range(0, {len(quality.CLASSES) + 1})) AS k FROM b WHERE n_words >= {quality.MIN_WORDS}),
     e AS (SELECT lang, k, sum(c * 1000000 // chars) AS c FROM u GROUP BY ALL HAVING count(*) >= {quality.MIN_REFERENCE}),
     by_class AS (SELECT r, {_JS_SQL} AS distance FROM (
                   SELECT r, u.c / u.chars AS p, e.c / sum(e.c) OVER (PARTITION BY r) AS q FROM u JOIN e ON e.lang = u.lang AND e.k = u.k) GROUP BY r),
     j AS (SELECT b.*, n_words < {quality.MIN_BASE_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed, s.distance AS class_distance, CASE WHEN s.r IS NOT NULL THEN v.distance END AS word_distance
           FROM b LEFT JOIN by_class s ON s.r = b.r LEFT JOIN by_word v ON v.r = b.r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT (base_failed OR {_FAR_SQL.format("class_distance", *quality.CLASS_LIMIT)} OR {_FAR_SQL.format("word_distance", *quality.WORD_LIMIT)}) AS kept
FROM j
"""

_UNIT_SQL = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_H_SQL = ", ".join(f"('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))

OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_UNIT_SQL}') AS u, {_H_SQL} FROM documents),
     c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi FROM d),
     p AS (SELECT doc_id, t, n, array_to_string(u[1 : lo], '') AS a, array_to_string(u[lo + 1 : hi], '') AS m, array_to_string(u[hi + 1 : n], '') AS z,
                  CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= {fim.RATE} THEN 'plain' WHEN h4 % 100 < {fim.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || m ELSE '<P>' || a || '<S>' || z || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are held against brute force in the tests."""
    return {"op1_benchmark_decontamination": OP1_SQL, "op11_source_divergence": OP11_SQL, "op12_quality_rules": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
