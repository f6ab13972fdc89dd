"""Quality rules by distribution divergence, in DataFrame functions only.

Each document gives two histograms: its characters by class and its words by the most common words of its
language (all others together). Both are compared with references of the language, learned from all documents
that are long enough, by the Jensen-Shannon distance. A short text strays from any reference by chance, so the
limits widen with the square root of its length, and below a minimum length nothing is compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.sizes import broadcast_if_small
from strandlake.llm.common import stored

SPACE = r"\x20\x09-\x0D"
#: Character classes, commonest first: each is taken out of what those before it left.
CLASSES = {  # lower and space come first: measured() takes them out together
    "lower": "[a-z]+", "space": r"\x20+", "upper": "[A-Z]+", "mark": "[.,;:!?'\"()-]+", "symbol": "[#*$%&|<>]+", "break": r"[\x09-\x0D]+",
    "digit": "[0-9]+", "wide": r"[^\x00-\x7F]+",
}
#: Words of a window whose repetition counts: a power of two.
WINDOW = 8
#: Base rule: fewer words, or a larger percentage of words in repeated windows, fails.
MIN_BASE_WORDS, MAX_REPEATED = 20, 30
#: Common words of a language that have a place of their own in the histogram.
COMMON_WORDS = 50
#: Words of a document, and documents of a reference, below which nothing is compared.
MIN_WORDS, MIN_REFERENCE = 50, 20
#: Largest distance by length: (limit of a long text, what is added for one word and falls with the square root).
CLASS_LIMIT, WORD_LIMIT = (0.13, 1.5), (0.20, 2.0)
#: Lists that a language's common words are dealt to by hash, so that a word is compared with about one. Never changes a result.
SLOTS = 256
#: Languages up to which the references are broadcast.
BROADCAST_LANGUAGES = 1000
#: What the classes of one document add up to in the reference, about: every document weighs the same.
_WEIGHT = 1_000_000


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the runs of anything but ASCII white space; null for a text without any (and for null)."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed != "", F.split(trimmed, f"[{SPACE}]+"))


def repeated_words(own: Column, hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the words and the hash of the window from each of them on.

    Windows are sorted by their hash, and those that have an equal one by a second hash too, so equal ones are
    neighbours: no pairs are compared."""
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["g"] == y["g"]), F.lit(False))
    twice = lambda p: F.filter(p, lambda x, k: same(x, F.get(p, k - 1)) | same(x, F.get(p, k + 1)))
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), F.lit(0).alias("g"), i.alias("i"))))
    surer = lambda p: F.sort_array(F.transform(twice(p), lambda x: F.struct(x["h"].alias("h"), F.hash(F.slice(own, x["i"] + 1, WINDOW)).alias("g"), x["i"].alias("i"))))
    starts = _bound(_bound(placed, surer), lambda p: F.sort_array(F.transform(twice(p), lambda x: x["i"])))
    covered = lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _bound(starts, covered)).otherwise(0)


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of the same places that each add up to 1."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.round(F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0))), 9)


def _shares(counts: Column) -> Column:
    return _bound(F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b), lambda n: F.transform(counts, lambda c: c / n))


def word_reference(docs: DataFrame, top: int = COMMON_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """(lang, common, slots, word_counts): hashes of the top words of every language in ascending order, the same dealt to
    SLOTS lists, and their counts with that of all others last; equal counts by word. From documents of min_words or more."""
    # the length is looked at inside the value, as a filter would split every text once more
    long_enough = _bound(words(F.col("text")), lambda w: F.when(F.size(w) >= min_words, w))
    counts = docs.select("lang", F.explode(long_enough).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = stored(counts)
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= top)
    listed = best.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("word").alias("h"), "n"))).alias("t"), F.sum("n").alias("held"))
    own = listed.join(total, "lang").withColumn("common", F.transform("t", lambda x: x["h"]))
    slots = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.filter("common", lambda h: F.pmod(h, F.lit(SLOTS)) == s))
    return own.select("lang", "common", slots.alias("slots"), F.concat(F.transform("t", lambda x: x["n"]), F.array(F.col("total") - F.col("held"))).alias("word_counts"))


def _counted(common: Column, found: Column) -> Column:
    """How often each of common (ascending) is in found, which holds nothing else.

    Sorted together with one of each, equal hashes are runs, and every one of common has a run."""
    last = lambda s: F.filter(F.transform(s, lambda x, i: F.when(~F.coalesce(F.get(s, i + 1) == x, F.lit(False)), i + 1)), lambda e: e.isNotNull())
    ends = _bound(F.sort_array(F.concat(found, common)), last)
    return _bound(ends, lambda e: F.transform(e, lambda x, k: (x - F.coalesce(F.get(e, k - 1), F.lit(0)) - 1).cast("long")))


def measured(docs: DataFrame, reference: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, lang, text) as (doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes,
    word_distance): classes are the counts by CLASSES and of all other characters, word_distance is null for texts
    of fewer than min_words and languages without a reference."""
    # one select a step: what a later one uses twice is not computed twice
    own = docs.select("doc_id", "lang", F.col("text").alias("left0"), words(F.col("text")).alias("w"))
    lines = F.filter(F.split("left0", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    own = own.withColumn("lines", lines).withColumn("n_dup_lines", F.size("lines") - F.size(F.array_distinct("lines"))).drop("lines")
    # letters and the spaces between them go together, as runs of both are far longer than words
    own = own.withColumn("spaces", F.length("left0") - F.length(F.replace("left0", F.lit(" "), F.lit("")))).withColumn("left2", F.regexp_replace("left0", "[a-z\\x20]+", ""))
    for k, pattern in list(enumerate(CLASSES.values()))[2:]:
        own = own.withColumn(f"left{k + 1}", F.regexp_replace(f"left{k}", pattern, ""))
    sizes = [F.length(f"left{k}") for k in (0, *range(2, len(CLASSES) + 1))]
    taken = [a - b for a, b in zip(sizes, sizes[1:], strict=False)]
    classes = F.array(*[c.cast("long") for c in (taken[0] - F.col("spaces"), F.col("spaces"), *taken[1:], sizes[-1])])
    own = own.select("doc_id", "lang", "w", "n_dup_lines", classes.alias("classes"))

    n = F.coalesce(F.size("w"), F.lit(0))
    own = own.withColumn("one", F.transform("w", lambda x: F.xxhash64(x))).join(broadcast_if_small(reference, BROADCAST_LANGUAGES), "lang", "left")
    # a window's hash from those of its halves, theirs from those of theirs; texts that repeat fewer pairs than a window
    # holds repeat no window
    pairs = lambda c, step: F.zip_with(c, F.slice(c, step + 1, F.greatest(n - step, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    own = own.withColumn("hashes", F.when(n > WINDOW, F.slice(pairs("one", 1), 1, n - 1)))
    own = own.withColumn("hashes", F.when(F.size("hashes") - F.size(F.array_distinct("hashes")) >= WINDOW - 1, F.col("hashes")))
    step = 2
    while step < WINDOW:
        own, step = own.withColumn("hashes", pairs("hashes", step)), 2 * step
    own = own.withColumn("hashes", F.slice("hashes", 1, n - (WINDOW - 1)))
    at = F.filter("one", lambda h: F.array_contains(F.get("slots", F.pmod(h, F.lit(SLOTS)).cast("int")), h))
    own = own.withColumn("at", F.when((n >= min_words) & F.col("common").isNotNull(), at))
    counts = F.concat(_counted(F.col("common"), F.col("at")), F.array((n - F.size("at")).cast("long")))
    own = own.withColumn("counts", F.when(F.col("at").isNotNull(), counts))
    return own.select(
        "doc_id", "lang", n.cast("long").alias("n_words"), F.coalesce(F.length(F.array_join("w", "")), F.lit(0)).cast("long").alias("word_chars"), F.col("classes")[list(CLASSES).index("symbol")].alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"), F.coalesce(F.when(F.col("hashes").isNotNull(), repeated_words(F.col("w"), F.col("hashes"))), F.lit(0)).cast("long").alias("n_repeat_words"),
        "classes", F.when(F.col("counts").isNotNull(), _distance(_shares(F.col("counts")), _shares(F.col("word_counts")))).alias("word_distance"),
    )


def class_reference(rows: DataFrame, min_words: int = MIN_WORDS, min_docs: int = MIN_REFERENCE) -> DataFrame:
    """(lang, class_counts) of measured rows: the mean share of each class, every document weighing the same; only of
    languages with min_docs documents of min_words or more."""
    total = F.aggregate("classes", F.lit(0).cast("long"), lambda a, b: a + b)
    own = rows.where(F.col("n_words") >= min_words).select("lang", "classes", total.alias("total"))
    share = [F.sum(F.call_function("div", F.col("classes")[k] * _WEIGHT, F.col("total"))) for k in range(len(CLASSES) + 1)]
    return own.groupBy("lang").agg(F.count("*").alias("docs"), F.array(*share).alias("class_counts")).where(F.col("docs") >= min_docs).select("lang", "class_counts")


def quality_rules(docs: DataFrame, min_words: int = MIN_WORDS, min_docs: int = MIN_REFERENCE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance,
    kept) for every row of docs (doc_id, text, lang).

    Null text counts as empty (no words: base_failed); null lang is a language of its own; repeated rows are judged
    each; an empty table gives an empty one; other columns, whatever their names, are ignored; long texts are
    measured whole. Distances are null, and do not count, where text or reference is below its minimum.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = docs.select("doc_id", text("lang"), text("text"))
    rows = stored(measured(own, stored(word_reference(own, min_words=min_words)), min_words))
    compared = rows.join(broadcast_if_small(stored(class_reference(rows, min_words, min_docs)), BROADCAST_LANGUAGES), "lang", "left")
    long_enough = F.col("class_counts").isNotNull() & (F.col("n_words") >= min_words)
    by_class = F.when(long_enough, _distance(_shares(F.col("classes")), _shares(F.col("class_counts"))))
    by_word = F.when(long_enough, F.col("word_distance"))
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    judged = compared.withColumns({"class_distance": by_class, "word_distance": by_word, "base_failed": failed})
    far = lambda c, limit: F.coalesce(F.col(c) > limit[0] + limit[1] / F.sqrt("n_words"), F.lit(False))
    kept = ~(F.col("base_failed") | far("class_distance", CLASS_LIMIT) | far("word_distance", WORD_LIMIT))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", kept.alias("kept"))
