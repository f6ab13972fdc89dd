"""Near copies by the Jaccard similarity of their word shingles, without a missed pair.

Two sets of n and m shingles that are similar by t or more share one of the first n - ceil(t n) + 1 and
m - ceil(t m) + 1 shingles in any common order of shingles, so equal sets are merged and all others are
joined on those. The order puts shingles last that a bounded sample shows to be frequent, and behind them those that
many sets then turn out to share; it decides how much is compared, never what is found. Every pair that is met
is verified on both whole sets.

Sets are carried to each other only where that can matter. Two sets cannot have more shingles in common than
their counts over BINS hash values allow, which leaves out most unlike pairs; each set is first compared with the
partner of which it meets most shingles, and after that only pairs that are not yet connected are compared.

A shingle that many sets share would give all pairs of its group. There every member is first compared
with a few leaders of the group, which connects most of them. Groups with the same largest component are a family; only
members outside that component are compared with the whole family, block against block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm import simhash
from strandlake.llm.common import discard, masked, slices, small_or_shuffled, stored, tokens_of

SHINGLE, SIMILARITY = 5, 0.8
#: Rows of the sample that tells frequent shingles, and how many of those, and of shared ones, are ordered last.
SAMPLE_ROWS, FREQUENT = 40_000, 500_000
#: Sets under one shingle up to which all pairs are compared, and leaders of a larger group.
DIRECT_GROUP, LEADERS = 32, 4
#: Shingles of a block of sets that is compared with another one.
BLOCK = 200_000
#: Hash values by which a set's shingles are counted.
BINS = 128
LOCAL_WORDS = 100_000
SLICE_BYTES = 1_000_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, size: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of size words; of all words if there are fewer; none without words."""
    words = tokens_of(text)
    if not words:
        return np.zeros(0, np.int64)
    if len(hashes) > LOCAL_WORDS:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), np.uint64)
    for k in range(min(size, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def prefix_length(n: int, similarity: float = SIMILARITY) -> int:
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, their rows) of those in three rows or more of a sample of texts (text)."""
    every = max(1, texts.count() // SAMPLE_ROWS)
    sample = texts.select("text", F.monotonically_increasing_id().alias("at")).where(F.pmod(F.xxhash64("at"), F.lit(every)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in slices(batches, 0, SLICE_BYTES):
            found, n = np.unique(np.concatenate([shingles(t, SHINGLE, hashes) for t in batch.column(0).to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["shingle", "n"])

    counts = sample.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.where("n >= 3").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    found, n = top.column("shingle").to_numpy(), top.column("n").to_numpy()
    order = np.argsort(found)
    return found[order], n[order]


def _ranked(found: np.ndarray, known: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order: by their times (0 if not known), then by hash."""
    rank = np.zeros(len(found), np.int64)
    if len(known):
        place = np.minimum(np.searchsorted(known, found), len(known) - 1)
        rank = np.where(known[place] == found, times[place], 0)
    return found[np.lexsort((found, rank))[: prefix_length(len(found))]]


def with_sets(docs: DataFrame, text: str, shingle: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs plus, of its column text, fp (SimHash of word shingles of the given size), set (the name of the set of
    SHINGLE-word shingles), n (its size), bins (its counts by hash) and prefix (its first shingles in the common order)."""
    common = docs.sparkSession.sparkContext.broadcast(order)
    at = docs.columns.index(text)
    kinds = [("fp", T.LongType()), ("set", T.BinaryType()), ("n", T.LongType()), ("bins", T.ArrayType(T.IntegerType())), ("prefix", T.ArrayType(T.LongType()))]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(k, t) for k, t in kinds]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = common.value
        hashes = _Hashes()
        for batch in slices(batches, at, SLICE_BYTES):
            prints, names, sizes, bins, prefixes = [], [], [], [], []
            for text in batch.column(at).to_pylist():
                found = shingles(text, SHINGLE, hashes)
                prints.append(simhash.fingerprint(text, shingle))
                names.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(len(found))
                bins.append(np.bincount(found & (BINS - 1), minlength=BINS))
                prefixes.append(_ranked(found, known, times))
            ends = np.cumsum([0, *map(len, prefixes)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes)))
            counts = pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1) * BINS, pa.int32()), pa.array(np.concatenate(bins), pa.int32()))
            new = [pa.array(prints, pa.int64()), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), counts, lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return docs.mapInArrow(run, schema)


def _sets_of(texts: DataFrame) -> DataFrame:
    """(row, shingles) of texts (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in slices(batches, 1, SLICE_BYTES):
            found = [shingles(t, SHINGLE, hashes) for t in batch.column(1).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row", "shingles"])

    return texts.mapInArrow(run, "row long, shingles array<long>")


def _shared_last(sets: DataFrame, texts: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """sets with the prefixes that follow if shingles of over DIRECT_GROUP prefixes go to the end of the order.

    A prefix without any of them stays as it is; the others are made anew from the texts."""
    keyed = sets.select("row", F.explode("prefix").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > DIRECT_GROUP).orderBy(F.desc("size"), "key").limit(FREQUENT).toArrow()
    if not crowded.num_rows:
        return sets
    key, size = crowded.column("key").to_numpy(), crowded.column("size").to_numpy()
    known = np.concatenate([order[0], key])
    times = np.concatenate([order[1], (1 << 40) + size])
    by = np.lexsort((times, known))
    last = np.concatenate([known[by][1:] != known[by][:-1], [True]])
    shared = sets.sparkSession.sparkContext.broadcast((known[by][last], times[by][last]))
    schema = "row long, again array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in slices(batches, 1, SLICE_BYTES):
            found = [_ranked(shingles(t, SHINGLE, hashes), *shared.value) for t in batch.column(1).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["row", "again"])

    keys = small_or_shuffled(sets.sparkSession.createDataFrame(crowded.select(["key"])))
    rows = small_or_shuffled(keyed.join(keys, "key", "left_semi").select("row").distinct())
    again = stored(texts.join(rows, "row", "left_semi").select("row", "text").mapInArrow(run, schema))
    return stored(sets.join(again, "row", "left").withColumn("prefix", F.coalesce("again", "prefix")).drop("again"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with the Jaccard similarity of their sets."""
    one = lambda k: sets.select(F.col("row").alias(k), F.col("shingles").alias(f"s{k}"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("similarity"))


def _counts_fit(n_a: Column, n_b: Column, bins_a: Column, bins_b: Column) -> Column:
    """Whether two sets' counts by hash let them be similar."""
    most = F.aggregate(F.zip_with(bins_a, bins_b, lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return most >= SIMILARITY / (1 + SIMILARITY) * (n_a + n_b) - 1e-6


def _sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b) - 1e-9


def _compared(block: pa.Table) -> pa.Table:
    """(a, b) of one block of strays and one of members of a family (row, label, side, shingles) that are similar and of
    different components: the shingles of all members are one sorted list in which each stray's are looked up."""
    row, label, side = (block.column(c).to_numpy() for c in ("row", "label", "side"))
    lists = block.column("shingles").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    of = lambda k: flat[ends[k] : ends[k + 1]]
    strays, members = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a, b = [], []
    if len(strays) and len(members):
        sizes = np.array([ends[k + 1] - ends[k] for k in members])
        every, owner = np.concatenate([of(k) for k in members]), np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        for k in strays:
            own = of(k)
            lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
            times = hi - lo
            place = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(times) else times
            both = np.bincount(owner[place], minlength=len(members))
            near = members[(both >= SIMILARITY * (len(own) + sizes - both) - 1e-9) & (label[members] != label[k])]
            a += [row[k]] * len(near)
            b += row[near].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _links_of_families(family: DataFrame, whole: DataFrame) -> DataFrame:
    """(a, b), a < b: all similar pairs of different components in families (main, row, n, label), of which one lies outside
    the family's largest component (main).

    Strays and members are dealt out in blocks of about BLOCK shingles, and each block of the ones meets each of the
    others in a task of its own: sets travel by block, and no pairs are made but those that are similar."""
    stray = F.col("label") != F.col("main")
    deals = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = family.groupBy("main").agg(deals(F.sum(F.when(stray, F.col("n")).otherwise(0))).alias("stray_blocks"), deals(F.sum("n")).alias("member_blocks"), F.count_if(stray).alias("strays")).where("strays > 0").drop("strays")
    rows = family.join(small_or_shuffled(sizes), "main").join(whole, "row")
    own = lambda blocks: F.pmod(F.xxhash64("row"), F.greatest(F.col(blocks), F.lit(1))).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.greatest(F.col(blocks), F.lit(1)) - 1))
    columns = ["main", "row", "label", "shingles"]
    strays = rows.where(stray).select(*columns, F.lit(0).alias("side"), own("stray_blocks").alias("x"), every("member_blocks").alias("y"))
    members = rows.select(*columns, F.lit(1).alias("side"), every("stray_blocks").alias("x"), own("member_blocks").alias("y"))
    met = strays.union(members).groupBy("main", "x", "y").applyInArrow(_compared, "a long, b long")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b), a < b: enough pairs of rows similar by SIMILARITY or more to connect all that are, from sets
    (row, n, bins, prefix), one row a distinct set, and texts (row, text)."""
    keyed = sets.select("row", "n", F.explode("prefix").alias("key"))
    sizes = small_or_shuffled(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    shared = stored(keyed.join(sizes, "key"))
    one = lambda part, k, *more: part.select("key", *[F.col(c).alias(f"{c}_{k}") for c in ("row", "n", *more)])
    fit = _sizes_fit(F.col("n_a"), F.col("n_b"))
    similar = F.col("similarity") >= SIMILARITY - 1e-9

    few = shared.where(F.col("size") <= DIRECT_GROUP)
    met = one(few, "a").join(one(few, "b"), "key").where(F.col("row_a") < F.col("row_b")).where(fit)
    pairs = stored(met.groupBy(F.col("row_a").alias("a"), F.col("row_b").alias("b")).agg(F.count("*").alias("shared")))
    counts = lambda k: sets.select(F.col("row").alias(k), F.col("n").alias(f"n_{k}"), F.col("bins").alias(f"bins_{k}"))
    like = _counts_fit(F.col("n_a"), F.col("n_b"), F.col("bins_a"), F.col("bins_b"))
    cold = stored(pairs.join(counts("a"), "a").join(counts("b"), "b").where(like).select("a", "b", "shared"))
    discard(pairs)
    partner = F.max_by("other", F.struct("shared", -F.col("other"))).alias("other")
    best = cold.select("a", F.col("b").alias("other"), "shared").union(cold.select("b", "a", "shared")).groupBy("a").agg(partner)
    # of shingles that the same rows share, one is kept
    crowd = shared.where(F.col("size") > DIRECT_GROUP)
    same = crowd.groupBy("key").agg(F.count("*").alias("rows"), F.min("row").alias("first"), F.max("row").alias("last"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("y"))
    hot = stored(crowd.join(small_or_shuffled(same.groupBy("rows", "first", "last", "x", "y").agg(F.min("key").alias("key")).select("key")), "key").select("key", "row", "n"))
    discard(shared)  # both halves of it are stored by now, as pairs and as hot groups
    leader = [F.min_by("row", F.xxhash64("row", F.lit(k))).alias(f"l{k}") for k in range(LEADERS)]
    led = stored(hot.join(small_or_shuffled(hot.groupBy("key").agg(*leader)), "key"))
    stars = led.select(F.col("row").alias("a"), F.explode(F.array(*[f"l{k}" for k in range(LEADERS)])).alias("other")).where("a <> other")
    used = small_or_shuffled(cold.select("a").union(cold.select("b")).union(hot.select("row")).distinct().withColumnRenamed("a", "row"))
    whole = stored(_sets_of(texts.join(used, "row", "left_semi").select("row", "text")))
    ordered = best.union(stars).select(F.least("a", "other").alias("a"), F.greatest("a", "other").alias("b")).distinct()
    first = stored(_verified(ordered, whole))
    linked = first.where(similar).select("a", "b")

    label = stored(simhash.components(linked))
    of = lambda k: label.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}"))
    apart = F.coalesce("label_a", "a") != F.coalesce("label_b", "b")
    rest = cold.join(of("a"), "a", "left").join(of("b"), "b", "left").where(apart).select("a", "b").join(first, ["a", "b"], "left_anti")
    found = linked
    if not hot.isEmpty():
        placed = led.select("key", "row", "n").join(label.withColumnRenamed("node", "row"), "row", "left").withColumn("label", F.coalesce("label", "row"))
        main = placed.groupBy("key", "label").agg(F.count("*").alias("size")).groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
        family = stored(placed.join(small_or_shuffled(main), "key").select("main", "row", "n", "label").distinct())
        found = linked.union(_links_of_families(family, whole))
    return stored(found.union(_verified(stored(rest), whole).where(similar).select("a", "b")).distinct())


def drop_near_copies(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs with one row, that of the smallest doc_id (null last), of each group of near copies.

    Rows are linked if their sets of SHINGLE-word shingles are similar by SIMILARITY or more, or if their
    SimHash fingerprints are within simhash.MAX_DISTANCE bits. All columns are kept, whatever their names; of
    rows equal in doc_id any one stays. Null texts and texts without words are one group.
    """
    own, place, back = masked(docs)
    order = frequent(own.select(F.col(place["text"]).alias("text")))
    kept = stored(with_sets(own, place["text"], shingle, order).withColumn("row", F.monotonically_increasing_id()))
    doc_id = F.col(place["doc_id"])
    classes = stored(kept.groupBy("set", "fp").agg(F.min("row").alias("first"), F.min(F.struct(doc_id.isNull(), doc_id.alias("doc_id"), "row")).alias("best")).withColumnRenamed("first", "row"))
    prints = simhash.components(simhash.links(stored(classes.select("fp").distinct())))
    of_print = classes.join(prints.withColumnRenamed("node", "fp"), "fp", "left").select("row", F.coalesce("label", "fp").alias("of"))

    def stars(members: DataFrame) -> DataFrame:
        least = members.groupBy("of").agg(F.min("row").alias("a"), F.count("*").alias("size")).where("size > 1").drop("size")
        return members.join(least, "of").where("row <> a").select("a", F.col("row").alias("b"))

    sets = classes.groupBy("set").agg(F.min("row").alias("row")).drop("set")
    texts = kept.select("row", F.col(place["text"]).alias("text"))
    first = stored(kept.join(sets, "row", "left_semi").select("row", "n", "bins", "prefix"))
    similar = links(_shared_last(first, texts, order), texts)
    edges = stars(of_print).union(stars(classes.select("row", F.col("set").alias("of")))).union(similar)
    labels = simhash.components(edges.distinct()).withColumnRenamed("node", "row")
    rooted = classes.join(labels, "row", "left").select(F.coalesce("label", "row").alias("label"), "best")
    survivors = rooted.groupBy("label").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    extra = kept.select("row").join(survivors, "row", "left_anti")
    return back(kept.join(small_or_shuffled(extra), "row", "left_anti"))
