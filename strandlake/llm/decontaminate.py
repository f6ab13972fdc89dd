"""Benchmark decontamination over a distributed positional inverted index.

The index is a stored table of segments (some megabytes of text each). A segment lists, for every
benchmark term in it, its postings (document, position) in order. A phrase is looked up in a segment
from its rarest term: that term's postings, shifted by the term's offset, are the candidate starts,
and each further list, next rarest first, keeps the candidates that it meets. Most phrases end at the
first term that the segment lacks. Segments are searched in parallel; no posting is shuffled. Terms are
compared as words, never as hashes.

Phrases are searched in blocks of bounded size. A block is broadcast to a pass over the index, whose
matches are stored before the broadcast is dropped and the next block taken, so any number of
benchmark items works. The benchmark's vocabulary is broadcast for indexing up to MAX_TERMS terms; beyond
that every word is indexed and nothing is broadcast. Both only change what the work costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import masked, slices, small_or_shuffled, stored, words_of

WINDOW = 13
#: Distinct phrases of one pass over the index, and terms of a broadcast vocabulary.
BLOCK_PHRASES = 100_000
MAX_TERMS = 300_000
#: Bytes of text of a segment of the index (a document is never cut).
SEGMENT_BYTES = 5_000_000
#: A document is contaminated if at least this share of its words is hit.
MIN_SHARE = 20


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item string, phrase binary): every run of `window` words of an item, or all its words
    if it has fewer; items without words have none. Null item ids count as the empty string."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1_000_000):
            items, phrases = [], []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                for at in range(max(1, len(words) - window + 1) if words else 0):
                    items.append(item or "")
                    phrases.append(b" ".join(words[at : at + window]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(phrases, pa.binary())], names=["item", "phrase"])

    own = benchmark.select(F.col("item_id").cast("string"), "text")
    return own.mapInArrow(cut, "item string, phrase binary").distinct()


def build_index(docs: DataFrame, vocabulary: list[bytes] | None) -> DataFrame:
    """The stored positional index of docs (doc_id, text): one row a segment, with its documents
    (doc_ids, n_words) and the postings (at: index into doc_ids, position) of terms[i] from
    first[i] up to first[i + 1]. Without a vocabulary all words are indexed."""
    of_id = T.ArrayType(docs.schema["doc_id"].dataType)
    schema = T.StructType([
        T.StructField("segment", T.LongType()), T.StructField("doc_ids", of_id), T.StructField("n_words", T.ArrayType(T.IntegerType())),
        T.StructField("terms", T.ArrayType(T.BinaryType())), T.StructField("first", T.ArrayType(T.IntegerType())),
        T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("position", T.ArrayType(T.IntegerType())),
    ])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None

    def row(values, kind):
        values = values if isinstance(values, pa.Array) else pa.array(values, kind)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        known = {w: i for i, w in enumerate(shared.value)} if shared is not None else None
        for batch in slices(batches, 1, SEGMENT_BYTES):
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            n = np.fromiter(map(len, words), np.int64, len(words))
            total = int(n.sum())
            if known is not None:
                names = shared.value
                ids = np.fromiter(map(known.get, chain.from_iterable(words), repeat(-1)), np.int64, total)
            else:
                own: dict[bytes, int] = {}
                ids = np.fromiter((own.setdefault(w, len(own)) for w in chain.from_iterable(words)), np.int64, total)
                names = list(own)
            del words
            held = np.flatnonzero(ids >= 0)
            doc = np.repeat(np.arange(len(n)), n)[held]
            position = held - np.repeat(np.cumsum(n) - n, n)[held]
            order = np.argsort(ids[held], kind="stable")
            terms, first = np.unique(ids[held][order], return_index=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), row(batch.column(0), None), row(n, pa.int32()), row([names[i] for i in terms.tolist()], pa.binary()),
                    row([*first, len(order)], pa.int32()), row(doc[order], pa.int32()), row(position[order], pa.int32()),
                ],
                schema=pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(batch.schema.field(0).type)), ("n_words", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary())), *((k, pa.list_(pa.int32())) for k in ("first", "at", "position"))]),
            )
            number += 1

    return stored(docs.select("doc_id", "text").mapInArrow(index, schema))


def _occurrences(lists: list[np.ndarray], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places, as keys (document << 32) + position, at which a phrase stands in order with slop
    other words or fewer put in between, from the postings of its terms. Each has one place of the rarest term."""
    order = np.argsort([len(x) for x in lists], kind="stable").tolist()
    j = order[0]
    at = lists[j]
    for m in order[1:]:
        if not len(at):
            break
        lowest = at + (m - j) - (slop if m < j else 0)
        from_ = np.maximum(lowest, at & ~np.int64(0xFFFFFFFF))  # of the same document
        found = np.searchsorted(lists[m], from_)
        at = at[(found < len(lists[m])) & (lists[m][np.minimum(found, len(lists[m]) - 1)] <= lowest + slop)]
    left, right = at, at
    if slop and len(at):
        for m in range(j + 1, len(lists)):
            found = np.searchsorted(lists[m], right + 1)
            right = np.where(found < len(lists[m]), lists[m][np.minimum(found, len(lists[m]) - 1)], np.int64(1) << 62)
        for m in range(j - 1, -1, -1):
            found = np.searchsorted(lists[m], left) - 1
            left = np.where(found >= 0, lists[m][np.maximum(found, 0)], np.int64(-1) << 62)
        fits = right - left < len(lists) + slop
        return left[fits], right[fits]
    return left - j, right + (len(lists) - 1 - j)


def find_phrases(index: DataFrame, phrases: list[tuple[int, list[bytes]]], slop: int = 0) -> DataFrame:
    """(segment, at, starts, ends, phrase_ids, near_ids), stored: for each document with a match, the merged
    word intervals that exact matches cover, the ids of the phrases found exactly, and the ids of those that
    stand in order with slop other words or fewer put in between (exact ones included).

    phrases holds (phrase id, words) and is broadcast until the matches are stored: give it in blocks."""
    number: dict[bytes, int] = {}
    flat = np.array([number.setdefault(w, len(number)) for _, p in phrases for w in p], np.int64)
    sizes = np.array([len(p) for _, p in phrases], np.int64)
    names = np.array([i for i, _ in phrases], np.int64)
    shared = index.sparkSession.sparkContext.broadcast((list(number), flat, sizes, names, np.cumsum(sizes) - sizes))
    lists = ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("phrase_ids", pa.list_(pa.int64())), ("near_ids", pa.list_(pa.int64()))
    out = pa.schema([("segment", pa.int64()), ("at", pa.int32()), *lists])

    def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
        starts, ends = [], []
        for a, b in sorted(spans):
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
        return starts, ends

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat, sizes, names, begin = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                segment = batch.column(0)[i].as_py()
                terms = {w: k for k, w in enumerate(batch.column(1)[i].values.to_pylist())}
                first, at, position = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (2, 3, 4))
                hits: dict[int, tuple[list, set, set]] = {}
                if terms and len(flat):
                    place = np.fromiter(map(terms.get, words, repeat(-1)), np.int64, len(words))[flat]
                    keys = (at.astype(np.int64) << 32) + position
                    for k in np.flatnonzero(np.minimum.reduceat(place, begin) >= 0):
                        own = place[begin[k] : begin[k] + sizes[k]].tolist()
                        for left, right in zip(*(x.tolist() for x in _occurrences([keys[first[t] : first[t + 1]] for t in own], slop)), strict=True):
                            spans, exact, near = hits.setdefault(left >> 32, ([], set(), set()))
                            near.add(int(names[k]))
                            if right - left == sizes[k] - 1:
                                spans.append((left & 0xFFFFFFFF, (right & 0xFFFFFFFF) + 1))
                                exact.add(int(names[k]))
                docs = sorted(hits)
                cover = [merged(hits[d][0]) for d in docs]
                yield pa.RecordBatch.from_pydict(
                    {"segment": [segment] * len(docs), "at": docs, "starts": [c[0] for c in cover], "ends": [c[1] for c in cover], "phrase_ids": [sorted(hits[d][1]) for d in docs], "near_ids": [sorted(hits[d][2]) for d in docs]}, schema=out
                )

    kinds = "segment long, at int, starts array<int>, ends array<int>, phrase_ids array<long>, near_ids array<long>"
    found = stored(index.select("segment", "terms", "first", "at", "position").mapInArrow(search, kinds))
    shared.unpersist()
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(doc_id, n_words, n_hit, items, near_items, contaminated) for every row of docs.

    n_hit counts the words inside any occurrence of a benchmark window; items are the sorted ids of
    items with an occurring window, near_items (array<string> like them) those of items of which a window stands in
    order with slop other words or fewer put in between; contaminated: n_hit > 0 and MIN_SHARE * n_hit >= n_words. Null
    and empty texts have no words and are clean; repeated rows are judged each on its own; long texts are searched
    whole; an empty benchmark hits nothing; other columns are ignored.
    """
    windows = stored(benchmark_windows(benchmark, window))
    phrases = stored(windows.select(F.col("phrase").cast("string").alias("phrase")).distinct().withColumn("phrase_id", F.monotonically_increasing_id()))
    of_item = stored(windows.select("item", F.col("phrase").cast("string").alias("phrase")).join(phrases, "phrase").select("phrase_id", "item"))
    words = phrases.select(F.explode(F.split("phrase", " ")).alias("word")).distinct()
    found = words.limit(MAX_TERMS + 1).collect()
    index = build_index(docs, [r.word.encode() for r in found] if len(found) <= MAX_TERMS else None)

    blocks = max(1, -(-phrases.count() // BLOCK_PHRASES))
    hits = None
    for b in range(blocks):
        rows = phrases.where(F.pmod(F.xxhash64("phrase_id"), F.lit(blocks)) == b).collect()
        part = find_phrases(index, [(r.phrase_id, [w.encode() for w in r.phrase.split(" ")]) for r in rows], slop)
        hits = part if hits is None else hits.union(part)

    every = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("at", "d")).select("segment", "at", "d.doc_ids", "d.n_words")
    key = ["segment", "at"]
    spans = hits.select(*key, F.explode(F.arrays_zip("starts", "ends")).alias("s")).select(*key, "s.starts", "s.ends")
    before = F.max("ends").over(Window.partitionBy(*key).orderBy("starts", "ends").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("_new", F.greatest(F.lit(0), F.col("ends") - F.greatest("starts", F.coalesce(before, F.lit(0)))))
    counts = covered.groupBy(*key).agg(F.sum("_new").alias("n_hit"))
    # near ids hold the exact ones
    named = hits.select(*key, "phrase_ids", F.explode("near_ids").alias("phrase_id")).select(*key, "phrase_id", F.array_contains("phrase_ids", F.col("phrase_id")).alias("exact")).join(of_item, "phrase_id")
    items = named.groupBy(*key).agg(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item")))).alias("items"), F.sort_array(F.collect_set("item")).alias("near_items"))
    joined = every.join(items.join(counts, key, "left"), key, "left")
    n_words, n_hit = F.col("n_words").cast("long"), F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return joined.select(
        F.col("doc_ids").alias("doc_id"), n_words.alias("n_words"), n_hit.alias("n_hit"), listed("items"), listed("near_items"),
        ((n_hit > 0) & (MIN_SHARE * n_hit >= n_words)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all columns whatever their names, without the contaminated rows; see contamination."""
    own, place, back = masked(docs)
    kept = stored(own.withColumn("row", F.monotonically_increasing_id()))
    found = contamination(kept.select(F.col("row").alias("doc_id"), F.col(place["text"]).alias("text")), benchmark, window)
    return back(kept.join(small_or_shuffled(found.where("contaminated").select(F.col("doc_id").alias("row"))), "row", "left_anti"))
