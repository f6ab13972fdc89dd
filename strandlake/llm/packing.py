"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Lengths, not documents, are packed: a histogram over at most ``capacity`` lengths is solved on the
driver (its size never depends on the corpus), which gives patterns such as ``(1500, 400, 148) x 37``.
Pieces then take their slots by their rank within their length, a distributed numbering in which a
length that a third of all pieces share is counted by (length, input partition).

The solver indexes single lengths, pairs and triples by their sums. For each length, largest first, it
looks up what fills the gap to the last token and consumes the combination as often as the
availability counts allow; what has no complement is packed best-fit. Where that needs more sequences
than the tokens do, combinations of the smallest pieces are undone, a growing share of them, and packed
best-fit with the rest.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm.common import slices, small_or_shuffled, stored

CAPACITY = 2048
#: Shares of the exact combinations that are undone, one after the other, while sequences could be saved.
UNDO = [1 / 64, 1 / 32, 1 / 16, *(k / 8 for k in range(1, 8))]
#: Words remembered by one Python worker; when full it starts anew. Never changes a result.
WORD_CACHE = 400_000

# The normaliser and splitter of a tokenizer file under which texts of these characters can be cut
# at white space and tokenised part by part. Texts of other characters, texts with one of the tokenizer's own
# tokens, and all texts under any other file go through the tokenizer whole.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
_PLAIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Parts(dict):
    """Token ids, as bytes, of one pre-token."""

    def __init__(self, tokenizer):
        super().__init__()
        self._model, self._letters = tokenizer.model, _byte_letters()

    def __missing__(self, part: str) -> bytes:
        shown = "".join(map(self._letters.__getitem__, part.encode()))
        ids = np.array([t.id for t in self._model.tokenize(shown)], "<u4").tobytes()
        if len(self) >= WORD_CACHE:
            self.clear()
        self[part] = ids
        return ids


class _Words(dict):
    """Token ids, as bytes, of one word between white space."""

    def __init__(self, tokenizer):
        super().__init__()
        self.parts = _Parts(tokenizer)

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(map(self.parts.__getitem__, _PARTS.findall(word)))
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = ids
        return ids


class TextTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes; equal to the tokenizer's own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.tokenizer)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self._by_parts = all(told.get(k) == v for k, v in _RULES.items()) and told["model"]["type"] == "BPE" and not told["model"].get("dropout")
        self._own = [t["content"] for t in told.get("added_tokens") or []]

    def forget(self) -> None:
        self.words.clear()
        self.words.parts.clear()

    def __call__(self, text: str) -> bytes:
        if self._by_parts and _PLAIN.fullmatch(text) and not any(t in text for t in self._own):
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_loaded: dict[str, TextTokenizer] = {}


def _tokenizer(path: str) -> TextTokenizer:
    if path not in _loaded:
        _loaded[path] = TextTokenizer(path)
    return _loaded[path]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, numbered: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids binary): the token ids of every whole text, then end_id, cut
    at multiples of capacity only; numbered: with part and rank as pack_pieces would add them.

    Null text counts as empty and gives one piece, the end id. Null or repeated doc_ids are kept, a
    row each. Other columns of docs are ignored. An empty table gives an empty one.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    names = list(schema.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, end = _tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in slices(batches, 1):
            row, piece, start, length, ids = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                all_ids = tokenize(text or "") + end
                for k, at in enumerate(range(0, len(all_ids), step)):
                    part = all_ids[at : at + step]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    ids.append(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                names=names,
            )
        tokenize.forget()  # the worker lives on

    if not numbered:
        return docs.select("doc_id", "text").mapInArrow(cut, schema)
    ranked = T.StructType([*schema.fields, *_RANKED])
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _ranked(cut(batches), 3, capacity), ranked)


class SumIndex:
    """Single lengths, pairs and triples by their sums, over availability counts that only ever fall.

    Pairs are sorted by sum, those of the largest length first; of each sum the first pair that may still be
    available is kept. A triple is a length and a sum of a pair; of each sum the largest such length is kept."""

    def __init__(self, left: np.ndarray):
        self.left, capacity = left, len(left) - 1
        there = np.flatnonzero(left)
        a, b = (v.ravel() for v in np.meshgrid(there, there, indexing="ij"))
        fits = (a >= b) & (a + b < capacity)
        a, b = a[fits], b[fits]
        order = np.lexsort((-a, a + b))
        bounds = np.searchsorted((a + b)[order], np.arange(capacity + 1)).tolist()
        self._large, self._small = a[order].tolist(), b[order].tolist()
        self._pair, self._last_pair = bounds[:-1], bounds[1:]
        self._triple = list(range(-1, capacity - 1))

    def _has(self, length: int, taken: list[int], more: int = 1) -> bool:
        return bool(self.left[length] >= taken.count(length) + more)

    def pair(self, total: int, taken: list[int]) -> list[int] | None:
        if total < 2:
            return None
        for k in range(self._pair[total], self._last_pair[total]):
            a, b = self._large[k], self._small[k]
            if self._has(a, taken, 1 + (a == b)) and self._has(b, taken):
                return [a, b]
            if k == self._pair[total] and not (self._has(a, [], 1 + (a == b)) and self._has(b, [])):
                self._pair[total] += 1
        return None

    def triple(self, total: int, taken: list[int]) -> list[int] | None:
        for a in range(self._triple[total], 0, -1):
            rest = total - a
            if self._has(a, taken) and (two := self.pair(rest, [*taken, a])):
                return [a, *two]
            if a == self._triple[total] and not (self.left[a] and self._pair[rest] < self._last_pair[rest]):
                self._triple[total] -= 1
        return None

    def complement(self, gap: int, taken: list[int]) -> list[int] | None:
        """Up to three available lengths, besides those taken, that fill the gap exactly."""
        if gap == 0:
            return []
        return [gap] if self._has(gap, taken) else self.pair(gap, taken) or self.triple(gap, taken)


def _consume(left: np.ndarray, lengths: list[int], patterns: Counter) -> None:
    """Uses the combination as often as the counts allow."""
    uses = Counter(lengths)
    times = min(int(left[x]) // k for x, k in uses.items())
    for x, k in uses.items():
        left[x] -= k * times
    patterns[tuple(lengths)] += times


def _best_fit(left: np.ndarray) -> Counter:
    """Patterns of all of left: the largest length, then each time the largest that fits."""
    patterns: Counter = Counter()
    for length in range(len(left) - 1, 0, -1):
        while left[length]:
            lengths, gap = [length], len(left) - 1 - length
            left[length] -= 1
            while gap and len(fits := np.flatnonzero(left[: gap + 1])):
                lengths.append(int(fits[-1]))
                left[fits[-1]] -= 1
                gap -= int(fits[-1])
            for x in lengths:
                left[x] += 1
            _consume(left, lengths, patterns)
    return patterns


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of one sequence, number of such sequences)] using up the whole histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    least = -(-int((left * np.arange(capacity + 1)).sum()) // capacity)
    exact: Counter = Counter()
    residue, index = np.zeros_like(left), SumIndex(left)
    for length in range(capacity, 0, -1):
        while left[length]:
            found = index.complement(capacity - length, [length])
            if found is None:
                residue[length], left[length] = left[length], 0
            else:
                _consume(left, [length, *found], exact)
    best = exact + _best_fit(residue.copy())
    undoable = sorted((p for p in exact if len(p) > 1), key=lambda p: (min(p), p))
    for share in UNDO:
        if best.total() <= least:
            break
        kept, pool, quota = Counter(exact), residue.copy(), int(share * exact.total())
        for p in undoable:
            times = min(quota, kept[p])
            quota -= times
            kept[p] -= times
            for x in p:
                pool[x] += times
        mended = kept + _best_fit(pool)
        best = min(best, mended, key=Counter.total)
    return list(best.items())


_RANKED = [T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())]


def _ranked(batches: Iterator[pa.RecordBatch], length_at: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """batches plus part, the number of the partition, and rank, counted from 0 within it and a length."""
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for batch in batches:
        length = batch.column(length_at).to_numpy()
        order = np.argsort(length, kind="stable")
        sizes = np.bincount(length, minlength=capacity + 1)
        rank = np.empty(len(length), np.int64)
        rank[order] = np.arange(len(length)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rank += seen[length]
        seen += sizes
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(length), pa.int32()), pa.array(rank)], names=[*batch.schema.names, *[f.name for f in _RANKED]])


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, numbered: bool = False) -> DataFrame:
    """pieces (with a column length, 1 to capacity) plus sequence_id and offset, whatever else they hold.

    Stores the pieces once; equal lengths are interchangeable, so ties need no order. An empty table
    gives an empty one. numbered: the last two columns are part and rank, which do not come back.
    """
    if not numbered:
        at = pieces.columns.index("length")
        schema = T.StructType([*pieces.schema.fields, *_RANKED])
        pieces = pieces.mapInArrow(lambda batches: _ranked(batches, at, capacity), schema)
    own = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(pieces.schema.fields[:-2])]
    names, columns = pieces.columns[:-2], [f.name for f in own]
    length = columns[names.index("length")]
    kept = stored(pieces.toDF(*columns, "part", "rank"))
    counts = kept.groupBy(length, "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(length).orderBy("part")) - F.col("n")).drop("n")
    histogram = {int(r[0]): int(r.n) for r in kept.groupBy(length).agg(F.count("*").alias("n")).collect()}

    keys, first, base, offset = [], [], [], []
    used: Counter = Counter()
    sequences = 0
    for lengths, times in plan_patterns(histogram, capacity):
        at = 0
        for x in lengths:
            keys.append((x << 44) + used[x])
            first.append(used[x])
            base.append(sequences)
            offset.append(at)
            used[x] += times
            at += x
        sequences += times
    order = np.argsort(np.array(keys, np.int64))
    slots = tuple(np.array(v, np.int64)[order] for v in (keys, first, base, offset))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, first, base, offset = slots
        rank = rank.to_numpy()
        at = np.searchsorted(keys, (length.to_numpy() << 44) + rank, side="right") - 1
        return pd.DataFrame({"sequence_id": base[at] + rank - first[at], "offset": offset[at]})

    placed = kept.join(small_or_shuffled(before), [length, "part"]).withColumn("at", slot(length, F.col("rank") + F.col("before")))
    return placed.select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)], "at.sequence_id", "at.offset")


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) for all documents; see tokenize_pieces."""
    return pack_pieces(tokenize_pieces(docs, tokenizer_path, capacity, end_id, numbered=True), capacity, numbered=True)
