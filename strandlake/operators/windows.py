"""Sliding-window profiles: one value for each start of a full window.

A sequence is cut into chunks with a halo of a window; nothing else of it is needed together, so a long sequence is
many small rows and nothing is shuffled. Letters of a chunk become whole numbers, which are added up once from its
beginning on: a window's sum is the difference of two of those, so its width costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import refdata
from strandlake.operators import chunks

#: Letters whose windows are made side by side; a batch of more is gone through in parts. Never changes a result.
LETTERS = 200_000

#: Fractions of a residue scale are kept as whole numbers of this part, which sums of them add up exactly.
PART = 10_000


def _windows(seqs: DataFrame, width: int, value: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(seq_id, pos, value): value(codes) gives those of all windows of a chunk's letters, as character codes. seqs are
    sequences (seq_id, sequence) or chunks of them."""
    own = chunks.with_halo(seqs.withColumn("sequence", F.upper("sequence")), chunks.CHUNK, width - 1)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = np.cumsum(pc.utf8_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)) // LETTERS
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), batch.num_rows]
            yield from (batch.slice(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            # a chunk ends with letters that no window covers, so all chunks of a part are one text
            texts, starts = batch.column(2).to_pylist(), batch.column(1).to_numpy()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            if len(codes) < width:
                continue
            ends = np.cumsum(sizes)
            row = np.repeat(np.arange(len(texts)), sizes)
            at = np.arange(len(codes)) - (ends - sizes)[row]
            full = np.flatnonzero(at[: len(codes) - width + 1] + width <= sizes[row[: len(codes) - width + 1]])
            values = value(np.minimum(codes, 127))[full]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[full])), pa.array((starts[row[full]] + at[full]).astype(np.int32)), pa.array(values, pa.float64())], names=["seq_id", "pos", "value"])

    rows = own.where(F.length("sequence") >= width).select("seq_id", F.col("start").cast("long").alias("start"), "sequence")
    return rows.mapInArrow(run, f"seq_id {seqs.schema['seq_id'].dataType.simpleString()}, pos int, value double")


def _sums(numbers: np.ndarray, width: int) -> np.ndarray:
    """Sums of width numbers from each place on that has so many."""
    total = np.concatenate([[0], np.cumsum(numbers, dtype=np.int64)])
    return total[width:] - total[:-width]


def _is(codes: np.ndarray, letters: str) -> np.ndarray:
    return np.isin(codes, [ord(c) for c in letters])


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is."""
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _skew(width: int, more: str, less: str) -> Callable[[np.ndarray], np.ndarray]:
    def value(codes: np.ndarray) -> np.ndarray:
        a, b = _sums(_is(codes, more), width), _sums(_is(codes, less), width)
        return _share(a - b, a + b)

    return value


def window_gc(seqs: DataFrame, width: int) -> DataFrame:
    return _windows(seqs, width, lambda codes: 100.0 * _sums(_is(codes, "GC"), width) / width)


def window_at_skew(seqs: DataFrame, width: int) -> DataFrame:
    return _windows(seqs, width, _skew(width, "A", "T"))


def window_gc_skew(seqs: DataFrame, width: int) -> DataFrame:
    return _windows(seqs, width, _skew(width, "G", "C"))


def distinct_words(codes: np.ndarray, k: int, width: int) -> np.ndarray:
    """How many different words of k letters each window of width letters has.

    A window counts those of its places whose word does not come again within it: each place counts for one run of
    windows, so the runs' ends are added up."""
    places, inside = len(codes) - k + 1, width - k
    out = np.zeros(len(codes) - width + 2, np.int64)
    if inside < 0:
        return out[:-1]
    word = sum(codes[i : i + places].astype(np.int64) << (7 * (k - 1 - i)) for i in range(k))
    order = np.argsort(word, kind="stable")
    again = np.full(places, np.iinfo(np.int64).max)
    same = word[order][1:] == word[order][:-1]
    again[order[:-1][same]] = order[1:][same]
    place = np.arange(places)
    first, last = np.maximum(place - inside, 0), np.minimum(np.minimum(place, again - inside - 1), len(codes) - width)
    held = last >= first
    np.add.at(out, first[held], 1)
    np.add.at(out, last[held] + 1, -1)
    return np.cumsum(out)[:-1]


def window_complexity(seqs: DataFrame, width: int) -> DataFrame:
    """Distinct words of one, two and three letters in the window over its width."""
    return _windows(seqs, width, lambda codes: sum(distinct_words(codes, k, width) for k in (1, 2, 3)) / width)


def window_cpg(seqs: DataFrame, width: int) -> DataFrame:
    """Observed CG pairs over C * G / width; 0 where none is expected."""

    def value(codes: np.ndarray) -> np.ndarray:
        c, g = _is(codes, "C"), _is(codes, "G")
        pairs = _sums(c[:-1] & g[1:], width - 1) if width > 1 else np.zeros(len(codes), np.int64)
        return _share(pairs[: len(codes) - width + 1], _sums(c, width) * _sums(g, width) / width)

    return _windows(seqs, width, value)


def window_scale(seqs: DataFrame, width: int, scale: str, unknown: float) -> DataFrame:
    """Mean of a residue scale (hydropathy, charge, mass, flexibility)."""
    numbers = np.full(128, round(unknown * PART), np.int64)
    for letter, v in refdata.residue_scales()[scale].items():
        numbers[ord(letter)] = round(v * PART)
    return _windows(seqs, width, lambda codes: _sums(numbers[codes], width) / (PART * width))


def window_hydrophobicity(seqs: DataFrame, width: int) -> DataFrame:
    return window_scale(seqs, width, "hydropathy", 0.0)


def window_charge(seqs: DataFrame, width: int) -> DataFrame:
    return window_scale(seqs, width, "charge", 0.0)


def window_residue_mass(seqs: DataFrame, width: int) -> DataFrame:
    return window_scale(seqs, width, "mass", 110.0)


def window_flexibility(seqs: DataFrame, width: int) -> DataFrame:
    return window_scale(seqs, width, "flexibility", 0.4)


def window_summary(series: DataFrame) -> DataFrame:
    return series.groupBy("seq_id").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))
