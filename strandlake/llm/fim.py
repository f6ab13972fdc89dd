"""Fill-in-the-middle: texts cut at unit borders into prefix, middle and suffix, and put in another order.

Units are words with the white space before them. A batch is cut by Arrow kernels alone: the units become
one list array, its values are flattened with the index of the text each belongs to and its ordinal there,
filtered by role (prefix, middle or suffix), rebuilt into lists, and each list is joined again. Which text
is transformed, where it is cut and which order it gets follow from a hash of its doc_id, so every run, every
partitioning and every retry of a task give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import slices

#: A unit, over the bytes of UTF-8: white space is ASCII, so bytes and code points give the same units.
UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A byte that UTF-8 never has.
_CUT = b"\xff"
#: Percent of texts that are transformed, and of those the percent with the suffix first.
RATE, SUFFIX_FIRST = 50, 80


def hashes(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of an id (null: the empty text): the first digits of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substr(digest, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long") for k in range(4)]


def roles(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Units of each text (binary, no nulls), and its prefixes, middles and suffixes, cut after the smaller and the
    larger of first % (n + 1) and second % (n + 1) units."""
    # every unit ends with a cut, so the last piece of a text is always empty and no unit
    units = pc.split_pattern(pc.replace_substring_regex(texts, pattern=UNIT, replacement=rb"\1" + _CUT), pattern=_CUT)
    n = pc.list_value_length(units).to_numpy(zero_copy_only=False).astype(np.int64) - 1
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units).to_numpy()
    starts = np.concatenate([[0], np.cumsum(n + 1)])
    ordinal = np.arange(len(flat)) - starts[parent]
    cuts = np.sort(np.stack([first % (n + 1), second % (n + 1)]), axis=0)
    role = (ordinal >= cuts[0][parent]).astype(np.int8) + (ordinal >= cuts[1][parent])
    parts = []
    for k in range(3):
        own = role == k
        ends = np.concatenate([[0], np.cumsum(np.bincount(parent[own], minlength=len(texts)))])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pc.filter(flat, pa.array(own)))
        parts.append(pc.binary_join(lists, pa.scalar(b"", pa.binary())))
    return n, parts


def _transform(batch: pa.RecordBatch, rate: int, suffix_first: int) -> pa.RecordBatch:
    doc_id, text = batch.column(0), pc.fill_null(batch.column(1), "")
    h = [pc.fill_null(batch.column(2 + k), 0).to_numpy(zero_copy_only=False) for k in range(4)]
    raw = text.cast(pa.binary())
    n, (prefix, middle, suffix) = roles(raw, h[0], h[1])
    marked = pc.match_substring_regex(text, pattern=f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    plain = pc.or_(pc.or_(marked, pc.equal(pc.binary_length(text), 0)), pa.array(h[2] % 100 >= rate))
    spm = pa.array(h[3] % 100 < suffix_first)
    mark = lambda m: pa.scalar(m.encode(), pa.binary())
    in_order = lambda *parts: pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.binary()))
    moved = pc.if_else(spm, in_order(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle), in_order(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle))
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    chars = lambda part: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(part.cast(pa.string())).cast(pa.int64()))
    columns = [doc_id, pa.array(n), form, chars(prefix), chars(middle), pc.if_else(plain, raw, moved).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = 42) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of docs (doc_id, text): units, form
    (plain, spm or psm), code points of prefix and middle (null if plain), and the transformed text.

    Null text counts as empty; an empty text and one that holds a marker stay plain; repeated rows (and equal ids)
    get the same cut positions; a null id counts as the empty text in the hash; an empty table gives an empty one;
    other columns, whatever their names, are ignored; a text of any length is cut whole, a few MB of texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            yield _transform(batch, rate, suffix_first)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(hashes(F.col("doc_id"), seed))])
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that output was made of, from the output and its form alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    piece = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output)
