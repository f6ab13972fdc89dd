"""SimHash near-duplicate groups by pigeonhole blocks.

Equal fingerprints are merged first, so exact copies never pair up. A fingerprint has four 16-bit
blocks; two that differ in at most two bits agree in at least two blocks, so distinct fingerprints
are joined on each of the six pairs of blocks (32-bit keys) and their Hamming distance is verified.

A key that many distinct fingerprints share would give all pairs of its group. There every member
is listed under itself and its 32 one-bit changes outside the two blocks: two members are within two
bits exactly if they meet in such a point, and all that meet in one are within two bits of each other,
so linking each to the smallest loses no connection and takes 33 rows a member.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.storage import shared_dir
from strandlake.llm.common import masked, slices, small_or_shuffled, stored, tokens_of

#: Fingerprints link at this many differing bits or fewer. The exact way for hot blocks relies on it.
MAX_DISTANCE = 2
#: Distinct fingerprints under one block key up to which pairs are compared directly.
DIRECT_GROUP = 64
SEED = 42

_BLOCK_PAIRS = list(combinations(range(4), 2))
_BLOCK = 0xFFFF


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    words = tokens_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    n, digest = len(words) - shingle + 1, xxhash.xxh64_intdigest
    if n <= 1:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        spans = zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", into: str = "fp") -> DataFrame:
    """docs plus the fingerprint of the column text (null text: no words, 0)."""
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.LongType())])
    names = schema.names

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            found = [fingerprint(t, shingle) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=names)

    return docs.mapInArrow(add, schema)


def _key(fp: Column, number: int) -> Column:
    """The two blocks of a block pair, with the pair's number above them."""
    i, j = _BLOCK_PAIRS[number]
    block = lambda k: F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(_BLOCK))
    return F.shiftleft(F.lit(number).cast("long"), 32) + F.shiftleft(block(i), 16) + block(j)


def _points(fp: Column, key: Column) -> Column:
    """The fingerprint and its one-bit changes outside the key's two blocks."""

    def of(number: int) -> Column:
        free = [b for k in range(4) if k not in _BLOCK_PAIRS[number] for b in range(16 * k, 16 * k + 16)]
        masks = [0, *((1 << b) - (1 << 64) * (b == 63) for b in free)]
        return F.array(*[fp.bitwiseXOR(F.lit(m).cast("long")) for m in masks])

    number = F.shiftright(key, 32)
    return reduce(lambda rest, k: F.when(number == k, of(k)).otherwise(rest), range(1, 6), of(0))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: enough links between fingerprints fp within two bits to connect all that are linked."""
    keyed = distinct.select("fp", F.explode(F.array(*[_key(F.col("fp"), k) for k in range(6)])).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(keyed.join(sizes, "key"))
    cold = shared.where(F.col("n") <= DIRECT_GROUP).select("key", "fp")
    pairs = cold.select("key", F.col("fp").alias("a")).join(cold.select("key", F.col("fp").alias("b")), "key")
    close = pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_DISTANCE))
    hot = shared.where(F.col("n") > DIRECT_GROUP).select("fp", "key", F.explode(_points(F.col("fp"), F.col("key"))).alias("point"))
    smallest = hot.groupBy("key", "point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = hot.join(smallest, ["key", "point"]).where(F.col("fp") > F.col("a"))
    return close.select("a", "b").union(stars.select("a", F.col("fp").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the edges (a, b), for every node of an edge.

    Rounds of taking the neighbours' smallest label and then the label's own label, so chains
    shorten by half or more a round; each round's labels are checkpointed in the shared folder.
    """
    shared_dir(edges.sparkSession)
    once = stored(edges.select("a", "b"))
    both = once.union(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")).checkpoint()
    while True:
        heard = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = nearer.join(above, "label").select("node", "was", F.least("label", "above").alias("label")).checkpoint()
        changed = new.where("label <> was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def near_duplicate_groups(prints: DataFrame) -> DataFrame:
    """(fp, component_id) from rows (doc_id, fp): the smallest doc_id among all rows whose fingerprints
    are reachable over links of two differing bits or fewer. Null doc_ids never are the smallest; a
    component of only such has null."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(distinct))
    rooted = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = rooted.groupBy("label").agg(F.min("first").alias("component_id"))
    return rooted.join(smallest, "label").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    Null and empty texts have fingerprint 0 and are one group like any other; rows repeated are
    repeated; an empty table gives an empty one; other columns of docs are ignored.
    """
    prints = stored(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"))
    return prints.join(near_duplicate_groups(prints), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs with one row of each near-duplicate group, that of the smallest doc_id (null last).

    All columns are kept, whatever their names; of rows equal in doc_id any one stays.
    """
    own, place, back = masked(docs)
    kept = stored(fingerprints(own, shingle, place["text"]).withColumn("row", F.monotonically_increasing_id()))
    prints = kept.select(F.col(place["doc_id"]).alias("doc_id"), "fp", "row")
    rows = prints.join(near_duplicate_groups(prints), "fp")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = rows.groupBy("fp", "component_id").agg(F.min(order).alias("best")).groupBy("component_id").agg(F.min("best").alias("best"))
    ours = first.select(F.col("component_id").alias("component"), F.col("best.row").alias("first"))
    extra = rows.join(ours, rows.component_id.eqNullSafe(ours.component), "left").where(F.col("first").isNull() | (F.col("row") != F.col("first")))
    return back(kept.join(small_or_shuffled(extra.select("row")), "row", "left_anti"))
