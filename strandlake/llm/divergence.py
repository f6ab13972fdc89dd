"""How far the sources of a language differ in their terms: every pair of sources, and the terms that stand out.

Terms are counted per group (lang, source) with a share of a thousand million each, every group giving each
kept term one count more than it has. A language's matrix of groups by terms is mostly zeros. Spark cuts it
into tiles of terms (and of groups, where there are many); in a tile a K-squared quadtree holds the places
that are not zero. Pairs of rows of nodes go down the tree together: where both nodes are all zero, all their
terms have one price for a pair of groups, which is multiplied by the width; where a leaf is reached, its few
places are priced one by one. Prices add up over the tiles of a pair. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import small_or_shuffled, stored

#: Documents of a language that a term must stand in to be kept.
MIN_DOCS = 3
#: What all shares of a group add up to, about.
SCALE = 1_000_000_000
#: Terms (about) and groups of a tile. Never change a result.
TILE_TERMS, TILE_GROUPS = 1024, 128
#: Rows of a quadtree's leaf; columns come in the same proportion as in the whole tile.
LEAF_ROWS = 8
#: Counted terms that a task holds before it hands them on.
HELD_TERMS = 100_000

#: Byte map for terms ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``: A-Z to a-z, separators to a space.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of ASCII letters and non-ASCII characters; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, count, docs) of batches (lang, source, text): summed up before they are shuffled. Every
    group also gives a row for itself, its name after a space as the term (terms have no space)."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in held.items():
            terms = list(counts)
            columns = [pa.array([lang] * (len(terms) + 1)), pa.array([source] * (len(terms) + 1)), pa.array([f" {source}", *[t.decode("utf-8", "replace") for t in terms]], pa.string()), pa.array([0, *counts.values()], pa.int64()), pa.array([0, *[docs[t] for t in terms]], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "count", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        langs, sources = (batch.column(k).to_pylist() for k in (0, 1))
        for k, text in enumerate(batch.column(2)):
            counts, docs = held[langs[k], sources[k]]
            before, own = len(counts), Counter(terms_of(text.as_py()))
            counts.update(own)
            docs.update(own.keys())
            size += len(counts) - before
            if size > HELD_TERMS:
                yield from rows()
                size = 0
    yield from rows()


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for counts of any size."""
    exact = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.lit(1).cast("long") + F.call_function("div", exact(F.lit(SCALE), 10) * exact(count + 1, 19), exact(total + terms, 20))


def matrix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, groups) of docs (text, lang, source): cells (lang, source, term, count, lang_count) of kept terms, and
    groups (lang, source, total, lang_total, terms) of every group that occurs; both stored."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_counted, "lang string, source string, term string, count long, docs long")
    # dealt by language and term, so that the sums over sources need no further shuffle
    by_group = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    own, is_group = Window.partitionBy("lang", "term"), F.col("term").startswith(" ")
    every = stored(by_group.withColumns({"lang_count": F.sum("count").over(own), "lang_docs": F.sum("docs").over(own)}).where(is_group | (F.col("lang_docs") >= MIN_DOCS)).select("lang", "source", "term", "count", "lang_count"))
    cells = every.where(~is_group)
    totals = every.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    langs = cells.groupBy("lang").agg(F.sum("count").alias("lang_total"), F.count_distinct("term").alias("terms"))
    groups = totals.join(langs, "lang", "left").select("lang", "source", "total", F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("total"), "source")) - 1
    return cells, stored(groups.withColumn("place", place))


def term_divergence(cells: DataFrame, groups: DataFrame, top: int = 200) -> DataFrame:
    """(lang, source, item, value, rank): of each group the top terms whose share is above the language's."""
    sized = cells.join(small_or_shuffled(groups.select("lang", "source", "total", "lang_total", "terms")), ["lang", "source"])
    p, q = _share(F.col("count"), F.col("total"), F.col("terms")), _share(F.col("lang_count"), F.col("lang_total"), F.col("terms"))
    above = sized.where("count > 0").select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    valued = above.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return valued.withColumn("rank", rank).where(F.col("rank") <= top)


class Quadtree:
    """Where a matrix is not zero: level k tells of squares of 2^k by 2^k leaves whether any place in them is set."""

    def __init__(self, counts: np.ndarray, leaf: tuple[int, int]):
        rows, columns = (counts.shape[k] // leaf[k] for k in (0, 1))
        self.levels = [(counts.reshape(rows, leaf[0], columns, leaf[1]) > 0).any(axis=(1, 3))]
        while self.levels[-1].shape[0] > 1:
            below = self.levels[-1]
            self.levels.append(below.reshape(below.shape[0] // 2, 2, below.shape[1] // 2, 2).any(axis=(1, 3)))

    def pairs(self, level: int, a: int, b: int, column: int, empty, leaf) -> None:
        """Goes down rows a and b of a level together from a column on: empty(level, a, b, column) where neither has a
        place, leaf(a, b, column) where leaves are reached."""
        here = self.levels[level]
        if not here[a, column] and not here[b, column]:
            empty(level, a, b, column)
        elif level == 0:
            leaf(a, b, column)
        else:
            for c in (2 * column, 2 * column + 1):
                for x in (2 * a, 2 * a + 1):
                    for y in (2 * b, 2 * b + 1):
                        self.pairs(level - 1, x, y, c, empty, leaf)


def _price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def tile_values(p: np.ndarray, nothing: np.ndarray, set_: np.ndarray) -> np.ndarray:
    """values[g, h]: the sum over a tile's terms of the price of group g's shares against group h's. p: shares (groups
    by terms), nothing: the share of a term that a group does not have, set_: where a group has a term."""
    groups, terms = p.shape
    leaf_rows = min(LEAF_ROWS, 1 << max(0, groups - 1).bit_length())
    depth = max(0, -(-groups // leaf_rows) - 1).bit_length()
    leaf_columns = max(1, -(-terms // (1 << depth)))
    leaf = leaf_rows, leaf_columns
    shape = leaf_rows << depth, leaf_columns << depth
    # terms of the same groups stand side by side, rare ones last: whole quadrants stay empty
    order = np.lexsort([*set_, -set_.sum(axis=0)])
    full = np.ones(shape, np.int64)
    full[:groups, :terms] = p[:, order]
    none = np.ones(shape[0], np.int64)
    none[:groups] = nothing
    held = np.zeros(shape, bool)
    held[:groups, :terms] = set_[:, order]
    tree, out = Quadtree(held, leaf), np.zeros((shape[0], shape[0]), np.int64)
    empties = _price(none[:, None], none[None, :])

    def empty(level: int, a: int, b: int, column: int) -> None:
        first = column * leaf_columns << level
        width = min(terms, first + (leaf_columns << level)) - first
        if width > 0:
            rows = [slice(x * leaf_rows << level, (x + 1) * leaf_rows << level) for x in (a, b)]
            out[rows[0], rows[1]] += width * empties[rows[0], rows[1]]

    def price(a: int, b: int, column: int) -> None:
        columns = slice(column * leaf_columns, min(terms, (column + 1) * leaf_columns))
        x, y = (slice(k * leaf_rows, (k + 1) * leaf_rows) for k in (a, b))
        out[x, y] += _price(full[x, None, columns], full[None, y, columns]).sum(axis=2)

    tree.pairs(depth, 0, 0, 0, empty, price)
    return out[:groups, :groups]


def _tile(batch: pa.Table, tile_groups: int) -> pa.Table:
    """(lang, a, b, value, seen) of one tile: rows (lang, term, place, p, nothing), those of no term giving the groups;
    seen are the terms that any of them has."""
    lang, term = batch.column("lang")[0].as_py(), batch.column("term").combine_chunks().dictionary_encode()
    place, p, nothing = (batch.column(c).to_numpy() for c in ("place", "p", "nothing"))
    is_group = np.asarray(term.is_null())
    own, row = np.unique(place, return_inverse=True)
    lacking = np.zeros(len(own), np.int64)
    lacking[row[is_group]] = nothing[is_group]
    shares = np.repeat(lacking[:, None], len(term.dictionary), axis=1)
    set_ = np.zeros(shares.shape, bool)
    r, c = row[~is_group], term.indices.drop_null().to_numpy()
    shares[r, c], set_[r, c] = p[~is_group], True
    values = tile_values(shares, lacking, set_)
    # two blocks of groups: only pairs across them are this tile's own
    block = batch.column("a_block")[0].as_py(), batch.column("b_block")[0].as_py()
    a, b = np.nonzero(~np.eye(len(own), dtype=bool))
    if block[0] != block[1]:
        side = own // tile_groups
        a, b = a[side[a] != side[b]], b[side[a] != side[b]]
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(own[a], pa.int32()), "b": pa.array(own[b], pa.int32()), "value": pa.array(values[a, b], pa.int64()), "seen": pa.array(np.full(len(a), shares.shape[1]), pa.int64())})


def pair_divergence(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): of each group every other source of its language, prices summed over all
    kept terms (0 without any)."""
    sized = groups.where("terms > 0").withColumn("nothing", _share(F.lit(0), F.col("total"), F.col("terms")))
    tiles = F.ceil(F.col("terms") / TILE_TERMS).cast("int")
    blocks = F.floor(F.max("place").over(Window.partitionBy("lang")) / TILE_GROUPS).cast("int") + 1
    block = F.floor(F.col("place") / TILE_GROUPS).cast("int")
    known = stored(sized.withColumns({"tiles": tiles, "blocks": blocks, "block": block}))
    own = cells.join(small_or_shuffled(known), ["lang", "source"])
    share = own.select("lang", "term", "place", _share(F.col("count"), F.col("total"), F.col("terms")).alias("p"), F.lit(0).cast("long").alias("nothing"), F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int").alias("tile"), "block", "blocks")
    every = known.select("lang", F.lit(None).cast("string").alias("term"), "place", F.lit(0).cast("long").alias("p"), "nothing", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "block", "blocks")
    # a block of groups meets every other one once, in both directions at a time
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("a_block"), F.greatest(k, F.col("block")).alias("b_block")))
    dealt = share.unionByName(every).select("lang", "term", "place", "p", "nothing", "tile", F.inline(meets))
    tile_groups = TILE_GROUPS
    values = dealt.groupBy("lang", "a_block", "b_block", "tile").applyInArrow(lambda rows: _tile(rows, tile_groups), "lang string, a int, b int, value long, seen long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    named = lambda at, name, share: known.select("lang", F.col("place").alias(at), F.col("source").alias(name), F.col("nothing").alias(share))
    both = values.join(named("a", "source", "p"), ["lang", "a"]).join(named("b", "item", "q"), ["lang", "b"]).join(known.select("lang", "terms").distinct(), "lang")
    # terms that no group of a tile has, have one price too
    priced = both.select("lang", "source", "item", (F.col("value") + (F.col("terms") - F.col("seen")) * F.expr("(p - q) * (p - q) div q")).alias("value"))
    bare = groups.where("terms = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return priced.unionByName(none).withColumn("rank", rank)


def source_divergence(docs: DataFrame, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): parts `pair` and `term` for every row group of docs (text, lang, source).

    Null text, lang and source count as empty; repeated rows count each; an empty table gives an empty one; other
    columns, whatever their names, are ignored; long texts are counted whole. A language's last term tile holds
    about TILE_TERMS terms like the others, and no task more than TILE_GROUPS groups twice.
    """
    cells, groups = matrix(docs)
    pairs = pair_divergence(cells, groups).withColumn("part", F.lit("pair"))
    terms = term_divergence(cells, groups, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
