"""Trees of many groups at once: neighbour joining, Newick text and summaries.

A tree is rows (tree_id, node_id, parent_id, name, length, rank): rank orders a node's children. One task
builds a whole tree, so a group is bounded by MAX_LEAVES; the number of groups is not.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.storage import removed_at_exit, shared_dir

#: Leaves of one tree: their matrix of distances (800 MB) is what its task holds.
MAX_LEAVES = 10_000
#: Below so many nodes every pair is looked at; above, rows whose bound says that they may hold the best pair.
WHOLE_MATRIX = 256
NODES = "tree_id long, node_id long, parent_id long, name string, length double, rank int"


class _Tree:
    """Nodes of one tree while it is made: parents, lengths and ranks by node."""

    def __init__(self, leaves: int):
        self.parent = np.full(2 * leaves, -1)
        self.length, self.rank, self.size = np.zeros(2 * leaves), np.zeros(2 * leaves, dtype=np.int32), leaves

    def join(self, children: list[tuple[int, float]]) -> int:
        for rank, (child, length) in enumerate(children):
            self.parent[child], self.length[child], self.rank[child] = self.size, length, rank
        self.size += 1
        return self.size - 1


def _join_whole(tree: _Tree, d: np.ndarray, live: list[int]) -> None:
    """Joins the live nodes, whose distances are d in their order; of equal pairs the first."""
    while len(live) > 2:
        size, r = len(live), d.sum(axis=1)
        q = (size - 2) * d - r[:, None] - r[None, :]
        q[np.tril_indices(size)] = np.inf
        i, j = divmod(int(q.argmin()), size)
        left = d[i, j] / 2 + (r[i] - r[j]) / (2 * (size - 2))
        node = tree.join([(live[i], max(0.0, left)), (live[j], max(0.0, d[i, j] - left))])
        rest = [k for k in range(size) if k not in (i, j)]
        far = (d[rest, i] + d[rest, j] - d[i, j]) / 2
        d = np.block([[d[np.ix_(rest, rest)], far[:, None]], [far[None, :], np.zeros((1, 1))]])
        live = [live[k] for k in rest] + [node]
    if len(live) == 2:
        tree.join([(live[0], d[0, 1] / 2), (live[1], d[0, 1] / 2)])


def _join_bounded(tree: _Tree, d: np.ndarray, down_to: int) -> tuple[np.ndarray, list[int]]:
    """Joins leaves until down_to nodes are left; their distances and they, in order.

    With u = r / (nodes - 2), r a row's sum, the best pair has the least d - u - u. Each row keeps the least d - u to a
    later node of when it was last looked at; since then it can have fallen by what any u has risen, which drift adds
    up. Rows are looked at in the order of that bound, and none whose bound is over the best pair yet. Joined nodes
    keep their places in the matrix (a new node takes the first one's) until half of the places are free. d is overwritten."""
    ids, r, left_over, drift = np.arange(len(d)), d.sum(axis=1), len(d), 0.0
    u = r / (left_over - 2)
    least = np.array([(d[i, i + 1 :] - u[i + 1 :]).min(initial=np.inf) for i in range(len(d))])
    while left_over > max(down_to, 3):
        if 2 * left_over <= len(d):
            kept = np.flatnonzero(ids >= 0)
            kept = kept[np.argsort(ids[kept])]
            d, ids, least, r, u = d[np.ix_(kept, kept)], ids[kept], least[kept], r[kept], u[kept]
        bound = np.where(ids >= 0, (left_over - 2) * (least - drift - u), np.inf)
        slack = 1e-11 * (left_over * abs(u[ids >= 0]).max() + 1)
        best, near = (np.inf, -1, -1, -1, -1), 8
        while True:  # the rows of the lowest bounds, then of the next ones, until none can be better
            open_ = np.flatnonzero((bound <= best[0] + slack) & (bound < np.inf))
            if not len(open_):
                break
            if len(open_) > near:
                open_ = open_[np.argpartition(bound[open_], near)[:near]]
            for i in open_:
                later = ids > ids[i]
                low = np.where(later, d[i] - u, np.inf).min()
                least[i], bound[i] = low + drift, np.inf
                if low < np.inf and (left_over - 2) * (low - u[i]) <= best[0] + slack:
                    q = np.where(later, (left_over - 2) * d[i] - r[i] - r, np.inf)
                    j = np.flatnonzero(q == q.min())
                    j = j[ids[j].argmin()]
                    best = min(best, (q[j], ids[i], ids[j], i, j))
            near *= 2
        i, j = best[3:]
        left = d[i, j] / 2 + (r[i] - r[j]) / (2 * (left_over - 2))
        node = tree.join([(ids[i], max(0.0, left)), (ids[j], max(0.0, d[i, j] - left))])
        rest = np.flatnonzero(ids >= 0)
        rest = rest[(rest != i) & (rest != j)]
        far = (d[rest, i] + d[rest, j] - d[i, j]) / 2
        r[rest] += far - d[rest, i] - d[rest, j]
        left_over -= 1
        ids[i], ids[j], r[i], least[i] = node, -1, far.sum(), np.inf
        drift += (r[rest] / (left_over - 2) - u[rest]).max()
        u[rest], u[i] = r[rest] / (left_over - 2), r[i] / (left_over - 2)
        d[rest, i] = d[i, rest] = far
        least[rest] = np.minimum(least[rest], far - u[i] + drift)
    kept = np.flatnonzero(ids >= 0)
    kept = kept[np.argsort(ids[kept])]
    return d[np.ix_(kept, kept)], ids[kept].tolist()


def _join_group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    d = names = key = None
    for rows in batches:
        if d is None:
            key, n = rows["tree_id"].iloc[0], int(rows["n"].iloc[0])
            if n > MAX_LEAVES:
                raise ValueError(f"{n} leaves are over MAX_LEAVES")
            d, names = np.zeros((n, n)), [""] * (2 * n)
        leaf = rows["b"].isna()
        for place, name in zip(rows["a"][leaf], rows["name"][leaf], strict=True):
            names[place] = name
        i, j = rows["a"][~leaf].to_numpy(), rows["b"][~leaf].to_numpy().astype(int)
        d[i, j] = d[j, i] = rows["distance"][~leaf]
    if d is None:
        return
    tree, live = _Tree(len(d)), list(range(len(d)))
    if len(live) > WHOLE_MATRIX:
        d, live = _join_bounded(tree, d, WHOLE_MATRIX)
    _join_whole(tree, d, live)
    k = tree.size
    parents = pd.Series(tree.parent[:k]).astype("Int64").where(tree.parent[:k] >= 0)
    yield pd.DataFrame({"tree_id": key, "node_id": np.arange(k), "parent_id": parents, "name": names[:k], "length": tree.length[:k], "rank": tree.rank[:k]})


def neighbor_joining(distances: DataFrame) -> DataFrame:
    """Nodes of one tree for each grp of rows (grp, id_a, id_b, distance); id_b null for a lone leaf.

    Leaves are numbered in Spark, so a task takes a tree's distances batch by batch into its matrix. Distances are
    stored once, since numbers and pairs both read them."""
    spark = distances.sparkSession
    path = removed_at_exit(spark, f"{shared_dir(spark)}/strandlake/{uuid.uuid4().hex}")
    distances.select(F.col("grp").cast("long").alias("tree_id"), "id_a", "id_b", "distance").write.parquet(path)
    own = spark.read.parquet(path)
    leaves = own.select("tree_id", F.explode(F.array("id_a", "id_b")).alias("id")).where("id is not null").distinct()
    place = (F.row_number().over(Window.partitionBy("tree_id").orderBy("id")) - 1).alias("place")
    leaves = leaves.select("tree_id", "id", place, F.count("*").over(Window.partitionBy("tree_id")).cast("int").alias("n"))
    first, second = (leaves.select("tree_id", F.col("id").alias(f"id_{x}"), F.col("place").alias(x), "n") for x in "ab")
    pairs = own.where("id_b is not null").join(first, ["tree_id", "id_a"]).join(second.drop("n"), ["tree_id", "id_b"])
    rows = pairs.select("tree_id", "a", "b", "distance", F.lit(None).cast("string").alias("name"), "n").unionByName(
        leaves.select("tree_id", F.col("place").alias("a"), F.lit(None).cast("int").alias("b"), F.lit(None).cast("double").alias("distance"), F.col("id").cast("string").alias("name"), "n")
    )
    return rows.groupBy("tree_id").applyInPandas(_join_group, NODES)


def _write(rows: pd.DataFrame) -> pd.DataFrame:
    kids: dict = {}
    for r in rows.sort_values("rank").itertuples():
        kids.setdefault(None if pd.isna(r.parent_id) else int(r.parent_id), []).append(r)
    text: dict[int, str] = {}
    stack = [(kids[None][0], False)]
    while stack:
        r, done = stack.pop()
        own = kids.get(int(r.node_id), [])
        if own and not done:
            stack.append((r, True))
            stack += [(k, False) for k in own]
            continue
        inner = "(" + ",".join(text[int(k.node_id)] for k in own) + ")" if own else ""
        text[int(r.node_id)] = inner + r.name_ + (f":{r.length:.4f}" if r.length else "")
    return pd.DataFrame({"tree_id": [rows["tree_id"].iloc[0]], "newick": [text[int(kids[None][0].node_id)]]})


def to_newick(nodes: DataFrame) -> DataFrame:
    """(tree_id, newick): lengths with four decimals, left out where 0, and no closing semicolon."""
    return nodes.withColumnRenamed("name", "name_").groupBy("tree_id").applyInPandas(_write, "tree_id long, newick string")


def read_newick(trees: DataFrame) -> DataFrame:
    """Nodes of rows (tree_id, newick), numbered in order of their end in the text; bad lengths are 0."""

    def parse(tree: int, text: str) -> list[list]:
        out: list[list] = []
        open_: list[list[int]] = [[]]
        i, n = 0, len(text or "")
        closed: list[int] | None = None
        while i < n and text[i] != ";":
            if text[i] == "(":
                open_.append([])
                i += 1
                continue
            j = i
            while j < n and text[j] not in ",();":
                j += 1
            name, _, length = text[i:j].partition(":")
            try:
                value = float(length)
                value = value if value == value else 0.0
            except ValueError:
                value = 0.0
            node = len(out)
            out.append([tree, node, None, name.strip(), value, len(open_[-1])])
            for child in closed or []:
                out[child][2] = node
            open_[-1].append(node)
            closed = None
            if j < n and text[j] == ")" and len(open_) > 1:
                closed = open_.pop()
                j += 1
            elif j < n and text[j] == ",":
                j += 1
            i = j
            if closed is not None and (i >= n or text[i] == ";"):
                node = len(out)
                out.append([tree, node, None, "", 0.0, len(open_[-1])])
                for child in closed:
                    out[child][2] = node
                closed = None
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for tree, text in zip(batch["tree_id"], batch["newick"], strict=True) for r in parse(tree, text)]
            yield pd.DataFrame(rows, columns=["tree_id", "node_id", "parent_id", "name", "length", "rank"]).astype({"parent_id": "Int64", "tree_id": "int64", "node_id": "int64", "rank": "int32", "length": "float64"})

    return trees.select("tree_id", "newick").mapInPandas(run, NODES)


def tree_summary(nodes: DataFrame) -> DataFrame:
    """(tree_id, leaves, max_depth): a branch without length counts 0.1.

    Every node knows an ancestor and the way up to it; in a round it takes that ancestor's ancestor, so ways double
    and a tree of n levels takes log n joins."""
    step = F.when(F.coalesce("length", F.lit(0.0)) == 0, 0.1).otherwise(F.col("length"))
    own = nodes.select("tree_id", "node_id", "parent_id", step.alias("step"))
    inner = own.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id")).distinct()
    shared_dir(nodes.sparkSession)
    up = own.select("tree_id", "node_id", F.col("parent_id").alias("above"), F.when(F.col("parent_id").isNotNull(), F.col("step")).otherwise(0.0).alias("depth"))
    most = own.groupBy("tree_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(most.bit_length() + 1):
        if up.where("above is not null").isEmpty():
            break
        higher = up.select("tree_id", F.col("node_id").alias("above"), F.col("above").alias("next"), F.col("depth").alias("more"))
        joined = up.join(higher, ["tree_id", "above"], "left").where("above is null or more is not null")
        up = joined.select("tree_id", "node_id", F.col("next").alias("above"), (F.col("depth") + F.coalesce("more", F.lit(0.0))).alias("depth")).checkpoint()
    else:
        raise ValueError("the parents of a tree go round in a circle")
    return up.join(inner, ["tree_id", "node_id"], "left_anti").groupBy("tree_id").agg(F.count("*").alias("leaves"), F.max("depth").alias("max_depth"))
