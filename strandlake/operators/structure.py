"""Structures: residues, ligands, geometry and residue graphs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import refdata
from strandlake.functions.sizes import broadcast_if_small


def residues(atoms: DataFrame) -> DataFrame:
    """(structure_id, idx, chain, resi, resn, aa, x, y, z) of standard residues: the CA's place, else the mean of
    the atoms; of alternate locations the one of the highest occupancy counts."""
    order = Window.partitionBy("structure_id", "chain", "resi", "icode", "atom").orderBy(F.desc("occupancy"), "altloc")
    own = atoms.where((F.col("record") == "ATOM") & F.col("resn").isin(*refdata.THREE_LETTER)).withColumn("alt", F.row_number().over(order)).where("alt = 1")
    place = lambda c: F.coalesce(F.max(F.when(F.col("atom") == "CA", F.col(c))), F.avg(c)).alias(c)
    found = own.groupBy("structure_id", "chain", "resi", "icode").agg(F.min("serial").alias("first"), F.min_by("resn", "serial").alias("resn"), place("x"), place("y"), place("z"))
    idx = F.row_number().over(Window.partitionBy("structure_id").orderBy("first")) - 1
    return found.select("structure_id", idx.alias("idx"), "chain", "resi", "resn", refdata.lookup(refdata.THREE_LETTER, F.col("resn"), "X").alias("aa"), "x", "y", "z")


def primary_ligand(atoms: DataFrame) -> DataFrame:
    """Atoms (structure_id, x, y, z) of each structure's largest hetero group of three atoms or more, solvent
    and ions left out; the first on ties."""
    own = atoms.where((F.col("record") == "HETATM") & ~F.col("resn").isin(*refdata.NOT_LIGANDS))
    groups = own.groupBy("structure_id", "chain", "resi", "resn").agg(F.count("*").alias("n"), F.min("serial").alias("first"))
    rank = F.row_number().over(Window.partitionBy("structure_id").orderBy(F.desc("n"), "first"))
    best = groups.withColumn("rank", rank).where("rank = 1 and n >= 3").select("structure_id", "chain", "resi", "resn")
    return own.join(best, ["structure_id", "chain", "resi", "resn"]).select("structure_id", "chain", "resi", "resn", "x", "y", "z")


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size).cast("long")


#: Rows of the left side that meet what is around their cell together: so many, or as many as cut a cell of the usual crowd
#: into BLOCKS. A right row goes to each block, so with blocks of a fixed size copies would grow with the square of the rows.
#: Neither changes a result.
BLOCK, BLOCKS = 512, 2
#: Pairs of a task by estimate, and most tasks, beyond which each takes more. Neither changes a result.
TASK_PAIRS, MOST_TASKS = 1_000_000, 4_000


def _near(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """left and right (renamed with r_) rows of one structure within the same or neighbouring grid cells.

    Where that gives many pairs, a cell's left rows are dealt out to blocks, each of which meets the right rows by itself,
    so the pairs of a crowded cell are shared out; tasks are as many as pairs, not bytes, ask for."""
    keys = ["structure_id", "cx", "cy", "cz"]
    a = left.withColumns({k: _cell(c, reach) for k, c in zip(keys[1:], "xyz", strict=True)})
    steps = F.array(*[F.lit(s) for s in (-1, 0, 1)])
    b = right.select(*[F.col(c).alias("structure_id" if c == "structure_id" else f"r_{c}") for c in right.columns])
    for k, c in zip(keys[1:], "xyz", strict=True):
        b = b.withColumn("step", F.explode(steps)).withColumn(k, _cell(f"r_{c}", reach) + F.col("step")).drop("step")
    cells = a.groupBy(*keys).agg(F.count("*").alias("n"))
    rows, squares = cells.agg(F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n"))).first()
    pairs = 27 * (squares or 0)
    if pairs <= TASK_PAIRS:
        return a.join(b, keys).drop(*keys[1:])
    size = max(BLOCK, math.ceil(squares / rows / BLOCKS))
    blocks = cells.select(*keys, F.ceil(F.col("n") / size).cast("int").alias("blocks"))
    dealt, blocks, tasks = [*keys, "block"], broadcast_if_small(blocks), min(MOST_TASKS, int(pairs / TASK_PAIRS) + 1)
    a = a.join(blocks, keys).withColumn("block", F.pmod(F.xxhash64(*left.columns), F.col("blocks")).cast("int")).drop("blocks")
    b = b.join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return a.repartition(tasks, *dealt).join(b.repartition(tasks, *dealt), dealt).drop(*dealt[1:])


def distance(a: str = "", b: str = "r_") -> Column:
    """Products, as SQL has them: a power of 2 may differ in the last bit, and costs more."""
    x, y, z = (F.col(f"{a}{c}") - F.col(f"{b}{c}") for c in "xyz")
    return F.sqrt(x * x + y * y + z * z)


def label_binding(own: DataFrame, ligand: DataFrame, threshold: float = 6.0) -> DataFrame:
    """residues plus binding: 1 within the threshold of a ligand atom, else 0; null without a ligand."""
    near = _near(own, ligand.select("structure_id", "x", "y", "z"), threshold).where(distance() <= threshold).select("structure_id", "idx").distinct().withColumn("hit", F.lit(1))
    has = ligand.select("structure_id").distinct().withColumn("has", F.lit(1))
    joined = own.join(near, ["structure_id", "idx"], "left").join(has, "structure_id", "left")
    return joined.withColumn("binding", F.when(F.col("has") == 1, F.coalesce("hit", F.lit(0)))).drop("hit", "has")


def residue_features(own: DataFrame, secondary: DataFrame | None = None) -> DataFrame:
    """(structure_id, idx, features): one-hot residue (20), hydropathy, charge, polarity, one-hot secondary
    structure (3, zeros if unknown), exposure (0.5 if unknown). secondary: (structure_id, idx, ss, exposure)."""
    scales = refdata.residue_scales()
    rows = own if secondary is None else own.join(secondary, ["structure_id", "idx"], "left")
    ss, exposure = (F.lit(None).cast("string"), F.lit(None).cast("double")) if secondary is None else (F.col("ss"), F.col("exposure"))
    one_hot = [F.when(F.col("aa") == aa, 1.0).otherwise(0.0) for aa in refdata.RESIDUE_ORDER]
    known = [refdata.lookup(scales[k], F.col("aa"), 0.0) for k in ("hydropathy", "charge", "polarity")]
    kind = [F.coalesce(ss.isin(*"HGI"), F.lit(False)), F.coalesce(ss.isin(*"BE"), F.lit(False)), F.coalesce(~ss.isin(*"HGIBE"), F.lit(False))]
    return rows.select("structure_id", "idx", F.array(*one_hot, *known, *[k.cast("double") for k in kind], F.coalesce(exposure, F.lit(0.5))).alias("features"))


def _vector(a: dict[str, Column], b: dict[str, Column]) -> list[Column]:
    return [b[c] - a[c] for c in "xyz"]


def _dot(u: list[Column], v: list[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _at(step: int) -> dict[str, Column]:
    w = Window.partitionBy("structure_id").orderBy("idx")
    return {c: (F.lead(c, step) if step > 0 else F.lag(c, -step) if step < 0 else F.first(c)).over(w if step else w.rowsBetween(0, 0)) for c in "xyz"}


def backbone_angles(own: DataFrame) -> DataFrame:
    """Angle at each residue between the ones before and after in order (across chains); 0 at the ends."""
    rows = own.withColumns({f"{k}_{c}": v[c] for k, v in (("p", _at(-1)), ("n", _at(1))) for c in "xyz"})
    here = {c: F.col(c) for c in "xyz"}
    u, v = (_vector(here, {c: F.col(f"{k}_{c}") for c in "xyz"}) for k in ("p", "n"))
    size = F.sqrt(_dot(u, u)) * F.sqrt(_dot(v, v))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(u, v) / size))
    return rows.select("structure_id", "idx", F.coalesce(F.when(size > 0, F.acos(cosine)), F.lit(0.0)).alias("angle"))


def backbone_dihedrals(own: DataFrame) -> DataFrame:
    """Dihedral of residues i-1 to i+2 in order, kept at i; 0 where undefined."""
    rows = own.withColumns({f"{k}_{c}": v[c] for k, v in (("p", _at(-1)), ("n", _at(1)), ("m", _at(2))) for c in "xyz"})
    p0, p2, p3 = ({c: F.col(f"{k}_{c}") for c in "xyz"} for k in "pnm")
    p1 = {c: F.col(c) for c in "xyz"}
    b1, b2, b3 = _vector(p0, p1), _vector(p1, p2), _vector(p2, p3)
    n1, n2 = _cross(b1, b2), _cross(b2, b3)
    l1, l2, lb = (F.sqrt(_dot(v, v)) for v in (n1, n2, b2))
    u1, u2, ub = [c / l1 for c in n1], [c / l2 for c in n2], [c / lb for c in b2]
    value = F.atan2(_dot(_cross(u1, ub), u2), _dot(u1, u2))
    defined = (lb >= 1e-6) & (l1 >= 1e-6) & (l2 >= 1e-6)
    return rows.select("structure_id", "idx", F.coalesce(F.when(defined, value), F.lit(0.0)).alias("dihedral"))


def radius_edges(own: DataFrame, r: float = 8.0, vectors: bool = False) -> DataFrame:
    """(structure_id, src, dst, distance): ordered pairs of 0 < distance < r, by a grid join; and dx, dy, dz with vectors."""
    points = own.select("structure_id", "idx", "x", "y", "z")
    pairs = _near(points, points, r).where(F.col("idx") != F.col("r_idx")).withColumn("distance", distance())
    return _edges(pairs.where((F.col("distance") > 0) & (F.col("distance") < r)), vectors)


def _edges(pairs: DataFrame, vectors: bool) -> DataFrame:
    more = [(F.col(f"r_{c}") - F.col(c)).alias(f"d{c}") for c in "xyz"] if vectors else []
    return pairs.select("structure_id", F.col("idx").alias("src"), F.col("r_idx").alias("dst"), "distance", *more)


def _spread(rank: Column) -> Column:
    """The 21 bits of a number, two zero bits behind each."""
    out = rank
    # Shifts and masks that take a number's halves, then quarters and so on apart.
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
    return out


def _along_curve(points: DataFrame, others: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """points plus near (how many others come before them on a curve through space), others plus near (their own place).

    The curve is a Z-order of the coordinates' ranks, so neither far points nor uneven density coarsen it. Of others in
    one place only the first k + 1 stay, behind which none can be among the k nearest of any point."""
    columns = ["structure_id", "idx", "x", "y", "z"]
    first = (F.row_number().over(Window.partitionBy("structure_id", "x", "y", "z").orderBy("idx")) <= k + 1).cast("int")
    both = others.select(*columns, first.alias("other"), F.lit(1 if points is others else 0).alias("point"))
    if points is not others:
        both = both.where("other = 1").union(points.select(*columns, F.lit(0), F.lit(1)))
    n = F.count("*").over(Window.partitionBy("structure_id"))
    rank = lambda c: F.floor((F.row_number().over(Window.partitionBy("structure_id").orderBy(c)) - 1).cast("double") / F.col("n") * (1 << 21)).cast("long")
    placed = both.withColumn("n", n).withColumns({f"r_{c}": rank(c) for c in "xyz"})
    curve = sum(F.shiftleft(_spread(F.col(f"r_{c}")), k) for k, c in enumerate("xyz"))
    near = F.sum("other").over(Window.partitionBy("structure_id").orderBy("curve", "idx", "other").rowsBetween(Window.unboundedPreceding, 0)) - F.col("other")
    ordered = placed.withColumn("curve", curve).withColumn("near", near)
    return ordered.where("point = 1").select(*columns, "near"), ordered.where("other = 1").select("structure_id", *[F.col(c).alias(f"r_{c}") for c in columns[1:]], "near")


def nearest(points: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """(structure_id, idx, r_idx, distance, and both places): the k nearest of others (structure_id, idx, x, y, z) to each of points,
    but those of its own idx if both tables are one; the lower idx on ties.

    The k others before and after a point on a curve through space give a distance that its k nearest cannot be beyond.
    The point then meets the others in the cells of a grid that this distance reaches, the grid being as wide as the
    distance asks for: each point has its own, so far points and dense places cost no more than others."""
    same = points is others
    mine, theirs = _along_curve(points, others, k)
    point = ["structure_id", "idx", "x", "y", "z"]
    own = F.col("idx") != F.col("r_idx") if same else F.lit(True)
    around = mine.withColumn("near", F.explode(F.sequence(F.col("near") - k, F.col("near") + k))).join(theirs, ["structure_id", "near"]).where(own)
    bounds = around.groupBy(*point).agg(F.element_at(F.slice(F.sort_array(F.collect_list(distance())), 1, k), -1).alias("reach"))
    # cells twice as wide as the distance or wider (powers of two), so it reaches two of them a side at most; not so small that a place is beyond whole numbers
    size = F.greatest(*[F.abs(F.col(c)) for c in "xyz"], F.lit(1e-300))
    level = F.ceil(F.greatest(F.log2(F.greatest(F.col("reach") * 2, F.lit(1e-300))), F.log2(size) - 48)).cast("int")
    asked = bounds.withColumn("level", level)
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("level")))
    for c in "xyz":
        asked = asked.withColumn(f"c_{c}", F.explode(F.sequence(cell(F.col(c) - F.col("reach")), cell(F.col(c) + F.col("reach")))))
    levels = asked.select("structure_id", "level").distinct()
    held = theirs.drop("near").join(levels, "structure_id").select("*", *[cell(F.col(f"r_{c}")).alias(f"c_{c}") for c in "xyz"])
    met = asked.join(held, ["structure_id", "level", "c_x", "c_y", "c_z"]).where(own).withColumn("distance", distance()).where(F.col("distance") <= F.col("reach") * (1 + 1e-12))
    rank = F.row_number().over(Window.partitionBy(*point).orderBy("distance", "r_idx"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("structure_id", "idx", "r_idx", "distance", *[c for v in "xyz" for c in (v, f"r_{v}")])


def knn_edges(own: DataFrame, k: int = 15, vectors: bool = False) -> DataFrame:
    """(structure_id, src, dst, distance) to the k nearest others of the structure; the lower idx on ties; and dx, dy, dz
    with vectors."""
    p = own.select("structure_id", "idx", "x", "y", "z")
    return _edges(nearest(p, p, k), vectors)


def residue_edges(own: DataFrame, r: float = 8.0, k: int = 15, vectors: bool = False) -> DataFrame:
    """Distinct union of radius and nearest-neighbour edges; self-loops where a structure has none. idx is unique in a
    structure, so of the nearest neighbours just those beyond the radius (or in one place) are added, and a structure
    has edges if two of its residues have places. With vectors also dx, dy, dz."""
    nearest_ones = knn_edges(own, k, vectors)
    both = radius_edges(own, r, vectors).union(nearest_ones.where((F.col("distance") <= 0) | (F.col("distance") >= r)))
    placed = F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).over(Window.partitionBy("structure_id"))
    alone = own.withColumn("_placed", placed).where("_placed < 2")
    zeros = [F.lit(0.0).alias(f"d{c}") for c in "xyz"] if vectors else []
    return both.union(alone.select("structure_id", F.col("idx").alias("src"), F.col("idx").alias("dst"), F.lit(0.0).alias("distance"), *zeros))


def _with_vectors(edges: DataFrame, own: DataFrame) -> DataFrame:
    """edges with dx, dy, dz; those that have them already are not joined with own."""
    if "dx" in edges.columns:
        return edges
    p = own.select("structure_id", F.col("idx").alias("src"), *[F.col(c).alias(f"a_{c}") for c in "xyz"])
    q = own.select("structure_id", F.col("idx").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in "xyz"])
    return edges.join(p, ["structure_id", "src"]).join(q, ["structure_id", "dst"]).withColumns({f"d{c}": F.col(f"b_{c}") - F.col(f"a_{c}") for c in "xyz"})


def edge_features(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(structure_id, src, dst, attr): distance, one-hot of 16 bins over 0 to 20, unit vector; zeros for self-loops. Edges
    with vectors are not joined with own."""
    rows = _with_vectors(edges, own)
    d = F.col("distance")
    bins = [F.when((d >= k * 1.25) & ((d < (k + 1) * 1.25) if k < 15 else (d <= 20.0)) & (F.col("src") != F.col("dst")), 1.0).otherwise(0.0) for k in range(16)]
    unit = [F.col(f"d{c}") / (d + 1e-8) for c in "xyz"]
    return rows.select("structure_id", "src", "dst", F.array(d, *bins, *unit).alias("attr"))


def edge_feature_values(edges: DataFrame, own: DataFrame, digits: int | None = None) -> DataFrame:
    """(structure_id, src, dst, at, v): edge_features with a row for each place, rounded to digits where given.

    No array of twenty values is built and taken apart again: the code that Spark makes for that seems too long for the JVM
    to compile, and it interprets it for each row."""
    held = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    d, at, bin_at = F.col("distance"), F.col("at"), (F.col("at") - 1) * 1.25
    told = [held(d).alias("_d"), *[held(F.col(f"d{c}") / (d + 1e-8)).alias(f"_u{c}") for c in "xyz"]]
    rows = _with_vectors(edges, own).select("structure_id", "src", "dst", "distance", *told, F.explode(F.sequence(F.lit(0), F.lit(19))).alias("at"))
    inside = (F.col("src") != F.col("dst")) & (d >= bin_at) & ((d < bin_at + 1.25) | ((at == 16) & (d <= 20.0)))
    v = F.when(at == 0, F.col("_d")).when(at == 17, F.col("_ux")).when(at == 18, F.col("_uy")).when(at == 19, F.col("_uz")).when(inside, 1.0).otherwise(0.0)
    return rows.select("structure_id", "src", "dst", "at", v.alias("v"))


def sequential_edges(own: DataFrame, reach: int = 1) -> DataFrame:
    """Both directions between residues up to reach apart, from sources before the last reach ones."""
    n = F.count("*").over(Window.partitionBy("structure_id"))
    sources = own.select("structure_id", "idx", n.alias("n")).where(F.col("idx") < F.col("n") - reach)
    one = sources.select("structure_id", "idx", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("s"))
    pair = F.array(F.struct(F.col("idx").alias("src"), (F.col("idx") + F.col("s")).alias("dst")), F.struct((F.col("idx") + F.col("s")).alias("src"), F.col("idx").alias("dst")))
    return one.select("structure_id", F.inline(pair))


def graph_stats(own: DataFrame, edges: DataFrame) -> DataFrame:
    n = own.groupBy("structure_id").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("structure_id").agg(F.count("*").alias("edges"))
    return n.join(e, "structure_id", "left").select("structure_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), (F.coalesce("edges", F.lit(0)) / F.col("nodes")).alias("mean_degree"))


def neighbor_pool(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(structure_id, idx, at, mean, max): each place of the feature vectors over a node's neighbours."""
    told = edges.select("structure_id", F.col("src").alias("idx"), F.col("dst").alias("n")).join(nodes.select("structure_id", F.col("idx").alias("n"), "features"), ["structure_id", "n"])
    return told.select("structure_id", "idx", F.posexplode("features").alias("at", "v")).groupBy("structure_id", "idx", "at").agg(F.avg("v").alias("mean"), F.max("v").alias("max"))


def structure_summary(lines: DataFrame) -> DataFrame:
    """(structure_id, atoms, chains, residues, title, method, resolution) from rows (structure_id, k, line)."""
    atom = F.col("line").startswith("ATOM  ")
    part = lambda a, n: F.substr("line", F.lit(a), F.lit(n))
    first = lambda test, value: F.min_by(F.when(test, value), F.when(test, F.col("k")))
    resolution = F.nullif(F.regexp_extract("line", r"^REMARK   2 RESOLUTION\.\s+([0-9.]+)", 1), F.lit(""))
    return lines.groupBy("structure_id").agg(
        F.count_if(atom).alias("atoms"), F.count_distinct(F.when(atom, part(22, 1))).alias("chains"), F.count_distinct(F.when(atom, part(18, 9))).alias("residues"),
        F.coalesce(first(F.col("line").startswith("TITLE"), F.trim(part(11, 70))), F.col("structure_id")).alias("title"),
        F.coalesce(first(F.col("line").startswith("EXPDTA"), F.trim(part(11, 70))), F.lit("Unknown")).alias("method"),
        F.coalesce(first(resolution.isNotNull(), resolution), F.lit("N/A")).alias("resolution"),
    )
