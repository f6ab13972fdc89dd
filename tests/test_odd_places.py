"""mt_11 against its SQL on places that are not finite, on sums at the bound of a label and on ties of the sixth place."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandlake import plans
from strandlake.operators import structure


def _same(spark, folder, name="mt_11_distance_to_center"):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    found = sorted(map(tuple, plans.QUERIES[name](spark, str(folder)).collect()))
    want = sorted(con.execute(plans.ORACLES[name]).fetchall())
    assert len(found) == len(want)
    for a, b in zip(found, want, strict=True):
        assert all(x == y or isinstance(x, float) and math.isnan(x) and math.isnan(y) for x, y in zip(a, b, strict=True)), (a, b)


def _write(folder, vectors, labels):
    rows = pa.array([None if v is None else list(v) for v in vectors], pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": rows, "label": pa.array(labels, pa.int32())}), f"{folder}/embeddings.parquet")


@pytest.mark.parametrize("odd", [math.nan, math.inf, -math.inf, None])
def test_places_that_are_not_finite(spark, tmp_path, odd):
    g = np.random.default_rng(5)
    vectors = [[float(x) for x in v] for v in g.normal(0, 0.3, (600, 3)).clip(-1, 1)]
    labels = [int(x) for x in g.integers(0, 12, 600)]
    for n in range(0, 600, 7):
        vectors[n][n % 3] = odd
    for n in range(600):
        if labels[n] > 8:  # structures without a finite place
            vectors[n][labels[n] % 3] = odd
    _write(tmp_path, vectors, labels)
    _same(spark, tmp_path)


def test_sums_at_the_bound(spark, tmp_path):
    g = np.random.default_rng(6)
    _write(tmp_path, [[float(x) for x in v] for v in np.round(g.normal(0, 0.2, (2000, 3)) * 60) / 60], [int(x) for x in g.integers(0, 40, 2000)])
    _same(spark, tmp_path)
    _same(spark, tmp_path, "mt_4_classification_metrics")


def test_ties_of_the_sixth_place(spark, tmp_path):
    # 640 predictions of each structure, of which 333, 323 and 41 are at a true place and all others far from any
    vectors, labels = [], []
    for label, hits in enumerate((333, 323, 41)):
        while labels.count(label) < 640:
            at = len(vectors)
            if at % 10:  # others are no residues
                labels.append(label)
                vectors.append([0.5, 0.0, 0.0] if sum(x == label for x in labels) <= hits else [0.5, -1.0, 0.0])
            else:
                labels.append(99)
                vectors.append([0.0, 0.0, 0.0])
    _write(tmp_path, vectors, labels)
    _same(spark, tmp_path)


def test_copies_of_a_crowded_cell_do_not_grow_with_its_square(spark, monkeypatch):
    """each row went to each block of a fixed size of the cells around it."""
    monkeypatch.setattr(structure, "BLOCK", 10)
    monkeypatch.setattr(structure, "TASK_PAIRS", 1000)
    own = spark.range(400).selectExpr("'s' AS structure_id", "CAST(id AS INT) AS idx", "1.0D + id % 5 AS x", "1.0D + id % 7 AS y", "1.0D + id % 3 AS z")
    dealt, plain = [], type(own).repartition
    monkeypatch.setattr(type(own), "repartition", lambda self, *how: dealt.append(self.count()) or plain(self, *how))
    edges = structure.radius_edges(own, 8.0).count()
    places = own.groupBy("x", "y", "z").count().collect()
    assert len(dealt) == 2 and max(dealt) <= 3 * 400 and edges == 400 * 400 - sum(r["count"] ** 2 for r in places)
