"""Edge features as rows of values: those of the arrays, in code that the JVM compiles."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from strandlake.operators import structure


def _own(spark):
    places = [(f"S{s}", i, float(x), float(y), 0.25 * s) for s in range(2) for i, (x, y) in enumerate([(0, 0), (1.25, 0), (2.5, 0), (0, 3.75), (18.75, 0), (20, 0), (0, 0), (40, 7)])]
    return spark.createDataFrame([*places, ("alone", 0, 1.0, 1.0, 1.0)], "structure_id string, idx int, x double, y double, z double")


def test_values_are_those_of_the_arrays(spark):
    own = _own(spark)
    keys = ["structure_id", "src", "dst"]
    whole = structure.edge_features(structure.residue_edges(own, k=3), own).select(*keys, F.posexplode("attr").alias("at", "v"))
    for edges in (structure.residue_edges(own, k=3), structure.residue_edges(own, k=3, vectors=True)):
        for digits in (None, 6):
            told = structure.edge_feature_values(edges, own, digits)
            expected = whole if digits is None else whole.withColumn("v", F.round("v", digits))
            assert sorted(map(tuple, told.collect())) == sorted(map(tuple, expected.collect()))


def test_edges_with_vectors_are_not_joined_and_code_is_short(spark):
    edges = spark.range(10).select(F.lit("S").alias("structure_id"), F.col("id").cast("int").alias("src"), (F.col("id") + 1).cast("int").alias("dst"), *[F.rand(k).alias(c) for k, c in enumerate(("distance", "dx", "dy", "dz"))])
    told = structure.edge_feature_values(edges, _own(spark), 6)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        told.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]
    assert sizes and max(sizes) < 8000  # the JVM interprets longer ones
    assert "Join" not in text.getvalue()
