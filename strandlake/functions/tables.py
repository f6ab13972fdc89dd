"""Small tables made on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows that goes to Spark as Arrow data, without a Python worker."""
    kind = T.StructType.fromDDL(schema)
    own = to_arrow_schema(kind)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, own, strict=True)], schema=own), kind)
