"""Registration of queries with their SQL, and the inputs derived from the given tables.

Every input is one SQL text that Spark and DuckDB both read, with the few words in which they differ
(ALL for a global replacement, STRING, a FLOAT's bound, which DuckDB compares as FLOAT) filled in for each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.storage import removed_at_exit, shared_dir

INPUTS = {
    "dna": """SELECT doc_id AS seq_id, concat('doc_', CAST(doc_id AS {string})) AS name, source AS organism, lang AS grp,
        upper(regexp_replace(text, '[^ACGTacgt]', ''{all})) AS sequence FROM documents""",
    "dna_n": "SELECT doc_id AS seq_id, regexp_replace(text, '[^ACGTNacgtn]', ''{all}) AS sequence FROM documents",
    "rna": "SELECT doc_id AS seq_id, translate(upper(regexp_replace(text, '[^ACGTacgt]', ''{all})), 'T', 'U') AS sequence FROM documents",
    "protein": "SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', ''{all})) AS sequence FROM documents",
    "short": "SELECT item_id AS seq_id, item_id % 5 AS grp, upper(regexp_replace(text, '[^ACGTacgt]', ''{all})) AS sequence FROM benchmark",
    "short_protein": "SELECT item_id AS seq_id, item_id % 5 AS grp, upper(regexp_replace(text, '[^DEHKMRWYdehkmrwy]', ''{all})) AS sequence FROM benchmark",
    "typed": """SELECT conv_id * 100000 + turn AS seq_id, CASE WHEN turn % 3 = 0 THEN regexp_replace(text, '[^ACGTacgt ]', ''{all})
        WHEN turn % 3 = 1 THEN translate(regexp_replace(text, '[^ACGTacgt ]', ''{all}), 'Tt', 'Uu')
        ELSE regexp_replace(text, '[^A-Za-z0-9 ]', ''{all}) END AS sequence FROM conversations""",
    "planted": """SELECT seq_id, concat(substr(s, 1, 20), CASE WHEN seq_id % 2 = 0 THEN t ELSE reverse(translate(t, 'ACGT', 'TGCA')) END, substr(s, 21)) AS sequence
        FROM (SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^ACGTacgt]', ''{all})) AS s,
              CASE doc_id % 3 WHEN 0 THEN 'CATCACCATCACCATCAC' WHEN 1 THEN 'TAATACGACTCACTATAGGG' ELSE 'ATTTAGGTGACACTATAG' END AS t FROM documents) q""",
    "headers": """SELECT c_custkey AS id, CASE c_custkey % 4
        WHEN 0 THEN concat('sp|P', lpad(CAST(c_custkey AS {string}), 5, '0'), '|KIN', CAST(c_nationkey AS {string}), '_HUMAN Kinase number ', CAST(c_nationkey AS {string}), ' OS=Homo sapiens OX=9606')
        WHEN 1 THEN concat('gi|', CAST(c_custkey AS {string}), '|ref|NM_', lpad(CAST(c_custkey AS {string}), 6, '0'), '.2| ', c_mktsegment, ' protein gene [Mus musculus]')
        WHEN 2 THEN concat('NP_', lpad(CAST(c_custkey AS {string}), 6, '0'), '.1 ', c_mktsegment, ' factor')
        ELSE concat('custom-', CAST(c_custkey AS {string}), ' no accession here') END AS header FROM customer""",
    "features": """SELECT l_suppkey AS seq_id, l_orderkey, l_linenumber, CAST(l_partkey % 1000 AS INT) AS start, CAST(l_partkey % 1000 + 1 + l_quantity AS INT) AS end_pos,
        CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand, CASE l_returnflag WHEN 'A' THEN 'gene' WHEN 'N' THEN 'CDS' ELSE 'promoter' END AS type FROM lineitem""",
    "residues": """SELECT concat('S', CAST(label AS {string})) AS structure_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS idx,
        CASE WHEN vec_id % 2 = 0 THEN 'A' ELSE 'B' END AS chain, CAST(vec_id AS INT) AS resi, substr('ARNDCQEGHILKMFPSTWYV', CAST(vec_id % 20 AS INT) + 1, 1) AS aa,
        round(CAST(embedding[{i0}] AS DOUBLE) * 60, 3) AS x, round(CAST(embedding[{i1}] AS DOUBLE) * 60, 3) AS y, round(CAST(embedding[{i2}] AS DOUBLE) * 60, 3) AS z
        FROM embeddings WHERE vec_id % 10 <> 0""",
    "ligands": """SELECT concat('S', CAST(label AS {string})) AS structure_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS idx,
        CASE WHEN vec_id % 2 = 0 THEN 'A' ELSE 'B' END AS chain, CAST(vec_id AS INT) AS resi, substr('ARNDCQEGHILKMFPSTWYV', CAST(vec_id % 20 AS INT) + 1, 1) AS aa,
        round(CAST(embedding[{i0}] AS DOUBLE) * 60, 3) AS x, round(CAST(embedding[{i1}] AS DOUBLE) * 60, 3) AS y, round(CAST(embedding[{i2}] AS DOUBLE) * 60, 3) AS z
        FROM embeddings WHERE vec_id % 10 = 0""",
    "scores": """SELECT vec_id AS id, concat('S', CAST(label AS {string})) AS grp, vec_id % 5 AS fold,
        CASE WHEN embedding[{i0}] + embedding[{i1}] > {bound} THEN 1 ELSE 0 END AS y_true,
        round(least(greatest((CAST(embedding[{i0}] AS DOUBLE) + 1) / 2, 0), 1), 6) AS y_proba FROM embeddings""",
    "logits": """SELECT vec_id AS id, CASE WHEN embedding[{i0}] + embedding[{i1}] > {bound} THEN 1 ELSE 0 END AS y_true, 4 * CAST(embedding[{i0}] AS DOUBLE) AS logit FROM embeddings""",
}
_SPARK = {"all": "", "string": "STRING", "bound": "CAST(0.15 AS FLOAT)", "i0": "0", "i1": "1", "i2": "2"}
_DUCKDB = {"all": ", 'g'", "string": "VARCHAR", "bound": "0.15", "i0": "1", "i1": "2", "i2": "3"}
_TABLES = ("documents", "benchmark", "conversations", "customer", "lineitem", "embeddings", "orders", "supplier", "nation", "region")


class Tables:
    """The given tables by name, and the inputs of INPUTS by name, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in _TABLES:
            return self.table(name)
        if name not in INPUTS:
            raise AttributeError(name)
        text = INPUTS[name].format(**_SPARK)
        source = next(t for t in _TABLES if f"FROM {t}" in text)
        return self.spark.sql(text.replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: self.table(source)})

    @cached_property
    def shared(self) -> str:
        """A new folder under the session's checkpoint folder, for queries that write and read files; it goes with the process."""
        return removed_at_exit(self.spark, f"{shared_dir(self.spark)}/strandlake-files/{uuid.uuid4().hex}")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """Adds a query; `$input` in its SQL stands for an input of INPUTS as a subquery."""
    QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    if sql is not None:
        for k in sorted(INPUTS, key=len, reverse=True):
            sql = sql.replace(f"${k}", f"({INPUTS[k].format(**_DUCKDB)})")
        ORACLES[name] = sql


def rounded(c: Column) -> Column:
    """Six places as DuckDB rounds: the product with a million to a whole number, whose tie may not be that of the decimal."""
    whole = F.round(c * 1e6)
    return F.when(F.abs(whole) == float("inf"), c).otherwise(whole / 1e6)


def out(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns, whole numbers as long and fractions rounded to six places, as the SQL gives them."""
    chosen = df.select(*columns) if columns else df
    kinds = dict(chosen.dtypes)
    plain = {c: F.col(c).cast("long") for c, k in kinds.items() if k in ("int", "smallint", "tinyint")}
    return chosen.withColumns(plain | {c: rounded(F.col(c)) if k == "double" else F.round(c, 6) for c, k in kinds.items() if k in ("double", "float")})
