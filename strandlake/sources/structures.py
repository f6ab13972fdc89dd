"""Structure files of fixed columns as atom tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_hybrid_36(number: Column, width: int) -> Column:
    """A number of 0 or more in a column of fixed width: decimal digits while they fit, then the digits of base 36 from
    A000 (of width 4) on, then those from a000 on, as large structures' files number serials and residues. A number that
    does not fit then either is an error."""
    least, step = 10**width, 26 * 36 ** (width - 1)
    beyond = F.conv((number - least + 10 * 36 ** (width - 1)).cast("string"), 10, 36)
    further = F.lower(F.conv((number - least - step + 10 * 36 ** (width - 1)).cast("string"), 10, 36))
    too_large = F.raise_error(F.concat(F.lit(f"no place in {width} columns for "), number.cast("string"))).cast("string")
    text = F.when(number < least, number.cast("string")).when(number < least + step, beyond).when(number < least + 2 * step, further).otherwise(too_large)
    return F.lpad(text, width, " ")


def from_hybrid_36(text: Column, width: int) -> Column:
    """The whole number of a column of fixed width, trimmed; null for any other text."""
    base = F.conv(text, 36, 10).try_cast("long") - 10 * 36 ** (width - 1) + 10**width
    of = lambda first, rest: text.rlike(f"^[{first}][0-9{rest}]{{{width - 1}}}$")
    return F.when(of("A-Z", "A-Z"), base).when(of("a-z", "a-z"), base + 26 * 36 ** (width - 1)).otherwise(text.try_cast("int")).cast("int")


def structure_lines(spark: SparkSession, path: str) -> DataFrame:
    """(structure_id, k, line) of every file under path; the id is a partition column of that name or the
    file's name without its ending. A structure is one row while it is split into lines."""
    rows = spark.read.text(path, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[A-Za-z]+(\.gz)?$", "")
    key = F.col("structure_id").cast("string") if "structure_id" in rows.columns else stem
    return rows.select(key.alias("structure_id"), F.posexplode(F.split("value", "\r?\n")).alias("k", "line"))


def atoms(lines: DataFrame) -> DataFrame:
    """Atom rows of the first model: rows before a structure's first ENDMDL."""
    own = lines.where(F.col("line").rlike("^(ATOM  |HETATM|ENDMDL)"))
    end = own.where(F.col("line").startswith("ENDMDL")).groupBy("structure_id").agg(F.min("k").alias("_end"))
    first = own.join(end, "structure_id", "left").where((F.col("_end").isNull() | (F.col("k") < F.col("_end"))) & ~F.col("line").startswith("ENDMDL"))
    part = lambda a, n: F.trim(F.substr("line", F.lit(a), F.lit(n)))
    number = lambda a, n: part(a, n).try_cast("double")
    return first.select(
        "structure_id", part(1, 6).alias("record"), from_hybrid_36(part(7, 5), 5).alias("serial"), part(13, 4).alias("atom"), part(17, 1).alias("altloc"), part(18, 3).alias("resn"), part(22, 1).alias("chain"),
        from_hybrid_36(part(23, 4), 4).alias("resi"), part(27, 1).alias("icode"), number(31, 8).alias("x"), number(39, 8).alias("y"), number(47, 8).alias("z"), F.coalesce(number(55, 6), F.lit(1.0)).alias("occupancy"),
    )


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    return atoms(structure_lines(spark, path))
