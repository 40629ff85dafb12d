"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscape.runtime import scratch_path

#: Stands for a null document id inside the operators; never returned.
NO_ID = -(2**63) + 1
#: White space between words, as a Java character class.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there: cuts the lineage,
    computes each row once and outlives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_{uuid4().hex[:6]}"
    return name


def byte_values(array: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null becomes empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [b"" if x is None else x for x in array.cast(kind).to_pylist()]


def text_values(array: pa.Array) -> list[str]:
    """The texts of an Arrow column; null becomes empty."""
    return ["" if x is None else x for x in array.to_pylist()]


def crc_rest(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids fall into part 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
