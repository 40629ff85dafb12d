"""Writing stage tables, exports and fitted state."""

from __future__ import annotations

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscape import constants as c


def sink_parquet(df: DataFrame, path: str) -> None:
    """Overwrite a stage table."""
    df.write.mode("overwrite").parquet(path)


def sink_csv_clusters(df: DataFrame, path: str, noise: bool = True) -> None:
    """Cluster labels and plot coordinates as CSV with a header, with or without noise rows."""
    rows = df if noise else df.where(F.col("cluster") != c.NOISE)
    rows.select("cluster", "x", "y").write.mode("overwrite").option("header", True).csv(path)


def save_weights(weights: DataFrame, path: str, block_bytes: int = 16 * 1024 * 1024) -> None:
    """A sparse document-term matrix ``(id, term, weight)`` as compressed sparse rows, in id order.

    A row is a document with its terms in order and their weights; Parquet keeps the offsets of both lists. Files and row groups of
    ``block_bytes`` hold disjoint id ranges, so a range of rows reads only the groups that meet it. A document's terms are
    bounded by the vocabulary; rows are dealt by ranges of the id. A null id comes first; repeated (id, term) pairs stay.
    """
    pairs = F.sort_array(F.collect_list(F.struct("term", "weight")))
    rows = weights.groupBy("id").agg(pairs.alias("pairs"))
    lists = rows.select("id", F.col("pairs.term").alias("terms"), F.col("pairs.weight").alias("weights"))
    ordered = lists.repartitionByRange("id").sortWithinPartitions("id")
    ordered.write.mode("overwrite").option("parquet.block.size", block_bytes).parquet(path)


def load_weight_rows(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Sparse rows ``(id, terms, weights)`` with ``low <= id < high``; the limits reach the scan."""
    rows = spark.read.schema("id bigint, terms array<string>, weights array<double>").parquet(path)
    rows = rows if low is None else rows.where(F.col("id") >= low)
    return rows if high is None else rows.where(F.col("id") < high)


def load_weights(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The matrix as long rows ``(id, term, weight)``."""
    rows = load_weight_rows(spark, path, low, high)
    pairs = rows.select("id", F.inline(F.arrays_zip("terms", "weights")))
    return pairs.withColumnsRenamed({"terms": "term", "weights": "weight"})


def save_stage(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """A stage table laid out by key: ``buckets`` files, each sorted by ``key``; returns the table.

    Two stage tables with the same key type and number of buckets are joined, and each is grouped by the key, without an
    exchange. Rows move once, here. The catalog of the session keeps the layout under ``name``; the data lie in ``path``, which must be
    a folder that all executors share. A key with many rows makes one large file, read by one task in such a join: lay out by
    unique keys. Null keys lie in one bucket and meet nothing in a join.
    """
    dealt = df.repartition(buckets, key)
    writer = dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def drop_stage(spark: SparkSession, name: str) -> None:
    """Forget a stage table; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def save_model(model: MLWritable | DataFrame, path: str) -> None:
    """A fitted MLlib model, or a table of fitted parameters such as a vocabulary."""
    if isinstance(model, DataFrame):
        sink_parquet(model, path)
    else:
        model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str, kind: type | None = None):
    """Give the model class to load an MLlib model; without one the parameter table is read."""
    return spark.read.parquet(path) if kind is None else kind.load(path)
