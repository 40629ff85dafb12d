"""Seeded samples, top-k reports, splits and stacking.

A sample is the first n rows in the order of ``md5(seed:key)``: exact in size, without
replacement, and the same on any cluster and any partitioning.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscape import constants as c
from corpuscape.operators.cuts import nth_smallest
from corpuscape.operators.rows import cluster_semi_join, distinct_clusters


def draw_order(key: str, seed: int = c.SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def _draw(key: str, seed: int) -> Column:
    return F.struct(draw_order(key, seed).alias("draw"), F.col(key).alias("tie"))


def exact_sample(df: DataFrame, n: int, seed: int = c.SEED, key: str = "id") -> DataFrame:
    """Exactly min(n, N) rows without replacement.

    Only keys are ordered: the n-th smallest draw becomes a cut value and the rows come from a
    plain filter against it, so wide rows are never sorted, collected or moved.
    """
    return df.where(_draw(key, seed) <= nth_smallest(df.select(_draw(key, seed).alias("k")), n))


def plot_sample(df: DataFrame, n: int = c.PLOT_ROWS, seed: int = c.SEED, key: str = "id") -> DataFrame:
    return exact_sample(df, n, seed, key)


def top_longest(df: DataFrame, k: int = c.TOP_LONGEST, key: str = "id") -> DataFrame:
    """The longest documents; ties in key order."""
    return df.orderBy(F.desc("word_count"), key).limit(k).select("title", "word_count")


def random_clusters(df: DataFrame, n: int, seed: int = c.SEED, include_noise: bool = True) -> DataFrame:
    """n distinct cluster ids."""
    ids = distinct_clusters(df if include_noise else df.where(F.col("cluster") != c.NOISE))
    return exact_sample(ids, n, seed, "cluster")


def _first_drawn(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """The first n drawn rows of each cluster. Spark applies the rank limit before the shuffle
    (WindowGroupLimit), so a cluster of any size sends at most n rows per task."""
    order = Window.partitionBy("cluster").orderBy(draw_order(key, seed), key)
    ranked = df.withColumn("draw_rank", F.row_number().over(order))
    return ranked.where(F.col("draw_rank") <= n)


def cluster_examples(
    df: DataFrame,
    n: int = c.EXAMPLES_PER_CLUSTER,
    seed: int = c.SEED,
    key: str = "id",
    title: str = "title",
) -> DataFrame:
    """Up to n sampled titles per cluster as a list, in draw order."""
    drawn = _first_drawn(df.select("cluster", key, title), n, seed, key)
    pairs = F.sort_array(F.collect_list(F.struct("draw_rank", title)))
    return drawn.groupBy("cluster").agg(
        F.transform(pairs, lambda p: p[title]).alias("example_titles")
    )


def clusters_head(examples: DataFrame, n: int = c.CLUSTERS_SHOWN) -> DataFrame:
    return examples.orderBy("cluster").limit(n)


def cluster_stratified_sample(
    df: DataFrame,
    clusters: int = c.STRATIFIED_CLUSTERS,
    n: int = c.STRATIFIED_ROWS,
    seed: int = c.SEED,
    key: str = "id",
) -> DataFrame:
    """Up to n rows from each of some drawn clusters."""
    chosen = random_clusters(df, clusters, seed)
    return _first_drawn(cluster_semi_join(df, chosen, clusters), n, seed, key).drop("draw_rank")


def union_samples(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def union_batches(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack results that arrive as separate tables."""
    return union_samples(frames)


def train_test_split(
    df: DataFrame, test: float = c.TEST_SHARE, seed: int = c.SEED, key: str = "id"
) -> DataFrame:
    """Add ``split``: exactly ceil(test * N) drawn rows are ``test``, the rest ``train``."""
    n = max(math.ceil(test * df.count()), 1)
    drawn = _draw(key, seed) <= nth_smallest(df.select(_draw(key, seed).alias("k")), n)
    return df.withColumn("split", F.when(drawn, F.lit("test")).otherwise(F.lit("train")))
