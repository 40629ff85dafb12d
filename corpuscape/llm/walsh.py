"""Centroid clustering with exact integers and a progressive Walsh-Hadamard search.

``scaled`` keeps vectors with the right number of components, none null or non-finite, and turns a component x into
the integer floor(64 * x). ``cluster`` runs rounds of assignment and of componentwise exact floor(sum / count)
from given first centroids, then assigns once more.

Search: the Walsh-Hadamard transform of 64 integers is 64 integers, and the squared distance of two vectors is the
squared distance of their transforms divided by 64. So the squared differences of coefficients, added up from
coarse (few sign changes) to fine, are a lower bound that grows to 64 times the distance. After each level the
centroid with the least bound is measured to the end, and centroids whose bound is strictly above the least distance
known go. What is left is measured with all 64 coefficients: ties are seen exactly and go to the smaller number.

Integers are limited to +-2^24 (components of 262,144), beyond which neither bounds nor sums would fit 64 bits.
Rows are never moved or compared with each other: a task holds the centroids and one batch. Sums per cluster are
combined on the map side, so a cluster with most of the rows costs no more than others.

A null vector, one of another length, or one with a null or non-finite component is left out. Rows that repeat count as
often as they are there; of equal draws the lower id, then the lower vector, starts first; a null id is drawn as
``null``. With fewer rows than centroids there are as many centroids as rows. An empty table gives an
empty result. Other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscape.llm.common import stored

DIMS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
LIMIT = 1 << 24
#: Coefficients are added up to these counts, coarse to fine.
LEVELS = (0, 1, 2, 4, 8, 16, 32, 64)


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Exact integer transform of each row, by butterflies, in natural order."""
    out = rows.astype(np.int64, copy=True)
    width = 1
    while width < out.shape[1]:
        pairs = out.reshape(len(out), -1, 2, width)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), -1)
        width *= 2
    return out


def coarse_first(dims: int = DIMS) -> np.ndarray:
    """Places of the coefficients by the number of sign changes of their row."""
    signs = hadamard(np.eye(dims, dtype=np.int64))
    return np.argsort((np.diff(signs, axis=1) != 0).sum(axis=1), kind="stable")


def search(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row and its squared distance, and how many coefficients were compared."""
    order = coarse_first(rows.shape[1])
    x, c = hadamard(rows)[:, order], hadamard(centroids)[:, order]
    n, k = len(x), len(c)
    # One entry for each row and centroid still in question.
    row, centre = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    bound = np.zeros(n * k, np.int64)
    least = np.full(n, np.iinfo(np.int64).max)
    leader = np.full(n, -1)
    work = 0
    for lo, hi in zip(LEVELS, LEVELS[1:]):
        bound += ((x[row, lo:hi] - c[centre, lo:hi]) ** 2).sum(axis=1)
        work += len(row) * (hi - lo)
        if hi == LEVELS[-1]:
            break
        # Entries are in row order: the first of each row's least bounds is measured to the end.
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        lowest = np.repeat(np.minimum.reduceat(bound, starts), np.diff(np.r_[starts, len(row)]))
        at = np.flatnonzero(bound == lowest)
        at = at[np.r_[True, row[at][1:] != row[at][:-1]]]
        at = at[leader[row[at]] != centre[at]]
        leader[row[at]] = centre[at]
        whole = bound[at] + ((x[row[at], hi:] - c[centre[at], hi:]) ** 2).sum(axis=1)
        work += len(at) * (LEVELS[-1] - hi)
        least[row[at]] = np.minimum(least[row[at]], whole)
        stay = bound <= least[row]
        row, centre, bound = row[stay], centre[stay], bound[stay]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    lowest = np.repeat(np.minimum.reduceat(bound, starts), np.diff(np.r_[starts, len(row)]))
    at = np.flatnonzero(bound == lowest)
    at = at[np.r_[True, row[at][1:] != row[at][:-1]]]
    return centre[at], bound[at] // rows.shape[1], work


def scaled(rows: DataFrame, vec_id: str = "vec_id", v: str = "embedding") -> DataFrame:
    """``(vec_id, x)`` of the usable vectors, ``x`` being integers."""
    wide = F.col(v).cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.coalesce(F.size(wide) == DIMS, F.lit(False)) & ~F.coalesce(F.exists(wide, odd), F.lit(False))
    whole = lambda x: F.least(F.greatest(F.floor(x * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int")
    # Clipped as doubles first: a huge one has no 64-bit floor.
    clip = lambda x: F.least(F.greatest(x, F.lit(-2.0 * LIMIT)), F.lit(2.0 * LIMIT))
    return rows.where(usable).select(F.col(vec_id).alias("vec_id"), F.transform(wide, lambda x: whole(clip(x))).alias("x"))


def _batch(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(-1, DIMS)


def nearest(spark, centroids: np.ndarray) -> Column:
    """The struct (cluster, distance) of the column x."""
    shared = spark.sparkContext.broadcast(centroids)

    @F.arrow_udf("struct<cluster:int,distance:bigint>")
    def find(vectors: pa.Array) -> pa.Array:
        if len(vectors):
            centre, distance, _ = search(_batch(vectors), shared.value)
        else:
            centre = distance = np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(centre.astype(np.int32)), pa.array(distance)], ["cluster", "distance"])

    return find(F.col("x"))


def first_centroids(rows: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``1:<vec_id>``, in that order."""
    draw = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    drawn = rows.orderBy(draw, "vec_id", "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in drawn], np.int64).reshape(-1, DIMS)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round; an empty one stays."""
    assigned = rows.select("x", nearest(rows.sparkSession, centroids)["cluster"].alias("cluster"))
    sums = [F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(DIMS)]
    out = centroids.copy()
    # One row for each centroid.
    for r in assigned.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(DIMS)]
    return out


def cluster(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` of ``scaled`` rows, and the final centroids."""
    rows = stored(rows, "walsh-rows")
    centroids = first_centroids(rows, k)
    if not len(centroids):
        empty = rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty.where(F.lit(False)), centroids
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    found = rows.select("vec_id", nearest(rows.sparkSession, centroids).alias("near"))
    return stored(found.select("vec_id", "near.*"), "walsh-assigned"), centroids


def described(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256."""
    spark = assigned.sparkSession
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    names = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    table = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    # One row for each centroid.
    per = F.broadcast(sums.join(F.broadcast(table), "cluster"))
    whole = F.broadcast(assigned.agg(F.sum("distance").alias("inertia")))
    return assigned.join(per, "cluster").crossJoin(whole).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
