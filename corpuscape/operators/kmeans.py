"""k-means at small and large k, nearest-centre assignment, silhouette, cluster terms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscape import constants as c
from corpuscape.functions.vectors import l2_normalize
from corpuscape.operators.centre_tree import FLAT, build_tree
from corpuscape.operators.centre_tree import nearest as nearest_in_tree
from corpuscape.operators.sampling import exact_sample
from corpuscape.runtime import BROADCAST_LIMIT, broadcast_if_small

# Distances held at once by a task while it compares a batch of rows with the centres.
BLOCK_CELLS = 4_000_000
# Distances that stay in a core's cache while training.
CACHED_CELLS = 65_536
# Training reads rows in blocks: bytes of vectors in one, and bytes that a task gathers before it cuts them into blocks.
BLOCK_BYTES = 256 * 1024
HELD_BYTES = 32 * 1024 * 1024
BLOCK_FIELDS = "cell int, n long, top double, hashes binary, vectors binary"
# Points whose sums a task sends as one row.
SENT_POINTS = 64
# Points of a silhouette sample that one broadcast holds.
SAMPLE_BLOCK = 10_000
MAX_ITERATIONS = 300
# Candidates that a turn of the spread start draws for each centre wanted; turns, and turns at most where
# copies leave a cell short of candidates.
OVERSAMPLE = 2
LEAST_TURNS = 5
MOST_TURNS = 40
# Starts and rounds on the weighted candidates, and starts on the sample of ``best_k_scan``.
STARTS = 8
SUMMARY_ROUNDS = 100
SCAN_STARTS = 4


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """An Arrow batch of equal-length vectors as a matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype("float64", copy=False).reshape(len(vectors), -1)


def squared_distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    cross = rows @ points.T
    norms = (rows**2).sum(1)[:, None] + (points**2).sum(1)[None, :]
    return np.maximum(norms - 2.0 * cross, 0.0)


def nearest_centroid(
    df: DataFrame, centres: DataFrame, v: str = "embedding", cid: str = "cluster", centre: str = "centre"
) -> DataFrame:
    """Add ``cluster`` and ``distance`` of the nearest centre; equal distances (to nine decimals)
    go to the lowest cluster id. A null vector, or one with a null or non-finite component, gets null for both.

    The rows do not move. Centres are sent to the tasks as a tree of balls, in chunks below the broadcast limit,
    and the best of each chunk is carried along, so any number of centres is searched exactly.
    """
    table = centres.select(cid, F.col(centre).cast("array<double>").alias(centre)).orderBy(cid).toPandas()
    ids = table[cid].to_numpy(dtype="int64")
    points = np.stack(table[centre].to_numpy())
    chunk = max(1, BROADCAST_LIMIT // (8 * points.shape[1]))
    # Rows without a usable vector are compared as zeros, so that batches keep their shape.
    given = F.col(v).cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = given.isNotNull() & ~F.exists(given, odd)
    vector = F.when(usable, given).otherwise(F.array_repeat(F.lit(0.0), points.shape[1]))
    best = None
    for lo in range(0, len(ids), chunk):
        found = _nearest_in(df.sparkSession, ids[lo : lo + chunk], points[lo : lo + chunk])(vector)
        best = found if best is None else F.least(best, found)
    named = df.withColumn("_best", best)
    return named.withColumns(
        {
            "cluster": F.when(usable, F.col("_best.cluster").cast("int")),
            "distance": F.when(usable, F.col("_best.distance")),
        }
    ).drop("_best")


def _nearest_in(spark, ids: np.ndarray, points: np.ndarray):
    tree = build_tree(ids, points)
    shared = spark.sparkContext.broadcast(tree)
    widest = max([len(h) for level in tree.levels for h in level.held] or [len(ids)])
    step = max(1, BLOCK_CELLS // widest)

    @F.arrow_udf("struct<distance: double, cluster: bigint>")
    def nearest(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.struct([("distance", pa.float64()), ("cluster", pa.int64())]))
        rows, tree = matrix(vectors), shared.value
        found = [nearest_in_tree(tree, rows[lo : lo + step])[:2] for lo in range(0, len(rows), step)]
        place, distance = (np.concatenate(x) for x in zip(*found))
        return pa.StructArray.from_arrays([pa.array(distance), pa.array(tree.ids[place])], ["distance", "cluster"])

    return nearest


def _vectors(df: DataFrame, v: str) -> DataFrame:
    return df.withColumn("_v", array_to_vector(F.col(v).cast("array<double>")))


def kmeans_fit(
    df: DataFrame, k: int, v: str = "embedding", seed: int = c.SEED, rounds: int = MAX_ITERATIONS, key: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """Seeded k-means: ``df`` with ``cluster``, and the centres ``(cluster, centre)``. Fewer different
    vectors than k give as many centres. The result doesn't depend on how the input is split."""
    blocks = _blocks(df.select(F.col(key).alias("key"), F.col(v).cast("array<double>").alias("vec")), seed).persist()
    centres = centre_rows(df.sparkSession, _train(blocks, {0: k}, seed, rounds))
    blocks.unpersist()
    return nearest_centroid(df.drop("cluster"), centres, v).drop("distance"), centres


def centre_rows(spark, points: np.ndarray) -> DataFrame:
    """Centres as rows ``(cluster, centre)``."""
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "cluster int, centre array<double>")


def cluster_means(df: DataFrame, v: str = "embedding") -> DataFrame:
    """Mean vector of each cluster, combined on the map side."""
    means = _vectors(df, v).groupBy("cluster").agg(Summarizer.mean(F.col("_v")).alias("m"))
    return means.select("cluster", vector_to_array("m").alias("centre"))


def kmeans_large_k(
    df: DataFrame,
    k: int = c.LARGE_K,
    v: str = "embedding",
    key: str = "id",
    seed: int = c.SEED,
    rounds: int = c.KMEANS_ROUNDS,
) -> DataFrame:
    """Centres ``(cluster, centre)`` for k in the thousands, on unit vectors.

    Every row takes part in every round. A coarse k-means splits the space into about sqrt(k) cells, each
    cell gets its share of the k centres, and a round compares a row only with the centres of its own
    cell: n * sqrt(k) distances instead of n * k, and k sums per task.
    """
    spark = df.sparkSession
    unit = _blocks(df.select(F.col(key).alias("key"), l2_normalize(F.col(v)).alias("vec")), seed).persist()
    celled, coarse_k = unit, math.isqrt(k)
    if coarse_k > 1:
        celled = _in_tree(unit, _train(unit, {0: coarse_k}, seed, rounds)).persist()
    # Copies are one vector: a cell never gets more centres than it has different rows.
    centres = centre_rows(spark, _train(celled, _allot(_distinct_rows(celled), k), seed, rounds))
    celled.unpersist()
    unit.unpersist()
    return centres


def _blocks(points: DataFrame, seed: int) -> DataFrame:
    """``(key, vec)`` as blocks of rows, all in cell 0: a round reads whole matrices, not a list for each row. A row's key stays
    as the hash that its draws follow from. Blocks are dealt over all cores, however few files the rows come from."""
    spark = points.sparkSession
    hashed = points.select(F.xxhash64("key", F.lit(seed)).alias("hash"), "vec")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Zeros lose their sign: rows are told apart by their bytes later on.
        rows = ((np.zeros(b.num_rows, "int32"), b.column(0).to_numpy(), matrix(b.column(1)) + 0.0) for b in batches if b.num_rows)
        return _packed(rows)

    return hashed.mapInArrow(pack, BLOCK_FIELDS).repartition(2 * spark.sparkContext.defaultParallelism)


def _packed(rows: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Blocks of cells, hashes and vectors: each holds rows of one cell."""
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        cells, hashes, vectors = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(cells, kind="stable")
        most = max(1, BLOCK_BYTES // (8 * vectors.shape[1]))
        cuts = np.flatnonzero(np.diff(cells[order])) + 1
        for own in np.split(order, cuts):
            for lo in range(0, len(own), most):
                part = own[lo : lo + most]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([cells[part[0]]], pa.int32()),
                        pa.array([len(part)], pa.int64()),
                        pa.array([np.fmax.reduce(np.abs(vectors[part]), axis=None, initial=0.0)]),
                        pa.array([hashes[part].tobytes()]),
                        pa.array([vectors[part].tobytes()]),
                    ],
                    names=["cell", "n", "top", "hashes", "vectors"],
                )

    for part in rows:
        held.append(part)
        size += part[2].nbytes
        if size >= HELD_BYTES:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cell, hashes and vectors of each block."""
    for batch in batches:
        for cell, n, hashes, vectors in zip(*(batch.column(x) for x in ("cell", "n", "hashes", "vectors"))):
            found = np.frombuffer(vectors.as_buffer()).reshape(n.as_py(), -1)
            yield cell.as_py(), np.frombuffer(hashes.as_buffer(), "int64"), found


def _in_tree(blocks: DataFrame, centres: np.ndarray) -> DataFrame:
    """The blocks dealt anew: a row's cell is the nearest centre."""
    tree = build_tree(np.arange(len(centres)), centres)
    shared = blocks.sparkSession.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CACHED_CELLS // min(len(centres), FLAT))
        return _packed(
            (nearest_in_tree(shared.value, x[lo : lo + step])[0].astype("int32"), hashes[lo : lo + step], x[lo : lo + step])
            for _, hashes, x in _unpacked(batches)
            for lo in range(0, len(x), step)
        )

    return blocks.mapInArrow(deal, BLOCK_FIELDS)


def _distinct_rows(blocks: DataFrame) -> dict[int, int]:
    """Different vectors of each cell."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, _, x in _unpacked(batches):
            width = 8 * x.shape[1]
            rows = pa.Array.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), cell, "int32")), rows], ["cell", "row"])

    rows = blocks.mapInArrow(each, "cell int, row binary").select("cell", F.xxhash64("row").alias("same")).distinct()
    return {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}


def _next_hash(hashes: np.ndarray, number: int) -> np.ndarray:
    """``xxhash64(..., number)`` where ``hashes`` is ``xxhash64(...)`` of the columns before it."""
    prime = [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]
    p1, p2, p3, _, p5 = np.array(prime, "uint64")
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    mixed = hashes.view("uint64") + p5 + np.uint64(4)
    mixed = turn(mixed ^ (np.full(1, number, "uint64") * p1), 23) * p2 + p3
    mixed = (mixed ^ (mixed >> np.uint64(33))) * p2
    mixed = (mixed ^ (mixed >> np.uint64(29))) * p3
    return (mixed ^ (mixed >> np.uint64(32))).view("int64")


def _train(blocks: DataFrame, share: dict[int, int], seed: int, rounds: int) -> np.ndarray:
    """Centres from all rows of the blocks, ``share`` of them in each cell: a start spread by
    distance, then Lloyd rounds until nothing moves. What passes through the driver is bounded by the
    arguments: some ten candidates for each centre, d numbers each."""
    n, top = blocks.agg(F.sum("n"), F.max("top")).first()
    # Components become integers whose sums are exact, so a mean is the same for any split of the rows.
    scale = 2.0 ** min(40, 61 - math.ceil(math.log2(max(n, 1) * max(top or 0.0, 1e-300))))
    cell_of, points = _spread_start(blocks, share, seed)
    for _ in range(rounds):
        n, sums = _exact_sums(blocks, cell_of, points, scale)
        met = n > 0
        moved = points.copy()
        moved[met] = sums[met] / (n[met] * scale)[:, None]
        settled = np.array_equal(moved, points) or np.allclose(moved, points, atol=1e-9)
        points = moved
        if settled:
            break
    return points


def _exact_sums(blocks: DataFrame, cell_of: np.ndarray, points: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows nearest to each point of their cell, and the sum of their components as integers. A task sends what it has met in
    groups of points, one row for each, so a point with most of the rows costs no more than others."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(_by_cell(cell_of, points))
    k, d = points.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_cell = shared.value
        total: dict[int, np.ndarray] = {}
        for cell, _, x in _unpacked(batches):
            own, near = by_cell[cell]
            at = np.concatenate([gaps.argmin(axis=1) for gaps in _relative_gaps(x, near)])
            # Short numbers are sorted in linear time.
            order = np.argsort(at.astype("uint16") if len(own) < 2**16 else at, kind="stable")
            numbers = np.floor(x * scale).astype("int64")[order]
            named, first = np.unique(at[order], return_index=True)
            sums = np.add.reduceat(numbers, first, axis=0)
            found = np.column_stack([np.diff([*first, len(order)]), sums])
            for group in np.unique(own[named] // SENT_POINTS).tolist():
                if group not in total:
                    total[group] = np.zeros((SENT_POINTS, d + 1), "int64")
                here = own[named] // SENT_POINTS == group
                total[group][own[named][here] % SENT_POINTS] += found[here]
        if total:
            sent = [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()])]
            yield pa.RecordBatch.from_arrays(sent, names=["group", "sums"])

    def add(parts: pa.Table) -> pa.Table:
        # One row per task.
        whole = sum(np.frombuffer(x.as_buffer(), "int64") for c in parts["sums"].chunks for x in c)
        return pa.table({"group": parts["group"].slice(0, 1), "sums": pa.array([whole.tobytes()])})

    schema = "group int, sums binary"
    added = blocks.mapInArrow(partial, schema).groupBy("group").applyInArrow(add, schema).collect()
    whole = np.zeros((-(-k // SENT_POINTS) * SENT_POINTS, d + 1), "int64")
    for group, sums in added:
        whole[group * SENT_POINTS : (group + 1) * SENT_POINTS] = np.frombuffer(sums, "int64").reshape(SENT_POINTS, -1)
    shared.unpersist()
    return whole[:k, 0], whole[:k, 1:]


def _by_cell(cell_of: np.ndarray, points: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each cell the numbers of its points and the points."""
    order = np.argsort(cell_of, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(cell_of[order])) + 1)
    return {int(cell_of[own[0]]): (own, points[own]) for own in groups}


def _relative_gaps(rows: np.ndarray, points: np.ndarray) -> Iterator[np.ndarray]:
    """Squared distances to the points less the square of the row, for some rows at a time: as many as stay in a core's cache."""
    factor, squares = -2.0 * points.T, (points**2).sum(1)
    step = max(1, CACHED_CELLS // len(points))
    for lo in range(0, len(rows), step):
        gaps = rows[lo : lo + step] @ factor
        gaps += squares
        yield gaps


def _gaps(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the nearest point. Rounded, so that a copy of a centre is at distance zero."""
    least = np.concatenate([gaps.min(axis=1) for gaps in _relative_gaps(rows, points)])
    return np.maximum(least + (rows**2).sum(1), 0.0).round(12)


def _spread_start(blocks: DataFrame, share: dict[int, int], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Starting centres ``(cell of each, centres)`` by k-means||.

    Each cell begins with one drawn row. A round then takes every row with a probability in proportion to
    its squared distance to what its cell has chosen, ``OVERSAMPLE`` rows for each centre wanted in the mean;
    the draw is a hash of the row's key and the round. Candidates, weighted by the rows nearest to
    them, are grouped cell by cell in tasks: k-means++ and Lloyd rounds from ``STARTS`` starts, lowest cost kept.
    """
    spark = blocks.sparkSession

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, hashes, x in _unpacked(batches):
            drawn = _next_hash(hashes, 0)
            ties = x[drawn == drawn.min()]
            yield _some_rows(cell, drawn.min(), ties[np.lexsort(ties.T[::-1])[:1]])

    firsts = blocks.mapInArrow(lowest, "cell int, hash long, vec array<double>")
    first = firsts.groupBy("cell").agg(F.min(F.struct("hash", "vec"))["vec"].alias("vec")).toPandas()
    first = first[first["cell"].isin(share)].sort_values("cell")
    cell_of = first["cell"].to_numpy(dtype="int64")
    points = np.stack(first["vec"].to_numpy()).astype("float64")
    wanted = np.array([share.get(i, 0) for i in range(max(share) + 1)])
    turn = 0
    while turn < LEAST_TURNS or (turn < MOST_TURNS and (np.bincount(cell_of, minlength=len(wanted)) < wanted).any()):
        turn += 1
        shared = spark.sparkContext.broadcast(_by_cell(cell_of, points))

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, float] = {}
            for cell, _, x in _unpacked(batches):
                sums[cell] = sums.get(cell, 0.0) + float(_gaps(x, shared.value[cell][1]).sum())
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.float64())], ["cell", "gap"])

        totals = blocks.mapInArrow(total, "cell int, gap double").groupBy("cell").agg(F.sum("gap").alias("gap"))
        rate = {r["cell"]: OVERSAMPLE * share[r["cell"]] / r["gap"] for r in totals.collect() if r["gap"] > 0 and r["cell"] in share}
        if not rate:
            break

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cell, hashes, x in _unpacked(batches):
                gaps = _gaps(x, shared.value[cell][1])
                drawn = _next_hash(hashes, turn) / 2.0**64 + 0.5
                taken = (gaps > 0) & (drawn < gaps * rate.get(cell, 0.0))
                if taken.any():
                    yield _some_rows(cell, 0, x[taken])

        found = blocks.mapInArrow(draw, "cell int, hash long, vec array<double>").select("cell", "vec").toPandas()
        shared.unpersist()
        if len(found):
            cell_of = np.concatenate([cell_of, found["cell"].to_numpy(dtype="int64")])
            points = np.vstack([points, np.stack(found["vec"].to_numpy())])
    # Copies among the candidates would share their weight at random.
    both = np.unique(np.column_stack([cell_of, points]), axis=0)
    cell_of, points = both[:, 0].astype("int64"), both[:, 1:]
    weight, _ = _exact_sums(blocks, cell_of, points, 0.0)
    d = points.shape[1]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, x, w in zip(*(c.to_pylist() for c in batch.columns)):
                draws = np.random.default_rng([seed, cell])
                best = best_of_starts(np.frombuffer(x).reshape(-1, d), np.frombuffer(w), share[cell], draws)
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([best.tobytes()])], ["cell", "points"])

    met = weight > 0
    cells = _by_cell(cell_of[met], np.column_stack([weight, points])[met])
    rows = [(cell, bytearray(own[:, 1:].tobytes()), bytearray(own[:, 0].tobytes())) for cell, (_, own) in cells.items()]
    # A task for each cell: adaptive execution would put them all into one.
    summary = spark.createDataFrame(rows, "cell int, points binary, weights binary").repartition(len(rows))
    chosen = {r["cell"]: np.frombuffer(r["points"]).reshape(-1, d) for r in summary.mapInArrow(settle, "cell int, points binary").collect()}
    cells = sorted(chosen)
    return np.repeat(cells, [len(chosen[x]) for x in cells]), np.vstack([chosen[x] for x in cells])


def _some_rows(cell: int, hashed: int, x: np.ndarray) -> pa.RecordBatch:
    vectors = pa.array(list(x), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays(
        [pa.array([cell] * len(x), pa.int32()), pa.array([int(hashed)] * len(x), pa.int64()), vectors], ["cell", "hash", "vec"]
    )


def best_of_starts(x: np.ndarray, w: np.ndarray, k: int, draws: np.random.Generator, starts: int | None = None) -> np.ndarray:
    """k centres of a bounded table of weighted points: the start that ends with the lowest cost."""
    best, least = None, np.inf
    for _ in range(starts or STARTS):
        centres = _plus_plus(x, w, k, draws)
        for _ in range(SUMMARY_ROUNDS):
            gaps = squared_distances(x, centres)
            at = gaps.argmin(axis=1)
            n = np.bincount(at, w, len(centres))
            sums = np.stack([np.bincount(at, w * x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
            moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-300)[:, None], centres)
            if np.allclose(moved, centres, atol=1e-9):
                break
            centres = moved
        cost = float((squared_distances(x, centres).min(axis=1) * w).sum())
        if cost < least * (1 - 1e-12):
            best, least = centres, cost
    return best


def _plus_plus(x: np.ndarray, w: np.ndarray, k: int, draws: np.random.Generator) -> np.ndarray:
    """k of the points: each next one drawn by weight times squared distance to those before, the best of
    a few such draws taken."""
    chosen = [int(draws.choice(len(x), p=w / w.sum()))]
    gaps = squared_distances(x, x[chosen]).ravel()
    tries = 2 + int(math.log(max(k, 1)))
    for _ in range(k - 1):
        mass = gaps * w
        mass[chosen] = 0.0
        if mass.sum() <= 0:
            break
        drawn = np.unique(np.searchsorted(np.cumsum(mass), draws.random(tries) * mass.sum(), side="right").clip(0, len(x) - 1))
        after = np.minimum(gaps[None, :], squared_distances(x[drawn], x))
        pick = int((after * w).sum(axis=1).argmin())
        chosen.append(int(drawn[pick]))
        gaps = after[pick]
    return x[chosen].copy()


def _allot(sizes: dict[int, int], k: int) -> dict[int, int]:
    """Split k centres over cells by size, at least one each, never more than a cell has rows; what rounding down leaves over
    goes to the largest remainders."""
    total = sum(sizes.values())
    k = min(k, total)
    given = {cell: max(1, k * n // total) for cell, n in sizes.items()}
    short = [cell for cell, n in sizes.items() if k * n >= total and k * n % total]
    short.sort(key=lambda x: (-(k * sizes[x] % total), x))
    for cell in short[: max(0, k - sum(given.values()))]:
        given[cell] += 1
    return given


# --- quality ------------------------------------------------------------------------------


def _silhouettes(df: DataFrame, v: str, labels: str, sample: DataFrame) -> Column:
    """Per row one silhouette value for each labelling in the array column ``labels``.

    ``sample`` holds the points to compare with. They go to the tasks in blocks; distances are summed
    per cluster by one matrix product, for all labellings together: no pair of rows becomes a row.
    """
    table = sample.select(v, labels).toArrow()
    points = matrix(table.column(v).combine_chunks())
    given = matrix(table.column(labels).combine_chunks()).astype("int64")
    member, slots = [], []
    for j in range(given.shape[1]):
        names, inverse = np.unique(given[:, j], return_inverse=True)
        slots.append({int(n): len(member) + i for i, n in enumerate(names)})
        member.extend((inverse == i).astype("float64") for i in range(len(names)))
    columns = np.stack(member, axis=1)
    sizes = columns.sum(axis=0)
    context = df.sparkSession.sparkContext

    def block_sums(lo: int):
        shared = context.broadcast((points[lo : lo + SAMPLE_BLOCK], columns[lo : lo + SAMPLE_BLOCK]))

        @F.arrow_udf("array<double>")
        def sums(vectors: pa.Array) -> pa.Array:
            near, member = shared.value
            rows = matrix(vectors)
            step = max(1, BLOCK_CELLS // len(near))
            out = [np.zeros((0, member.shape[1]))]
            for at in range(0, len(rows), step):
                gaps = np.sqrt(squared_distances(rows[at : at + step], near))
                gaps[gaps < 1e-7] = 0.0
                out.append(gaps @ member)
            return pa.array(list(np.concatenate(out)), pa.list_(pa.float64()))

        return sums(F.col(v).cast("array<double>"))

    total = None
    for lo in range(0, len(points), SAMPLE_BLOCK):
        part = block_sums(lo)
        total = part if total is None else F.zip_with(total, part, lambda a, b: a + b)

    @F.arrow_udf("array<double>")
    def scores(totals: pa.Array, labellings: pa.Array) -> pa.Array:
        sums, own = matrix(totals), matrix(labellings).astype("int64")
        out, at = np.zeros(own.shape), np.arange(len(own))
        for j, slot in enumerate(slots):
            cols = np.array(sorted(slot.values()))
            mine = np.array([slot[int(x)] for x in own[:, j]], dtype="int64")
            inside = sums[at, mine] / np.maximum(sizes[mine] - 1, 1)
            means = sums[:, cols] / sizes[cols]
            means[at, mine - cols[0]] = np.inf
            outside = means.min(axis=1)
            value = (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-300)
            out[:, j] = np.where(sizes[mine] > 1, value, 0.0)
        return pa.array(list(out), pa.list_(pa.float64()))

    return scores(total, F.col(labels))


def silhouette_score(
    df: DataFrame,
    v: str = "embedding",
    method: str = "exact",
    sample: int = c.SILHOUETTE_SAMPLE,
    seed: int = c.SEED,
    key: str = "id",
) -> DataFrame:
    """Mean silhouette of ``cluster``. ``exact`` uses Euclidean distances on a drawn sample;
    ``squared`` is MLlib's squared-Euclidean form, linear in the rows of the whole table. The two
    are different numbers. The sample may have any size; its points go to the tasks in blocks."""
    if method == "squared":
        scorer = ClusteringEvaluator(featuresCol="_v", predictionCol="cluster")
        value = scorer.evaluate(_vectors(df, v))
        return df.sparkSession.createDataFrame([(round(value, 6),)], "silhouette double")
    labelled = df.select(key, F.col(v), F.array("cluster").alias("labels"))
    drawn = exact_sample(labelled, sample, seed, key)
    scored = drawn.select(_silhouettes(drawn, v, "labels", drawn)[0].alias("s"))
    return scored.agg(F.round(F.avg("s"), 6).alias("silhouette"))


def best_k_scan(
    df: DataFrame,
    v: str = "embedding",
    k_min: int = c.K_RANGE[0],
    k_max: int = c.K_RANGE[1],
    sample: int = c.SILHOUETTE_SAMPLE,
    seed: int = c.SEED,
    key: str = "id",
) -> DataFrame:
    """``(k, silhouette, best)`` for each k on one drawn sample; the smaller k wins a tie.

    Distances do not depend on k, so one pass scores all labellings.
    """
    # A sample of bounded size, sent to the tasks; each k is fitted in a task of its own.
    drawn = exact_sample(df.select(key, F.col(v).cast("array<double>").alias("x")), sample, seed, key).orderBy(key).toPandas()
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(np.stack(drawn["x"].to_numpy()))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = shared.value
        for batch in batches:
            for k in batch["k"]:
                centres = best_of_starts(x, np.ones(len(x)), int(k), np.random.default_rng([seed, int(k)]), SCAN_STARTS)
                yield pd.DataFrame({"k": [k], "labels": [squared_distances(x, centres).argmin(axis=1).astype("int32")]})

    # Large k first: they take longest.
    ks = spark.createDataFrame([(k,) for k in range(k_max, k_min - 1, -1)], "k int").repartition(k_max - k_min + 1, "k")
    fits = ks.mapInPandas(fit, "k int, labels array<int>").toPandas().sort_values("k")
    labels = np.stack(fits["labels"].to_numpy(), axis=1)
    table = pa.table({"x": pa.array(list(shared.value), pa.list_(pa.float64())), "labels": pa.array(list(labels), pa.list_(pa.int32()))})
    labelled = spark.createDataFrame(table).persist()
    scores = labelled.select(F.posexplode(_silhouettes(labelled, "x", "labels", labelled)).alias("pos", "s"))
    summed = scores.groupBy((F.col("pos") + k_min).alias("k")).agg(F.round(F.avg("s"), 6).alias("silhouette")).toPandas()
    labelled.unpersist()
    # One row per k.
    return mark_best(spark.createDataFrame(summed, "k int, silhouette double"))


def mark_best(scores: DataFrame) -> DataFrame:
    """Flag the row with the highest score, the smallest k among equals. One row per k."""
    order = Window.orderBy(F.desc("silhouette"), "k")
    return scores.withColumn("best", F.row_number().over(order) == 1)


# --- terms --------------------------------------------------------------------------------


def component_term_join(centres: DataFrame, components: DataFrame, bound: int | None = None) -> DataFrame:
    """Centres in a reduced space back in term space: ``(cluster, term, weight)`` from
    ``(cluster, component, value)`` and ``(component, term, value)``.

    Centres are k times the number of components, ``bound`` if that is known, so they are the side
    to broadcast.
    """
    left = broadcast_if_small(centres.select("cluster", "component", F.col("value").alias("a")), rows=bound)
    joined = components.select("component", "term", F.col("value").alias("b")).join(left, "component")
    return joined.groupBy("cluster", "term").agg(F.sum(F.col("a") * F.col("b")).alias("weight"))


def top_terms_per_cluster(weights: DataFrame, k: int = c.TERMS_PER_CLUSTER, digits: int = 9) -> DataFrame:
    """The k heaviest terms of each cluster with their rank; equal weights in term order."""
    order = Window.partitionBy("cluster").orderBy(F.desc(F.round("weight", digits)), "term")
    ranked = weights.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)
