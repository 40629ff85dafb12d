"""Session settings, size checks and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT = 256 * 1024 * 1024
BATCH_BYTES = 8 * 1024 * 1024
# The folder of the innermost open block of temporary tables.
_OPEN_SCOPE: ContextVar[str | None] = ContextVar("open_scope", default=None)


def local_session(cpus: int | str = "*", app: str = "corpuscape") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    cores = 8 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.corpuscape.spread", str(2 * cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df`` in bytes; runs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_if_small(df: DataFrame, rows: int | None = None, row_bytes: int = 64) -> DataFrame:
    """Ask for a broadcast only where the size is known to fit.

    ``rows`` is a proven upper bound on the row count (a limit, a number of clusters). Without
    one Catalyst's estimate decides. Beyond the limit the join falls back to a shuffle, where
    adaptive execution splits skewed partitions.
    """
    size = rows * row_bytes if rows is not None else plan_bytes(df)
    return F.broadcast(df) if size <= BROADCAST_LIMIT else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a table over as many tasks as the session asks for in ``spark.corpuscape.spread``; without
    that setting it keeps the splits of its files."""
    tasks = df.sparkSession.conf.get("spark.corpuscape.spread", None)
    return df.repartition(int(tasks), key) if tasks else df


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``. A temporary one is set only
    where none is named and everything runs on this machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="corpuscape-")
    context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the shared folder."""
    return f"{_OPEN_SCOPE.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there.

    The plan starts anew, each row is computed once, the result survives lost executors, and Catalyst
    knows its true size: a checkpoint would keep the estimate, which multiplies in loops of joins.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A step of a loop, stored."""
    return stored(df)


def cut_and_count(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """A step of a loop, stored, and how many of its rows fulfil ``what`` (all without it), counted
    while they are written: a loop learns whether it is done without another job."""
    seen = Observation()
    met = F.count(F.lit(1)) if what is None else F.count_if(what)
    table = stored(df.observe(seen, met.alias("n")))
    return table, seen.get["n"]


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is stored inside the block is deleted when it ends, but for the tables that are passed
    through the function the block gets. Tables read lazily after the block must be passed through it."""
    outer = _OPEN_SCOPE.get()
    folder = scratch_path(spark, "scope")
    token = _OPEN_SCOPE.set(folder)

    def keep(df: DataFrame) -> DataFrame:
        inner = _OPEN_SCOPE.set(outer)
        try:
            return stored(df, "kept")
        finally:
            _OPEN_SCOPE.reset(inner)

    try:
        yield keep
    finally:
        _OPEN_SCOPE.reset(token)
        delete_scratch(spark, folder)


@contextmanager
def session_setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting that holds inside the block only."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def side_by_side(spark: SparkSession):
    """Inside the block the partitions of a union are tasks of their own: Spark would put those of equally dealt tables
    together, one of each table to a task."""
    return session_setting(spark, "spark.sql.unionOutputPartitioning", "false")


def small_batches(spark: SparkSession):
    """What runs inside the block hands Python at most about ``BATCH_BYTES`` at once, for each task: Spark's own limit is 64 MB,
    of which the JVM, the worker and the worker's objects hold a copy each."""
    return session_setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def delete_scratch(spark: SparkSession, folder: str) -> None:
    """Remove a folder that ``scratch_path`` has named."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame) -> DataFrame:
    """Let adaptive execution merge small partitions and split large ones. Unions in a loop would
    otherwise add up partitions round by round."""
    return df.hint("rebalance")
