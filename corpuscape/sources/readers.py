"""Reading document dumps, stage tables and word lists."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuscape.functions.text import fill_defaults, parse_json_line
from corpuscape.operators.cuts import nth_smallest

#: Tasks that read footers, at most; each opens its files one after the other.
FOOTER_TASKS = 4096
FOOTER_NAMES = "path row_group column kind n_rows n_values n_nulls bytes_stored bytes_plain lowest highest".split()
FOOTER_FIELDS = (
    "path string, row_group int, column string, kind string, n_rows long, n_values long, n_nulls long,"
    " bytes_stored long, bytes_plain long, lowest string, highest string"
)
FOOTER_KINDS = [pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]
DUMP_FIELDS = {"id": "string", "title": "string", "text": "string"}


def scan_jsonl_dir(spark: SparkSession, path: str) -> DataFrame:
    """Documents from every file below ``path``, one JSON object per line.

    Blank lines and lines that are not a JSON object are skipped; a missing or null title or
    text is empty. Ids stay the text that they are, numbers or not. One pass, no schema inference.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return parse_documents(lines, "value")


def parse_documents(lines: DataFrame, line: str = "value") -> DataFrame:
    """The parse step of ``scan_jsonl_dir`` over any column of JSON lines."""
    trimmed = lines.where(F.trim(line) != "")
    docs = trimmed.select(parse_json_line(F.col(line), DUMP_FIELDS).alias("doc"))
    docs = docs.where(F.col("doc").isNotNull())
    return docs.select(
        "doc.id",
        fill_defaults(F.col("doc.title")).alias("title"),
        fill_defaults(F.col("doc.text")).alias("text"),
    )


def scan_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A stage table. A given schema is checked against the file footers by the reader."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def scan_parquet_columns(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """Only the named columns; Catalyst prunes the rest from the parquet scan."""
    return spark.read.parquet(path).select(*cols)


def _footer_rows(path: str, found: pq.FileMetaData) -> list[tuple]:
    """A row per row group and column of one file; a row without a group where the file has none."""
    if not found.num_row_groups:
        return [(path, None, n, None, 0, 0, 0, 0, 0, None, None) for n in found.schema.names]
    rows = []
    for g in range(found.num_row_groups):
        group = found.row_group(g)
        for c in range(group.num_columns):
            chunk = group.column(c)
            known = chunk.statistics if chunk.is_stats_set else None
            # Numbers alone: extents of texts may be cut by the writer.
            exact = known is not None and known.has_min_max and chunk.physical_type in ("INT32", "INT64", "FLOAT", "DOUBLE")
            nulls = known.null_count if known is not None and known.has_null_count else None
            ends = (str(known.min_raw), str(known.max_raw)) if exact else (None, None)
            sizes = (chunk.total_compressed_size, chunk.total_uncompressed_size)
            rows.append((path, g, chunk.path_in_schema, chunk.physical_type, group.num_rows, chunk.num_values, nulls, *sizes, *ends))
    return rows


def read_footers(spark: SparkSession, path: str) -> DataFrame:
    """Row groups and column chunks of a table as its files' footers state them; no page is read.

    One row per file, row group and leaf column: rows, values, nulls, bytes as stored and as plain, and of numeric columns the
    extent as text (null without statistics). Files are dealt to tasks one by one, and each task opens the footers of its own
    by Arrow. Where Arrow can't open the path's file system, Spark reads the files whole (each must be below 2 GB).
    A file without row groups has one row per column with a null group.
    """
    files = spark.read.parquet(path).inputFiles()
    try:
        fs.FileSystem.from_uri(files[0])
        names = spark.createDataFrame([(f,) for f in files], "path string")
        dealt = names.repartition(min(len(files), FOOTER_TASKS))
    except (ValueError, OSError, ImportError):
        dealt = spark.read.format("binaryFile").load([unquote(f) for f in files]).select("path", "content")

    def opened(path: str, content: bytes | None):
        if content is not None:
            return pa.BufferReader(content)
        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, *content in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(path, *content or [None]) as file:
                    named = path if content else unquote(path)
                    columns = zip(*_footer_rows(named, pq.ParquetFile(file).metadata))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FOOTER_KINDS)], FOOTER_NAMES)

    return dealt.mapInArrow(read, FOOTER_FIELDS)


def path_below(file: Column, path: str) -> Column:
    """The path of a file below the folder that holds the table ``path``, as it is on disk."""
    root = path.rstrip("/").rpartition("/")[2]
    return F.regexp_replace(file, "^.*/(?=" + re.escape(root) + "(/|$))", "")


def table_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Rows, row groups, stored bytes and columns per file of a table; files by their path below it. Read from the footers."""
    names = ",".join(spark.read.parquet(path).columns)
    group = F.struct("row_group", "n_rows")
    files = read_footers(spark, path).groupBy("path").agg(
        F.collect_set(group).alias("groups"), F.sum("bytes_stored").alias("n_bytes")
    )
    return files.select(
        path_below(F.col("path"), path).alias("file"),
        F.aggregate("groups", F.lit(0).cast("long"), lambda n, g: n + g["n_rows"]).alias("n_rows"),
        F.size(F.filter("groups", lambda g: g["row_group"].isNotNull())).alias("n_row_groups"),
        "n_bytes",
        F.lit(names).alias("columns"),
    )


def column_extents(spark: SparkSession, path: str) -> DataFrame:
    """Per leaf column its values, nulls, and of integer columns the extent, from the footers alone.

    A count or extent is null where a row group doesn't state it (an extent: unless the group is all null)."""
    whole = F.col("kind").isin("INT32", "INT64")
    stated = F.col("lowest").isNotNull() | (F.col("n_nulls") == F.col("n_values"))
    end = lambda of, name: F.when(F.bool_and(whole & stated), of(F.col(name).try_cast("long")))
    return read_footers(spark, path).groupBy("column").agg(
        F.sum("n_values").alias("n_values"),
        F.when(F.count("n_nulls") == F.count("*"), F.sum("n_nulls")).alias("n_nulls"),
        end(F.min, "lowest").alias("lowest"),
        end(F.max, "highest").alias("highest"),
    )


def load_stopwords(spark: SparkSession, path: str, lower: bool = True) -> DataFrame:
    """Distinct trimmed words of a text file, one per line.

    Tokens are compared in lower case, so the list is lower-cased too unless ``lower`` is off.
    """
    return clean_word_list(spark.read.text(path), "value", lower)


def clean_word_list(words: DataFrame, col: str, lower: bool = True) -> DataFrame:
    word = F.trim(F.col(col))
    word = F.lower(word) if lower else word
    return words.select(word.alias("word")).where(F.col("word") != "").distinct()


def first_fraction(df: DataFrame, frac: float = 0.5, order: str = "id") -> DataFrame:
    """The first ``floor(frac * N)`` rows in order of the unique key ``order``."""
    keep = math.floor(frac * df.count())
    if keep < 1:
        return df.where(F.lit(False))
    return df.where(F.col(order) <= nth_smallest(df.select(order), keep))
