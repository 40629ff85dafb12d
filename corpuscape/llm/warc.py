"""WARC archives: written with revisit records, read back by boundary-chain verification.

``write_archive`` writes one record per page. Of pages with equal payloads of ``MIN_SHARED`` bytes or more
the one with the largest ``page_id`` is a response record, the others are revisit records that name it and carry
no payload. Each record ends with an empty line twice, as the format wants, so Spark's text
writer with that separator makes the files; its committer leaves whole files only, whatever task is lost.
Larger payloads are written with fewer records a file, so files are bounded in bytes; a payload above
``FILE_BYTES`` is a file by itself.

``read_archive`` doesn't trust the magic string, which may stand inside a payload. Tasks take every
place where it occurs as a candidate and emit its offset with that of its successor, computed from
the header. The first record starts at 0; pointer jumping doubles the reach of every pointer in each
round, so that after log2(records per file) rounds exactly the records of the chain are marked.

Null html is an empty payload. A null page id is written empty and read as null; a null url is left out. Of
rows with equal payload all that have the largest page id are responses, the others revisit that id.
An empty table gives no records. Other columns are left out. A file cut short or damaged yields the records
up to the damage.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscape.llm.common import NO_ID, stored
from corpuscape.runtime import broadcast_if_small

MIN_SHARED = 1000
RECORDS_PER_FILE = 2_000
FILE_BYTES = 512 * 1024 * 1024
#: Fixed values of the format.
MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

CANDIDATE = (
    "file string, offset long, successor long, size long, record_type string, page_id long, url string, "
    "payload_bytes long, payload_digest string, sound boolean, refers_to long"
)


def choose_originals(pages: DataFrame) -> DataFrame:
    """(digest, original) of payloads that occur more than once and are long enough."""
    marked = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("id"), payload(F.col("html")).alias("p")
    )
    return (
        marked.where(F.octet_length("p") >= MIN_SHARED)
        .groupBy(F.sha1("p").alias("digest"))
        .agg(F.max("id").alias("original"), F.count("*").alias("copies"))
        .where("copies > 1")
        .select("digest", "original")
    )


def payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def write_archive(pages: DataFrame, path: str) -> None:
    """Write ``pages(page_id, url, html)``."""
    originals = stored(choose_originals(pages), "warc-shared")
    groups = originals.count()
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "").alias("url"),
        payload(F.col("html")).alias("p"),
    ).withColumn("digest", F.sha1("p"))
    few = broadcast_if_small(originals, rows=groups, row_bytes=100)
    joined = rows.join(few, "digest", "left")
    is_original = F.col("original").isNull() | (F.col("id") == F.col("original"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.when(c != NO_ID, c.cast("string")).otherwise(""), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    block = F.concat(F.lit(HTTP), F.when(is_original, F.col("p").cast("string")).otherwise(""))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(is_original, F.lit("response")).otherwise("revisit")),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.when(F.col("url") == "", "").otherwise(line("WARC-Target-URI", F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.octet_length("p").cast("string")),
        F.when(is_original, "").otherwise(line("WARC-Refers-To", name(F.col("original")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    # Classes of size, each four times the one before, with a quarter of the records in a file.
    least = FILE_BYTES // RECORDS_PER_FILE
    steps = F.ceil(F.log(F.octet_length("p") / least) / F.log(F.lit(4.0)))
    tier = F.when(F.octet_length("p") <= least, 0).otherwise(F.greatest(steps, F.lit(1))).cast("int")
    lines = joined.select(F.concat(head, block).alias("value"), tier.alias("tier"))
    # Payloads have less than 2 GB: eight classes at most.
    used = [r["tier"] for r in rows.select(tier.alias("tier")).distinct().orderBy("tier").collect()] or [0]
    for i in used:
        some = lines.where(F.col("tier") == i).select("value") if len(used) > 1 else lines.select("value")
        records = max(1, RECORDS_PER_FILE // 4**i)
        some.write.mode("append").option("lineSep", END).option("maxRecordsPerFile", records).text(path)


_FIELD = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)\r\n")
_ID = re.compile(rb"<urn:page:(-?\d+)>")


def _candidates(name: str, data: bytes) -> Iterator[tuple]:
    at = data.find(MAGIC)
    while at >= 0:
        head_end = data.find(b"\r\n\r\n", at)
        fields = {} if head_end < 0 else {k.lower(): v for k, v in _FIELD.findall(data, at, head_end + 2)}
        length = fields.get(b"content-length", b"")
        if length.isdigit():
            block = head_end + 4
            stop = block + int(length)
            kind = fields.get(b"warc-type", b"").decode("latin-1")
            if stop + 4 <= len(data) and data[stop : stop + 4] == END.encode():
                body = data.find(b"\r\n\r\n", block, stop)
                content = data[body + 4 : stop] if body >= 0 else data[block:stop]
                digest = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("latin-1")
                size = fields.get(b"x-payload-length", b"")
                size = int(size) if size.isdigit() else len(content)
                sound = kind == "revisit" or hashlib.sha1(content).hexdigest() == digest and len(content) == size
                own = _ID.fullmatch(fields.get(b"warc-record-id", b""))
                other = _ID.fullmatch(fields.get(b"warc-refers-to", b""))
                number = lambda m: int(m[1]) if m else None
                url = fields.get(b"warc-target-uri")
                url = url.decode("utf-8", "replace") if url is not None else None
                yield (name, at, stop + 4, len(data), kind, number(own), url, size, digest, sound, number(other))
        at = data.find(MAGIC, at + 1)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), *[pa.int64()] * 3, pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64()]
    names = [x.split()[0] for x in CANDIDATE.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            rows = list(_candidates(batch.column("path")[i].as_py(), batch.column("content")[i].as_py()))
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def reachable(pointers: DataFrame) -> DataFrame:
    """(file, offset) of the records of each file's chain; ``pointers(file, offset, successor)``."""
    known = pointers.select("file", "offset")
    # Pointers to what is no candidate lead nowhere.
    jumps = stored(
        pointers.join(known.withColumnRenamed("offset", "successor"), ["file", "successor"]).select(
            "file", "offset", "successor"
        ),
        "warc-jumps",
    )
    reached = stored(known.where("offset = 0"), "warc-reached")
    count = reached.count()
    while True:
        ahead = reached.join(jumps, ["file", "offset"]).select("file", F.col("successor").alias("offset"))
        reached = stored(reached.union(ahead).distinct(), "warc-reached")
        now = reached.count()
        if now == count:
            return reached
        count = now
        far = jumps.select("file", F.col("offset").alias("successor"), F.col("successor").alias("further"))
        jumps = stored(
            jumps.join(far, ["file", "successor"]).select("file", "offset", F.col("further").alias("successor")),
            "warc-jumps",
        )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files in ``path``: see ``CANDIDATE``. ``sound`` tells whether the digest in
    the header is that of the payload."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = stored(files.mapInArrow(_scan, CANDIDATE), "warc-candidates")
    chain = reachable(found.select("file", "offset", "successor"))
    return found.join(chain, ["file", "offset"])
