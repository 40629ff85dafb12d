"""Token-id files: Parquet list columns with delta encoding, bounded row groups and page indexes.

``encode_files`` turns texts into ids with a public tokenizer and writes one row per document in
ascending order of ``doc_id``: the id, the number of ids, the place among the ids of its file and
the list of ids. Integers are delta encoded (data pages of version 2), the file number is dictionary
encoded, row groups and pages are bounded and carry column and offset indexes, so a reader takes
``n_tokens`` without touching the lists and a range of documents without the other pages.
``read_index`` reads only the small columns, ``read_tokens`` all of them.

Null text is an empty text: its row holds the end id alone. Rows of equal ``doc_id`` stand next to each
other in the order of their texts; null ids come first. An empty table gives no files of rows and an
empty result. Other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpuscape.runtime import broadcast_if_small

ROW_GROUP_BYTES = 32 * 1024 * 1024
PAGE_BYTES = 256 * 1024
PAGE_ROWS = 2_000
#: Bytes of text that a task encodes at once; a longer text is encoded alone.
SLICE_BYTES = 8 * 1024 * 1024
#: Pieces that a worker remembers; beyond that it forgets all and goes on.
KEPT_PIECES = 1_000_000
#: Pieces that are given to the tokenizer as one text.
JOINED = 500
#: Punctuation behind a word of letters, a piece by itself.
TAIL = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

FILE_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("start_in_part", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.IntegerType(), False)),
    ]
)


@cache
def encoder(path: str) -> PieceEncoder:
    """One for each Python worker, so that what it remembers serves all its tasks."""
    return PieceEncoder(path)


class PieceEncoder:
    """Ids of texts for a tokenizer that drops white space and ignores case.

    Such a tokenizer never joins pieces over white space, so a text's ids are those of its words in
    order, and most words come again and again. Arrow splits the texts and numbers their different words; a
    word of letters with punctuation behind it is two pieces; each piece is encoded once. Texts that hold a special
    token of the tokenizer as a literal are given to it whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        words = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(words.values()) + 1, bool)
        self.closes[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([""], pa.string())
        self.ids = np.zeros(0, np.int32)
        self.sizes = np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in found]

    def _learn(self, pieces: pa.StringArray, simple: bool) -> None:
        """Simple pieces end in a token that closes a word and have no other such token: many are encoded
        as one text and cut there."""
        ids, sizes = [self.ids], [self.sizes]
        for at in range(0, len(pieces), JOINED):
            some = pieces.slice(at, JOINED).to_pylist()
            found = self._whole([" ".join(some)])[0] if simple else None
            ends = np.flatnonzero(self.closes[found]) + 1 if simple else np.zeros(0)
            if len(ends) == len(some) and ends[-1] == len(found):
                ids.append(found)
                sizes.append(np.diff(ends, prepend=0))
            else:
                parts = self._whole(some)
                ids.extend(parts)
                sizes.append(np.array([len(x) for x in parts], np.int64))
        self.known = pa.concat_arrays([self.known, pieces])
        self.ids, self.sizes = np.concatenate(ids), np.concatenate(sizes)

    def _numbers(self, pieces: pa.StringArray, simple: np.ndarray) -> np.ndarray:
        """Places of the pieces in what is known, after learning those that aren't."""
        coded = pc.dictionary_encode(pieces)
        codes, found = coded.indices.to_numpy(), coded.dictionary
        lone = np.zeros(len(found), bool)
        lone[codes] = simple
        if len(self.known) > KEPT_PIECES:
            self._forget()
        new = pc.is_null(pc.index_in(found, value_set=self.known)).to_numpy(zero_copy_only=False)
        for kind in (True, False):
            missing = found.filter(pa.array(new & (lone == kind)))
            if len(missing):
                self._learn(missing, kind)
        return pc.index_in(found, value_set=self.known).to_numpy().astype(np.int64)[codes]

    def _pieces(self, words: pa.StringArray) -> np.ndarray:
        """Numbers of the two pieces of each word; the second is often the empty one."""
        # Others keep their case: a capital and its mark can compose to another letter than the small one, and
        # capitals are no special token.
        small, lower = pc.string_is_ascii(words), pc.ascii_lower(words)
        for literal in self.specials:
            small = pc.and_not(small, pc.match_substring(lower, literal))
        words = pc.if_else(small, lower, words)
        stems = pc.utf8_rtrim(words, characters=TAIL)
        stem_size = pc.binary_length(stems).to_numpy()
        cut = pc.binary_length(words).to_numpy() - stem_size
        simple = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False) | (stem_size == 0)
        # Of other than ASCII words, those that stay letters alone when composed and in lower case.
        other = np.flatnonzero(simple & ~pc.string_is_ascii(stems).to_numpy(zero_copy_only=False))
        simple[other] = [is_normalized("NFC", w) and "\u0130" not in w for w in stems.take(pa.array(other)).to_pylist()]
        heads = pc.if_else(pa.array(simple), stems, words)
        cut = np.where(simple, cut, 0).astype(np.int64)
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        tails = pa.StringArray.from_buffers(
            len(words),
            pa.py_buffer(np.concatenate([[0], np.cumsum(cut)]).astype(np.int32)),
            pa.py_buffer(_gather(data, ends - cut, cut)),
        )
        both = self._numbers(pa.concat_arrays([heads, tails]), np.concatenate([simple, np.ones(len(words), bool)]))
        return both.reshape(2, -1)

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of texts without nulls, each closed by ``end_id``."""
        special = np.zeros(len(texts), bool)
        for literal in self.specials:
            special |= pc.match_substring(texts, literal).to_numpy(zero_copy_only=False)
        alone = [self._whole([x])[0] for x in texts.filter(pa.array(special)).to_pylist()]
        if alone:
            texts = pc.if_else(pa.array(special), "", texts)
        split = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(split.values)
        pieces = self._pieces(coded.dictionary)
        sizes, ids = self.sizes, self.ids
        starts = np.cumsum(sizes) - sizes
        # One list of ids for each different word, then the end id, then the texts that were encoded alone.
        two = pieces.T.ravel()
        n_words = sizes[pieces].sum(axis=0)
        table = np.concatenate([_gather(ids, starts[two], sizes[two]), [end_id], *alone]).astype(np.int32)
        lengths = np.concatenate([n_words, [1], [len(x) for x in alone]]).astype(np.int64)
        offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        order = coded.indices.to_numpy().astype(np.int64)
        if alone:
            order = np.insert(order, offsets[1:][special], len(n_words) + 1 + np.arange(len(alone)))
            offsets = offsets + np.concatenate([[0], np.cumsum(special)])
        order = np.insert(order, offsets[1:], len(n_words))
        offsets = offsets + np.arange(len(offsets))
        flat = _gather(table, (np.cumsum(lengths) - lengths)[order], lengths[order])
        before = np.concatenate([[0], np.cumsum(lengths[order])])
        return np.diff(before[offsets]), flat


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one behind the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield at, to
        at = to


def _rows(tokenizer: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, encode_slice = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for lo, hi in _slices(texts):
                n, flat = encode_slice(texts.slice(lo, hi - lo).cast(pa.string()), end_id)
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(np.full(len(n), part, np.int32)),
                        pa.array(start + ends - n),
                        pa.array(n),
                        lists,
                    ],
                    names=FILE_SCHEMA.names,
                )
                start += int(ends[-1])

    return encode


def encode_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write the ids of ``docs(doc_id, text)`` to ``path``; ``tokenizer`` is a file of the
    tokenizers library that every executor has."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    (
        ordered.mapInArrow(_rows(tokenizer, end_id), FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#part", "true")
        .option("parquet.block.size", str(ROW_GROUP_BYTES))
        .option("parquet.page.size", str(PAGE_BYTES))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the files; ``select`` prunes those that aren't wanted."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """Per file the number of ids in the files before it; reads two small columns."""
    totals = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file, so the window's single task stays small.
    return totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and n_tokens, without reading any list."""
    return _placed(read_tokens(spark, path), spark, path).select("doc_id", "start", "n_tokens")


def _placed(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = broadcast_if_small(part_starts(spark, path), rows=parts)
    return rows.join(starts, "part").withColumn("start", F.col("before") + F.col("start_in_part"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            lists = batch.column("tokens")
            offsets = lists.offsets.to_numpy()
            ids = memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])]
            lengths = np.diff(offsets).astype(np.int64)
            columns = [batch.column(c) for c in ("doc_id", "part", "start_in_part")]
            columns += [pa.array(lengths), pa.array(np.array(sums, np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"]
    schema = ", ".join(f"{n} {'int' if n == 'part' else 'long'}" for n in names)
    summed = read_tokens(spark, path).mapInArrow(check, schema)
    return _placed(summed, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
