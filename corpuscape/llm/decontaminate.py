"""Benchmark decontamination with suffix arrays over shards of the training texts.

An Arrow batch of documents is a shard. Its words become numbers of the benchmark's vocabulary, all other
words a stop that matches nothing. Suffixes that can't hold a whole window before a stop are left
out, which loses no match; the others are sorted into the shard's suffix array. Every suffix of every
item is looked up in it by binary search; the range found is all places of its window, in all
documents of the shard. Matches are followed on to their full length, so the longest verbatim passage
and its place come out too. Texts don't move: only the benchmark goes to the tasks, in chunks of at most
``CHUNK_BYTES``; a larger benchmark takes several passes, whose marks are joined per document.

A window is ``WINDOW`` words of an item; an item of fewer words, but not none, is one window. Null or empty text
has no words and no hits; null or empty items match nothing, and a null item id is the string "null". Rows
that repeat are treated alike; items that repeat under one id count once. Empty tables give no hits. Other
columns are left alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscape.llm.common import byte_values, fresh, stored

WINDOW = 10
#: A chunk's words and suffixes take some 60 times its bytes in each Python worker.
CHUNK_BYTES = 4 * 1024 * 1024
#: Bytes between words become spaces, A-Z become a-z; all others belong to words.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
FOUND = (
    "struct<n_words:bigint,starts:array<bigint>,ends:array<bigint>,items:array<string>,"
    "longest:bigint,longest_at:bigint,longest_item:string>"
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings in the same order."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


class Items:
    """The benchmark's words, and its suffixes cut to a window, without repeats."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        texts = [[number(w) for w in words_of(text)] for _, text in items]
        # All items with a stop behind each; suffixes point into it.
        self.flat = np.array([x for t in texts for x in [*t, 0]] or [0], np.int64)
        suffixes = defaultdict(list)
        base = 0
        for i, text in enumerate(texts):
            for at in range(max(1, len(text) - WINDOW + 1) if text else 0):
                suffixes[tuple(text[at : at + WINDOW])].append((i, base + at))
            base += len(text) + 1
        self.windows = list(suffixes.values())
        self.lengths = np.array([len(w) for w in suffixes], np.int64)
        self.low = self._padded(suffixes, 0)
        self.high = self._padded(suffixes, 2**32 - 1)

    def _padded(self, suffixes, fill: int) -> np.ndarray:
        rows = np.full((len(suffixes), WINDOW), fill, np.int64)
        for row, w in zip(rows, suffixes):
            row[: len(w)] = w
        return _keys(rows) if len(rows) else np.zeros(0, f"S{4 * WINDOW}")


def search(texts: list[bytes], items: Items) -> list[tuple]:
    """Per text (n_words, starts, ends, items, longest, longest_at, longest_item)."""
    docs = [words_of(t) for t in texts]
    n_words = np.array([len(d) for d in docs], np.int64)
    result = [[int(n), [], [], [], 0, None, None] for n in n_words]
    if not len(items.lengths):
        return result
    get = items.vocabulary.get
    # One stop behind each document, so no match runs over its end.
    flat = np.fromiter(chain.from_iterable([*[get(w, 0) for w in d], 0] for d in docs), np.int64)
    begins = np.concatenate([[0], np.cumsum(n_words + 1)])
    flat = np.concatenate([flat, np.zeros(WINDOW, np.int64)])
    stops = np.flatnonzero(flat == 0)
    runs = stops[np.searchsorted(stops, np.arange(len(flat) - WINDOW))] - np.arange(len(flat) - WINDOW)
    suffixes = np.flatnonzero(runs >= items.lengths.min())
    rows = flat[suffixes[:, None] + np.arange(WINDOW)]
    rows[np.arange(WINDOW) >= runs[suffixes][:, None]] = 0
    keys = _keys(rows) if len(rows) else np.zeros(0, f"S{4 * WINDOW}")
    order = np.argsort(keys, kind="stable")  # the suffix array
    keys, suffixes = keys[order], suffixes[order]
    first = np.searchsorted(keys, items.low, "left")
    last = np.searchsorted(keys, items.high, "right")
    marks: dict[int, list] = defaultdict(list)
    for w in np.flatnonzero(last > first):
        places = suffixes[first[w] : last[w]]
        for d, p in zip((np.searchsorted(begins, places, "right") - 1).tolist(), places.tolist()):
            marks[d].append((p, int(w)))
    for d, found in marks.items():
        found.sort()
        out, base = result[d], int(begins[d])
        names = set()
        for p, w in found:
            end = p + int(items.lengths[w])
            if out[1] and p - base <= out[2][-1]:
                out[2][-1] = max(out[2][-1], end - base)
            else:
                out[1].append(p - base)
                out[2].append(end - base)
            names.update(items.names[i] for i, _ in items.windows[w])
        out[3] = sorted(names)
        seen: set[tuple[int, int]] = set()
        for p, w in found:
            for i, q in items.windows[w]:
                if (p - 1, q - 1) not in seen:  # else part of a match that was followed already
                    n = int(items.lengths[w])
                    while flat[p + n] and flat[p + n] == items.flat[q + n]:
                        n += 1
                    if n > out[4]:
                        out[4:] = [n, p - base, items.names[i]]
                seen.add((p, q))
    return result


def _finder(shared):
    cache: list[Items] = []

    def find(texts: pa.Array) -> pa.Array:
        if not cache:
            cache.append(Items(shared.value))
        columns = list(zip(*search(byte_values(texts), cache[0]))) or [[]] * 7
        longs, names = pa.list_(pa.int64()), pa.list_(pa.string())
        kinds = [pa.int64(), longs, longs, names, pa.int64(), pa.int64(), pa.string()]
        labels = ["n_words", "starts", "ends", "items", "longest", "longest_at", "longest_item"]
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=labels)

    return find


def _merge(first: pa.Array, second: pa.Array) -> pa.Array:
    """Join what two chunks of the benchmark marked in the same documents."""
    merged = []
    for a, b in zip(first.to_pylist(), second.to_pylist()):
        spans: list[list[int]] = []
        for start, end in sorted([*zip(a["starts"], a["ends"]), *zip(b["starts"], b["ends"])]):
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([start, end])
        best = a if a["longest"] >= b["longest"] else b
        items = sorted({*a["items"], *b["items"]})
        merged.append(best | {"starts": [s for s, _ in spans], "ends": [e for _, e in spans], "items": items})
    return pa.array(merged, first.type)


def _chunks(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in chunks of bounded size; the driver holds one at a time."""
    texts = benchmark.where("text is not null").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text")
    )
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    parts = int(size // CHUNK_BYTES) + 1
    whole = texts.dropDuplicates()
    if parts == 1:
        yield [(r.item, bytes(r.text)) for r in whole.collect()]
        return
    # Twice as many as needed, so that an uneven hash leaves none over the bound by much.
    placed = stored(whole.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(2 * parts))), "benchmark")
    for i in range(2 * parts):
        yield [(r.item, bytes(r.text)) for r in placed.where(F.col("part") == i).collect()]


def find_items(docs: DataFrame, benchmark: DataFrame, into: str) -> DataFrame:
    """``docs`` with a struct ``into``, see ``FOUND``: the marked spans of words, the items that
    occur, and the longest verbatim match, its first word and its item."""
    spark = docs.sparkSession
    chunks = _chunks(benchmark)
    first, second = next(chunks), next(chunks, None)
    several, done = second is not None, 0
    for chunk in chain([first], [second] if several else [], chunks):
        shared = spark.sparkContext.broadcast(chunk)
        found: Column = F.arrow_udf(_finder(shared), FOUND)(F.col("text"))
        if not done:
            docs = docs.withColumn(into, found)
        else:
            later = fresh(docs, "later")
            merged = F.arrow_udf(_merge, FOUND)(F.col(into), F.col(later))
            docs = docs.withColumn(later, found).withColumn(into, merged).drop(later)
        done += 1
        if several:
            # Written down, so this chunk is needed no more.
            docs = stored(docs, "decontaminate")
            shared.destroy()
    return docs


def hit_words(found: str) -> Column:
    pairs = F.arrays_zip(F.col(f"{found}.starts"), F.col(f"{found}.ends"))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["starts"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any occurrence of a window, columns as they were."""
    into = fresh(docs, "found")
    return find_items(docs, benchmark, into).where(F.size(F.col(f"{into}.starts")) == 0).drop(into)
