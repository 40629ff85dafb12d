"""Repeated passages by prefix-free parsing and suffix sorting.

Every byte that lies in a string of ``LENGTH`` bytes which also starts in a document with a smaller id is
removed. Documents are parsed where a rolling hash triggers: of the strings of ``GRAM`` bytes in a window of
``LENGTH`` the one with the smallest hash is the window's trigger, so equal windows have equal triggers. The windows
that follow each other with one trigger form a phrase of at most 2 * LENGTH - GRAM bytes, and every window lies in
exactly one phrase. The parse of a document is its row of phrases; the dictionary holds the distinct ones.

1. Tasks parse their texts and send the triggers' hashes, a few bytes each, to buckets. A bucket knows
   which triggers occur twice; windows of all others can't repeat.
2. Chunks of documents are parsed again. Phrases with shared triggers go to the chunk's dictionary with the
   smallest document of each; a phrase that an earlier document of the chunk has is settled there.
3. Dictionary entries meet in buckets by trigger. The suffixes of the phrases that hold a whole window are sorted,
   which brings equal windows next to each other, and with the first document of each phrase (the
   parse) that gives the first document of each window.
4. What is settled goes back to the chunks, where the bytes are cut.

Texts move by chunk, twice; buckets and chunks have a bounded size in bytes, and a phrase that a third of all
documents hold reaches its bucket once a chunk. Strings are judged on the input, all comparisons are of bytes.

Null text is empty; texts shorter than ``LENGTH`` stay whole. Documents of equal id don't count as earlier
than each other; null ids are one id below all others. Very long texts are parsed in segments that
overlap. Empty tables give empty results. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscape.llm.common import NO_ID, byte_values, stored

LENGTH = 50
GRAM = 20
#: Text bytes of a chunk and of what a bucket gathers the triggers for, and of a block parsed at once.
CHUNK_BYTES = 8 * 1024 * 1024
BUCKET_BYTES = 2 * 1024 * 1024
BLOCK = 1 << 19
#: Rows whose triggers a task sorts at once.
PIECE_ROWS = 2_500

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    out = np.empty(2 * BLOCK, np.uint64)
    out[0] = 1
    have = 1
    while have < len(out):
        out[have : 2 * have] = out[:have] * np.uint64(pow(base, have, 1 << 64))
        have *= 2
    return out


_tables: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _phrases(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of segments that end at ``ends``: first and last window start, hash of the trigger."""
    if not _tables:
        _tables.extend((_powers(_BASE), _powers(_INVERSE)))
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.astype(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(data * _tables[0][:n], out=sums[1:])
    grams = (sums[GRAM:] - sums[:-GRAM]) * _tables[1][: n - GRAM + 1]
    order = grams * np.uint64(0x9E3779B97F4A7C15)
    order ^= order >> np.uint64(32)
    order *= np.uint64(0xD6E8FEB86659FD93)
    bits = n.bit_length()
    order &= np.uint64((1 << 64) - (1 << bits))
    order |= np.arange(len(order), dtype=np.uint64)  # the leftmost of equals
    wide, width = order, 1
    window = LENGTH - GRAM + 1
    while 2 * width <= window:
        wide = np.minimum(wide[:-width], wide[width:])
        width *= 2
    wide = np.minimum(wide[: n - LENGTH + 1], wide[window - width :][: n - LENGTH + 1])
    trigger = (wide & np.uint64((1 << bits) - 1)).astype(np.int64)
    # Windows must end inside their segment.
    edge = np.zeros(n + 1, np.int32)
    begins = np.concatenate([[0], ends[:-1]])
    long = ends - begins >= LENGTH
    np.add.at(edge, begins[long], 1)
    np.add.at(edge, ends[long] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[: n - LENGTH + 1]) > 0)
    if not len(at):
        return none, none, none.astype(np.uint64)
    fresh = np.flatnonzero((np.diff(at) > 1) | (np.diff(trigger[at]) != 0)) + 1
    first = at[np.concatenate([[0], fresh])]
    last = at[np.concatenate([fresh, [len(at)]]) - 1]
    return first, last, _mix(grams[trigger[first]] + np.uint64(1))


def parse(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of phrases: document number, first and last window start in it, hash of the trigger."""
    pieces: list[tuple[int, int, bytes]] = []
    held = 0

    def block():
        data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        ends = np.cumsum([len(p) for _, _, p in pieces])
        first, last, hashes = _phrases(data, ends)
        which = np.searchsorted(ends, first, "right")
        begins = ends - [len(p) for _, _, p in pieces]
        shift = np.array([o for _, o, _ in pieces]) - begins
        docs = np.array([d for d, _, _ in pieces])
        return docs[which], first + shift[which], last + shift[which], hashes

    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), BLOCK):
            piece = text[at : at + BLOCK + LENGTH - 1]
            if pieces and held + len(piece) > BLOCK:
                yield block()
                pieces, held = [], 0
            pieces.append((number, at, piece))
            held += len(piece)
    if pieces:
        yield block()


def _packed(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers in ``width`` bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _schema(*binary: str, **longs) -> pa.Schema:
    return pa.schema([*[(n, pa.int64()) for n in longs], *[(n, pa.binary()) for n in binary]])


class Plan:
    """Numbers that follow from the size of the input: the same rule for all sizes."""

    def __init__(self, total: int):
        self.chunks = total // CHUNK_BYTES + 1
        self.buckets = total // BUCKET_BYTES + 1
        # Bits for which one trigger in thousands meets another by accident; that costs time only.
        self.width = min(8, math.ceil((math.log2(total + 2) + 8) / 8))

    def short(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - 8 * self.width)

    def bucket(self, short: np.ndarray) -> np.ndarray:
        return (_mix(short) % np.uint64(self.buckets)).astype(np.int64)


#: kind 0: hashes with the chunk of each, a question to the bucket; 1: hashes that a chunk is told of,
#: known to be shared without asking, which only pass through.
TRIGGERS = _schema("hashes", "chunks", kind=1, bucket=1, chunk=1)


def _send_triggers(plan: Plan):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS):
                yield batch.slice(at, PIECE_ROWS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            chunk = batch.column("chunk").to_numpy()
            found = [(plan.short(h), d) for d, _, _, h in parse(byte_values(batch.column("text")))]
            if not found:
                continue
            short, docs = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((docs, short))
            short, docs = short[order], docs[order]
            new = np.ones(len(short), bool)
            new[1:] = (short[1:] != short[:-1]) | (docs[1:] != docs[:-1])
            short, docs = short[new], docs[new]
            if not len(short):
                continue
            head = np.concatenate([[True], short[1:] != short[:-1]])
            tail = np.concatenate([head[1:], [True]])
            rows = []
            many = ~(head & tail)
            for c in np.unique(chunk[docs[many]]):
                own = np.unique(short[many & (chunk[docs] == c)])
                rows.append((1, int(c) % plan.buckets, int(c), _packed(own, plan.width), b""))
            once, home = short[head], chunk[docs[head]]
            bucket = plan.bucket(once)
            order = np.argsort(bucket, kind="stable")
            once, home, bucket = once[order], home[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0, [True]]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                rows.append((0, int(bucket[a]), -1, _packed(once[a:b], plan.width), home[a:b].astype("<u4").tobytes()))
            yield from _table(TRIGGERS, rows).to_batches()

    return send


SHARED = _schema("hashes", chunk=1)


def _shared_triggers(plan: Plan):
    def shared(table: pa.Table) -> pa.Table:
        asked = np.array(table.column("kind").to_pylist()) == 0
        told = table.filter(pa.array(~asked)).select(["chunk", "hashes"]).to_pylist()
        told = [(r["chunk"], r["hashes"]) for r in told]
        rows = table.filter(pa.array(asked))
        if not rows.num_rows:
            return _table(SHARED, told)
        short = np.concatenate([_unpacked(x, plan.width) for x in rows.column("hashes").to_pylist()])
        chunk = np.concatenate([np.frombuffer(x, "<u4") for x in rows.column("chunks").to_pylist()])
        found, inverse, counts = np.unique(short, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        short, chunk = short[again], chunk[again]
        order = np.argsort(chunk, kind="stable")
        short, chunk = short[order], chunk[order]
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(chunk.astype(np.int64)) != 0, [True]])) if len(chunk) else [0]
        out = [(int(chunk[a]), _packed(np.unique(short[a:b]), plan.width)) for a, b in zip(cuts[:-1], cuts[1:])]
        return _table(SHARED, out + told)

    return shared


ENTRIES, SPANS, PLACES, LATE = range(4)
#: By kind: dictionary entries (number, first document, length, bytes); spans that are settled (document, start,
#: end); where entries occur (number, document, start); windows of entries that come late (number, from, to).
PHRASES = _schema("a", "b", "c", "d", kind=1, chunk=1, bucket=1)
#: Texts of a chunk from one task: ids, lengths, bytes and their number before compression.
TEXTS = _schema("ids", "lengths", "data", chunk=1, size=1)


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one chunk in one compressed row: they move at half the size."""
    for batch in batches:
        chunk = batch.column("chunk").to_numpy()
        ids, texts = batch.column("id").to_numpy(), byte_values(batch.column("text"))
        order = np.argsort(chunk, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(chunk[order]) != 0, [True]])) if len(order) else [0]
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = order[a:b]
            lengths = np.array([len(texts[i]) for i in own], "<i8")
            data = b"".join(texts[i] for i in own)
            packed = pa.compress(data, codec="zstd", asbytes=True) if data else b""
            rows.append((int(chunk[own[0]]), len(data), ids[own].astype("<i8").tobytes(), lengths.tobytes(), packed))
        yield from _table(TEXTS, rows).to_batches()


def _in_order(docs: pa.Table) -> tuple[list[int], list[bytes]]:
    """Ids and texts of a chunk in an order that doesn't depend on how rows arrive."""
    rows: list[tuple[int, bytes]] = []
    for r in docs.to_pylist():
        data = pa.decompress(r["data"], r["size"], codec="zstd", asbytes=True) if r["size"] else b""
        ends = np.cumsum(np.frombuffer(r["lengths"], "<i8")).tolist()
        texts = [data[a:b] for a, b in zip([0, *ends], ends)]
        rows.extend(zip(np.frombuffer(r["ids"], "<i8").tolist(), texts))
    rows.sort()
    return [i for i, _ in rows], [t for _, t in rows]


def _send_phrases(plan: Plan):
    def send(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows or not replies.num_rows:
            return _table(PHRASES, [])
        chunk = docs.column("chunk")[0].as_py()
        known = np.unique(np.concatenate([_unpacked(x, plan.width) for x in replies.column("hashes").to_pylist()]))
        ids, texts = _in_order(docs)
        entries: dict[bytes, int] = {}
        firsts: list[int] = []
        triggers: list[int] = []
        spans: list[tuple] = []
        places: list[tuple] = []
        for doc, first, last, hashes in parse(texts):
            short = plan.short(hashes)
            at = np.minimum(np.searchsorted(known, short), len(known) - 1)
            hit = known[at] == short
            for d, a, b, h in zip(doc[hit].tolist(), first[hit].tolist(), last[hit].tolist(), short[hit].tolist()):
                phrase = texts[d][a : b + LENGTH]
                number = entries.setdefault(phrase, len(firsts))
                if number == len(firsts):
                    firsts.append(ids[d])
                    triggers.append(h)
                if firsts[number] < ids[d]:
                    spans.append((d, a, b + LENGTH))
                else:
                    places.append((number, d, a))
        rows = []
        for kind, found in ((SPANS, spans), (PLACES, places)):
            blobs = [np.array(x, "<u4").tobytes() for x in (zip(*found) if found else [[]] * 3)]
            rows.append((kind, chunk, chunk % plan.buckets, *blobs, b""))
        if firsts:
            phrases = list(entries)
            bucket = plan.bucket(np.array(triggers, np.uint64))
            # By bucket, then by content, which compresses better.
            order = np.array(sorted(range(len(phrases)), key=lambda i: (bucket[i], phrases[i])), np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
            owner = np.array(firsts, "<i8")
            for x, y in zip(cuts[:-1], cuts[1:]):
                own = order[x:y]
                held = [phrases[i] for i in own]
                lengths = np.array([len(p) for p in held], "<u2").tobytes()
                packed = pa.compress(b"".join(held), codec="zstd", asbytes=True)
                rows.append((ENTRIES, chunk, int(bucket[own[0]]), own.astype("<u4").tobytes(), owner[own].tobytes(), lengths, packed))
        return _table(PHRASES, rows)

    return send


def first_documents(data: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each window of ``LENGTH`` bytes the smallest document of all equal windows."""
    windows = np.ascontiguousarray(data[starts[:, None] + np.arange(LENGTH)]).view(f"S{LENGTH}").ravel()
    order = np.argsort(windows, kind="stable")  # the suffix array of the dictionary, whole windows only
    ranked = windows[order]
    heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    least = np.minimum.reduceat(docs[order], heads)
    out = np.empty(len(docs), np.int64)
    out[order] = np.repeat(least, np.diff(np.concatenate([heads, [len(docs)]])))
    return out


def _settle(rows: pa.Table) -> pa.Table:
    """Per chunk the windows of its entries that an earlier document holds; other rows pass through."""
    ask = np.array(rows.column("kind").to_pylist()) == ENTRIES
    others, rows = rows.filter(pa.array(~ask)), rows.filter(pa.array(ask))
    if not rows.num_rows:
        return others.cast(PHRASES)
    columns = [rows.column(c).to_pylist() for c in "abcd"]
    number, owner, length = (np.concatenate([np.frombuffer(x, t) for x in c]) for c, t in zip(columns, ("<u4", "<i8", "<u2")))
    length = length.astype(np.int64)
    chunk = np.repeat(rows.column("chunk").to_numpy(), [len(x) // 4 for x in columns[0]])
    sizes = [int(np.frombuffer(x, "<u2").sum(dtype=np.int64)) for x in columns[2]]
    data = b"".join(pa.decompress(x, n, codec="zstd", asbytes=True) for x, n in zip(columns[3], sizes))
    data = np.frombuffer(data, np.uint8)
    begin = np.cumsum(length) - length
    count = length - LENGTH + 1
    entry = np.repeat(np.arange(len(count)), count)
    offset = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
    first = first_documents(data, begin[entry] + offset, owner[entry])
    late = np.flatnonzero(first < owner[entry])
    if not len(late):
        return others.cast(PHRASES)
    # Runs of windows within an entry.
    cut = np.flatnonzero((np.diff(late) > 1) | (np.diff(entry[late]) != 0)) + 1
    a = late[np.concatenate([[0], cut])]
    b = late[np.concatenate([cut, [len(late)]]) - 1]
    own, start, end = entry[a], offset[a], offset[b] + LENGTH
    order = np.argsort(chunk[own], kind="stable")
    own, start, end = own[order], start[order], end[order]
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(chunk[own]) != 0, [True]]))
    out = []
    for x, y in zip(cuts[:-1], cuts[1:]):
        blobs = [v[x:y].astype("<u4").tobytes() for v in (number[own], start, end)]
        out.append((LATE, int(chunk[own[x]]), 0, *blobs, b""))
    return pa.concat_tables([others.cast(PHRASES), _table(PHRASES, out)])


RESULT = pa.schema(
    [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]
)


def _cut(keep_bytes: bool):
    def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table(RESULT, [])
        ids, texts = _in_order(docs)
        spans: list[list] = [[] for _ in ids]
        numbers = lambda row: [np.frombuffer(row[c], "<u4").astype(np.int64) for c in "abc"]
        rows = found.select(["kind", "a", "b", "c"]).to_pylist()
        sets: list[np.ndarray] = [np.stack(numbers(r)) for r in rows if r["kind"] == SPANS]
        places = [numbers(r) for r in rows if r["kind"] == PLACES]
        late = [numbers(r) for r in rows if r["kind"] == LATE]
        if places and late:
            number, doc, at = (np.concatenate(x) for x in zip(*places))
            key, start, end = (np.concatenate(x) for x in zip(*late))
            order = np.argsort(number, kind="stable")
            number, doc, at = number[order], doc[order], at[order]
            low, high = np.searchsorted(number, key, "left"), np.searchsorted(number, key, "right")
            count = high - low
            which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            sets.append(np.stack([doc[which], at[which] + np.repeat(start, count), at[which] + np.repeat(end, count)]))
        if sets:
            doc, start, end = np.concatenate(sets, axis=1)
            order = np.lexsort((start, doc))
            for d, a, b in zip(doc[order].tolist(), start[order].tolist(), end[order].tolist()):
                own = spans[d]
                if own and a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
        out = []
        for i, text, own in zip(ids, texts, spans):
            kept, last = [], 0
            for a, b in own:
                kept.append(text[last:a])
                last = b
            rest = b"".join([*kept, text[last:]])
            value = rest if keep_bytes else hashlib.sha256(rest).hexdigest().encode()
            out.append((i, len(text), len(text) - len(rest), len(own), value))
        return _table(RESULT, out)

    return cut


def remove_repeats(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of ``docs(doc_id, text)``. ``kept`` is what remains, as
    bytes, since a span may cut a character; without ``keep_bytes`` its SHA-256 in hexadecimal."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    plan = Plan(int(total))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(own.alias("id"), F.pmod(F.xxhash64(own), F.lit(plan.chunks)).alias("chunk"), "text")
    ddl = lambda s: ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in s)
    packed = rows.mapInArrow(_pack_texts, ddl(TEXTS)).groupBy("chunk")
    sent = rows.mapInArrow(_send_triggers(plan), ddl(TRIGGERS))
    shared = sent.groupBy("bucket").applyInArrow(_shared_triggers(plan), ddl(SHARED))
    phrases = packed.cogroup(shared.groupBy("chunk")).applyInArrow(_send_phrases(plan), ddl(PHRASES))
    found = stored(phrases.groupBy("bucket").applyInArrow(_settle, ddl(PHRASES)), "repeat-found")
    result = packed.cogroup(found.groupBy("chunk")).applyInArrow(_cut(keep_bytes), ddl(RESULT))
    return result.withColumn("doc_id", F.when(F.col("id") != NO_ID, F.col("id"))).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept"
    )
