"""Conversations whose turns follow each other as (system?) (user assistant)+, repaired at least cost.

Edits: a row is kept (K, 0), given the role user or assistant (R, 1) or deleted (D, 2); an empty row of role user or
assistant is inserted (I, 5) anywhere. Blank rows and rows that repeat an earlier one must be deleted; a row that breaks
off costs 5 more unless it is deleted. The result is a conversation without rows, or one that fits the pattern.

Method: weighted interval parsing. Every span of rows has a cell for each symbol of a grammar in Chomsky normal form:
the least (cost, audit) that turns the span into a run of roles of that kind, the audit being the letters of the edits.
A span's cells come from those of its two parts by the rules, and are closed under insertions on either side. Spans
of one row come first, then longer ones, up to ``BLOCK`` rows by all their splits. The symbols are the kinds of
factors of the pattern, by first and last role: whatever a span turns into is split by any cut into two factors, so
longer spans need one cut only, and double in length: time and memory grow with the conversation, not with its square or cube.
Equal costs go to the audit that is least in ASCII. Two audits of one cell and cost are never one the
start of the other (the longer one would have paid for insertions), so the least of a span is made of the least of its parts.

A conversation may hold any share of the rows. Rows are ordered by key ranges of (conversation, turn, role, digest of the
text), so a large one lies in many tasks; each parses its run, and cells of runs are joined afterwards, a few
rows for each range. Texts don't take part: only the kind of each row does. ``repaired_rows`` streams sorted rows past the
audits, one conversation after the other, without holding any.

Rows go by turn, nulls first; rows of one turn by role, then by the digest of their text, equal ones next to each other.
Null roles and texts are a single space; null conversations are one conversation. An empty table gives an empty
result. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscape.llm.common import stored

COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
BROKEN = 5
BLOCK = 8
SPACES = " \t\n\x0b\x0c\r"
#: Symbols: the empty run, and runs by their first and last role (system, user, assistant).
SYMBOLS = ("", "ss", "su", "sa", "uu", "ua", "au", "aa")
#: Pairs of roles that may follow each other.
FOLLOWS = ("su", "ua", "au")
#: Symbols a whole conversation may have.
WHOLE = ("", "sa", "ua")
#: Rules: symbol and symbol give symbol.
RULES = [
    (x, y, (x[:1] or y[:1]) + (y[1:] or x[1:]))
    for x in SYMBOLS
    for y in SYMBOLS
    if not x or not y or (x[1] + y[0] in FOLLOWS and y[0] != "s")
]

Cells = dict[str, tuple[int, str]]


def _join(left: Cells, right: Cells) -> Cells:
    out: Cells = {}
    for x, y, z in RULES:
        if x in left and y in right:
            (a, p), (b, q) = left[x], right[y]
            new = (a + b, p + q)
            if z not in out or new < out[z]:
                out[z] = new
    return out


def _least(cells: Cells, others: Cells) -> Cells:
    out = dict(cells)
    for z, new in others.items():
        if z not in out or new < out[z]:
            out[z] = new
    return out


def _closed(cells: Cells) -> Cells:
    """Cells after insertions on either side, until none gets better."""
    while True:
        more = _least(_least(cells, _join(INSERTED, cells)), _join(cells, INSERTED))
        if more == cells:
            return cells
        cells = more


INSERTED: Cells = {"": (0, ""), "uu": (COSTS["I"], "I"), "aa": (COSTS["I"], "I")}
EMPTY = _closed(INSERTED)


def row_cells(kind: str) -> Cells:
    """Cells of one row. Its kind is the initial of its role, ``o`` for others; a capital if it breaks off; ``-`` if it
    must be deleted."""
    cells: Cells = {"": (COSTS["D"], "D")}
    if kind != "-":
        more, role = (BROKEN, kind.lower()) if kind.isupper() else (0, kind)
        cells |= {"uu": (COSTS["R"] + more, "R"), "aa": (COSTS["R"] + more, "R")}
        if role != "o":
            cells[role * 2] = (COSTS["K"] + more, "K")
    return _closed(cells)


@lru_cache(maxsize=50_000)
def _block(kinds: str) -> tuple[tuple[str, tuple[int, str]], ...]:
    n = len(kinds)
    chart = {(i, i + 1): row_cells(k) for i, k in enumerate(kinds)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cells: Cells = {}
            for cut in range(i + 1, i + length):
                cells = _least(cells, _join(chart[i, cut], chart[cut, i + length]))
            chart[i, i + length] = _closed(cells)
    return tuple(chart[0, n].items())


def span_cells(kinds: str) -> Cells:
    """Cells of a span of rows."""
    spans = [dict(_block(kinds[at : at + BLOCK])) for at in range(0, len(kinds), BLOCK)] or [EMPTY]
    return join_spans(spans)


def join_spans(spans: list[Cells]) -> Cells:
    """Cells of spans that lie side by side, pair by pair."""
    while len(spans) > 1:
        pairs = [_closed(_join(spans[i], spans[i + 1])) for i in range(0, len(spans) - 1, 2)]
        spans = pairs + spans[len(pairs) * 2 :]
    return spans[0]


def best(cells: Cells) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation."""
    return min(cells[z] for z in WHOLE if z in cells)


def misfits(initials: str) -> int:
    """Adjacent pairs that may not follow each other."""
    return sum(a + b not in FOLLOWS for a, b in zip(initials, initials[1:]))


# --- rows ---------------------------------------------------------------------------------


def ordered_rows(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, digest, text, n, kind, initial, fault)``: equal rows once with their number; the fault is
    that of the first of them, and the others repeat it."""
    clean = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    keys = ["conv_id", "turn", "role", "digest"]
    once = clean.groupBy(*keys).agg(F.count("*").alias("n"), F.first("text").alias("text"))
    once = stored(once, "repair-rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    told = once.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("at"), F.count("*").alias("turns"))
    # Only what is said in several turns; rows that aren't in it are no repetition.
    told = told.where("turns > 1").select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "at"
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    inked = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = (
        F.when(F.length(inked) == 0, "blank")
        .when(F.col("at").isNotNull() & (place != F.col("at")), "duplicate")
        .when(~F.right(inked, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault").isNull(), initial).otherwise(F.upper(initial))
    joined = once.join(told, same, "left").drop("c", "r", "d").withColumn("fault", fault)
    return joined.select(*keys, "text", "n", kind.alias("kind"), initial.alias("initial"), "fault")


RUN = (
    "conv_id long, part int, place int, whole boolean, illegal long, head string, tail string, symbols array<string>, "
    "costs array<long>, audits array<string>"
)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a sorted task: its cells, and whether it lies in this task alone."""
    from pyspark import TaskContext

    part, place, open_run = TaskContext.get().partitionId(), 0, None

    def row(run: tuple, whole: bool) -> dict:
        conv, kinds, initials = run[0], "".join(run[1]), "".join(run[2])
        cells = span_cells(kinds)
        if whole:
            # Nothing else can be joined to it.
            cost, audit = best(cells)
            cells = {"": (cost, audit)}
        return {
            "conv_id": conv, "part": part, "place": place, "whole": whole, "illegal": misfits(initials),
            "head": initials[0], "tail": initials[-1], "symbols": list(cells),
            "costs": [c for c, _ in cells.values()], "audits": [a for _, a in cells.values()],
        }

    out: list[dict] = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "n", "kind", "initial")]
        for conv, own in groupby(zip(*columns), key=lambda r: r[0]):
            kinds, initials = [], []
            for _, n, kind, initial in own:
                kinds.append(kind + "-" * (n - 1))
                initials.append(initial * n)
            if open_run is not None and open_run[0] == conv:
                open_run[1].extend(kinds)
                open_run[2].extend(initials)
                continue
            if open_run is not None:
                # The first run of a task may have begun in another one.
                out.append(row(open_run, place > 0))
                place += 1
            open_run = (conv, kinds, initials)
        if out:
            yield pa.RecordBatch.from_pylist(out, RUN_ARROW)
            out = []
    if open_run is not None:
        yield pa.RecordBatch.from_pylist([row(open_run, False)], RUN_ARROW)


RUN_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int32()), ("whole", pa.bool_()), ("illegal", pa.int64()),
        ("head", pa.string()), ("tail", pa.string()), ("symbols", pa.list_(pa.string())), ("costs", pa.list_(pa.int64())),
        ("audits", pa.list_(pa.string())),
    ]
)


def _join_runs(runs: pd.DataFrame) -> pd.DataFrame:
    """The runs of one conversation in the tasks it lies in: at most one for each task."""
    runs = runs.sort_values("part")
    spans = [dict(zip(s, zip(map(int, c), a))) for s, c, a in zip(runs["symbols"], runs["costs"], runs["audits"])]
    cost, audit = best(join_spans(spans))
    borders = sum(a + b not in FOLLOWS for a, b in zip(runs["tail"].iloc[:-1], runs["head"].iloc[1:]))
    found = {"conv_id": runs["conv_id"].iloc[:1], "illegal": int(runs["illegal"].sum()) + borders, "cost": cost, "audit": audit}
    return pd.DataFrame(found).astype({"conv_id": "Int64"})


def parsed(rows: DataFrame) -> DataFrame:
    """``(conv_id, illegal, cost, audit)`` of ``ordered_rows``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", "turn", "role", "digest"]
    ranged = rows.select(*keys, "n", "kind", "initial").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    runs = stored(ranged.mapInArrow(_runs, RUN), "repair-runs")
    whole = runs.where("whole").select("conv_id", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    split = runs.where("not whole").groupBy("conv_id").applyInPandas(
        _join_runs, "conv_id long, illegal long, cost long, audit string"
    )
    return stored(whole.unionByName(split), "repair-audits")


def walk(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired rows (role, text). The letters leave one role for each place."""
    last = None
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if last == "u" else "user"
        last = role[:1]
        yield role, text


def _streamed(rows: DataFrame, audits: DataFrame, take, schema: str) -> DataFrame:
    """Send each conversation's rows in order past its audit: sorted within a task, never held."""
    text = F.lit(None).cast("string")
    heads = audits.select(
        "conv_id", F.lit(0).alias("tag"), F.lit(None).cast("long").alias("turn"), text.alias("role"), text.alias("digest"),
        text.alias("text"), F.lit(1).cast("long").alias("n"), "audit",
    )
    body = rows.select("conv_id", F.lit(1).alias("tag"), "turn", "role", "digest", "text", "n", text.alias("audit"))
    dealt = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "tag", "turn", "role", "digest")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "n")])

        for conv, own in groupby(cells(), key=lambda r: r[0]):
            _, audit, _, _, _ = next(own)
            repeated = ((role, text) for _, _, role, text, n in own for _ in range(n))
            yield from take(conv, walk(audit, repeated))

    return dealt.mapInArrow(stream, schema)


def repaired_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``(conv_id, place, role, text)`` after the edits."""
    names = ["conv_id", "place", "role", "text"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def take(conv, repaired):
        some = []
        for i, (role, text) in enumerate(repaired):
            some.append((conv, i, role, text))
            if len(some) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)

    return _streamed(rows, audits, take, "conv_id long, place long, role string, text string")


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)``: of the repaired ``role:text``, joined by newlines."""

    def take(conv, repaired):
        total, between = hashlib.sha256(), b""
        for role, text in repaired:
            total.update(between + f"{role}:{text}".encode())
            between = b"\n"
        columns = [pa.array([conv], pa.int64()), pa.array([total.hexdigest()])]
        yield pa.RecordBatch.from_arrays(columns, ["conv_id", "repaired_sha256"])

    return _streamed(rows, audits, take, "conv_id long, repaired_sha256 string")


def faults(rows: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated)`` of ``ordered_rows``."""
    is_fault = lambda name: F.when(F.col("fault") == name, 1).otherwise(0)
    again = F.when(F.col("fault") == "blank", 0).otherwise(F.col("n") - 1)
    turns = rows.groupBy("conv_id", "turn").agg(
        F.sum(is_fault("blank") * F.col("n")).alias("blank"),
        F.sum(is_fault("duplicate") + again).alias("duplicate"),
        F.sum(is_fault("truncated")).alias("truncated"),
    )
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    )


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows in order (``ordered_rows``), and per conversation gaps, blank, duplicate, truncated, illegal, cost,
    audit."""
    ordered = stored(ordered_rows(rows), "repair-ordered")
    audits, counts = parsed(ordered), faults(ordered)
    audits = audits.withColumnRenamed("conv_id", "c")
    found = counts.join(audits, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return ordered, stored(found, "repair-found")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 removes its ``[.!?]``,
    3 repeats it, 4 sets its role to user. Nulls are one space."""
    given = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", given("role").alias("role"), given("text").alias("text"), way.alias("way"))
    marked = marked.where("way <> 0")
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("way") == 3, 2).otherwise(1)))
    out = marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy"))
    return out.drop("copy")

