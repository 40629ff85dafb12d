"""Archives and quotation links against brute force; stages of the pipeline on awkward rows and none."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuscape.llm import quotes, warc
from corpuscape.runtime import scratch_path
from tests.llm import awkward


def counted(rows):
    return Counter(map(repr, rows))


# --- archives -----------------------------------------------------------------------------

LONG = "<html>" + "a line of text\r\n" * 90 + "</html>"
#: A payload that holds a whole record, and one that holds half of one.
INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (1, "http://a", LONG),
    (2, "http://b", LONG),
    (3, None, LONG + "!"),
    (4, "u", None),
    (5, "u", ""),
    (6, "u", "short"),
    (7, "u", "short"),
    (8, "u\r\nX: 1", INNER * 3),
    (9, "u", "x" * 2000 + INNER + "WARC/1.1\r\nContent-Length: 99999\r\n\r\n"),
    (10, "u", "É" * 600),
    (11, "u", "É" * 600),
    (12, "v", "\r\n\r\n" * 400),
    (2, "http://b", LONG),
    (None, "n", LONG),
    (13, "u", "WARC/1.1\r\n"),
    (14, "big", "z" * 3_000_000),
]
PAGE_SCHEMA = "page_id long, url string, html string"


def brute_archive():
    body = lambda h: (h or "").encode()
    largest, first = {}, {}
    for i, _, h in PAGES:
        d = hashlib.sha1(body(h)).hexdigest()
        largest[d] = max(largest.get(d, -1), -1 if i is None else i)
    out, done = [], set()
    for i, _, h in PAGES:
        d = hashlib.sha1(body(h)).hexdigest()
        n = len(body(h))
        revisit = n >= 1000 and i != largest[d]
        out.append((i, n, d, "revisit" if revisit else "response", largest[d] if revisit else None))
    return out


@pytest.mark.parametrize("per_file", [3, 2000])
def test_archive_round_trip(spark, monkeypatch, per_file):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", per_file)
    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA).withColumn("digest", F.lit("x")).coalesce(2)
    path = scratch_path(spark, "archive")
    warc.write_archive(pages, path)
    rows = warc.read_archive(spark, path).collect()
    assert all(r.sound for r in rows)
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert counted(found) == counted(brute_archive())


def test_empty_archive(spark):
    path = scratch_path(spark, "archive")
    warc.write_archive(spark.createDataFrame([], PAGE_SCHEMA), path)
    assert warc.read_archive(spark, path).count() == 0


def test_chain_leaves_false_starts_out(spark):
    pointers = [("f", 0, 10), ("f", 10, 30), ("f", 15, 30), ("f", 30, 40), ("f", 35, 36), ("g", 5, 9), ("h", 0, 7), ("h", 8, 9)]
    frame = spark.createDataFrame(pointers, "file string, offset long, successor long")
    found = {tuple(r) for r in warc.reachable(frame).collect()}
    assert found == {("f", 0), ("f", 10), ("f", 30), ("h", 0)}


# --- quotation links ----------------------------------------------------------------------

CHAT = [
    (1, 0, "user", "How do I boil  an egg?\nIt is my first."),
    (1, 1, "assistant", "Put it in water.\n\nWait nine minutes."),
    (1, 2, "user", "> how do I boil an egg?\nAny egg?"),
    (1, 3, "assistant", ">> How do I boil an egg?\n> Any egg?\nYes, any."),
    (1, 4, "user", "> Wait nine\n> minutes.\nSo long?"),
    (1, 5, "user", "> nobody said this\nHm."),
    (1, 6, "user", "Thanks."),
    (1, 7, "user", ">Thanks.\r\n> Put it in water.\r\n> Wait nine minutes.\r\nBye"),
    (2, 5, "user", None),
    (2, 9, "user", ""),
    (2, 9, "user", ""),
    (2, 11, "assistant", "> How do I boil an egg?"),
    (None, 1, "user", "a"),
    (None, None, "user", "b\n>c"),
    (3, 1, "user", "Same."),
    (3, 2, "user", "Same."),
    (3, 3, "user", "> Same.\nx"),
    (3, 4, None, "> x\n\n> Same.\ny"),
]
CHAT_SCHEMA = "conv_id long, turn long, role string, text string"


def brute_links(rows):
    """Distinct (conv, turn) only."""
    norm = lambda t: re.sub(r"\s+", " ", t.lower()).strip()
    lines = lambda t: re.split(r"\r?\n", t or "")
    quoted = lambda x: re.match(r"(?:[ \t]*>)+", x)
    body = lambda t: "\n".join(x for x in lines(t) if not quoted(x)).strip()
    origin, parent, found = {}, {}, {}
    for c, t, _, x in sorted(rows, key=lambda r: r[1]):
        own = body(x)
        for part in [own, *re.split(r"\n\s*\n", own), *own.split("\n")]:
            if norm(part):
                origin.setdefault((c, norm(part)), t)
    for c, t, _, x in rows:
        passages, last = [], None
        for line in lines(x):
            m = quoted(line)
            level = m[0].count(">") if m else 0
            if level and level == last:
                passages[-1][1].append(norm(line[m.end() :]))
            elif level:
                passages.append((level, [norm(line[m.end() :])]))
            last = level
        votes = Counter()
        for level, parts in passages:
            parts = [p for p in parts if p]
            for key in ([" ".join(parts)] if parts else []) + parts:
                o = origin.get((c, key))
                if o is not None and o < t:
                    votes[level, o] += len(key)
        if votes:
            found[c, t] = min(votes, key=lambda k: (k[0], -votes[k], -k[1]))[1]
    by_conv = {}
    for c, t, _, _ in sorted(rows, key=lambda r: r[1]):
        by_conv.setdefault(c, []).append(t)
    for c, turns in by_conv.items():
        for before, t in zip([None, *turns], turns):
            parent[c, t] = found.get((c, t), before)
    branch, position, answered = {}, {}, set()
    for c, turns in by_conv.items():
        for t in turns:
            p = parent[c, t]
            if p is not None and (c, p) not in answered:
                answered.add((c, p))
                branch[c, t], position[c, t] = branch[c, p], position[c, p] + 1
            else:
                branch[c, t], position[c, t] = t, 0
    return [(c, t, r, parent[c, t], (c, t) in found, branch[c, t], position[c, t], body(x)) for c, t, r, x in rows]


def test_quote_links(spark):
    plain = [r for r in CHAT if None not in r[:2] and r[:2] != (2, 9)]
    frame = spark.createDataFrame(CHAT, CHAT_SCHEMA).withColumn("branch", F.lit(1)).withColumn("conv", F.lit("x"))
    rows = quotes.link_quotes(frame).collect()
    assert len(rows) == len(CHAT)
    found = [(r.conv_id, r.turn, r.role, r.parent_turn, r.quoted, r.branch_turn, r.position, r.text) for r in rows]
    expected = brute_links(plain + [(2, 9, "user", "")])
    assert counted(f for f in found if f[0] is not None) == counted([*expected, expected[-1]])
    by = {(r.conv_id, r.turn): r for r in rows}
    assert [by[1, t].parent_turn for t in range(8)] == [None, 0, 0, 2, 1, 4, 5, 1]
    assert by[None, 1].parent_turn is None and by[None, 1].position == 1 and by[None, None].text == "b"
    lists = quotes.as_conversations(quotes.link_quotes(frame)).where("conv_id = 1 and branch_turn = 0").collect()
    assert [m.text for m in lists[0].messages][:2] == ["How do I boil  an egg?\nIt is my first.", "Put it in water.\n\nWait nine minutes."]


def test_quotes_of_long_conversations_and_none(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", 7)
    rows = [(1, t * 3, "user", f"message {t}" if t % 5 else f"> message {t - 2}\nanswer {t}") for t in range(100)]
    found = quotes.link_quotes(spark.createDataFrame(rows, CHAT_SCHEMA)).collect()
    got = [(r.conv_id, r.turn, r.role, r.parent_turn, r.quoted, r.branch_turn, r.position, r.text) for r in found]
    assert counted(got) == counted(brute_links(rows))
    assert quotes.link_quotes(spark.createDataFrame([], CHAT_SCHEMA)).count() == 0


def test_quotes_run_no_python(spark):
    plan = quotes.link_quotes(spark.createDataFrame(CHAT, CHAT_SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- pipeline -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = awkward.documents()
    awkward.table(spark).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    item = rows[12][1][:200]
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_the_columns_and_act(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch_path(spark, name)
        stage(spark, docs, small).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0
    final = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert final.count() == sizes[4]


def test_run_is_the_stages(spark, small):
    found = [tuple(r) for r in corpus_pipeline.run(spark, small).collect()]
    starts = sorted((r[1], r[2]) for r in found)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_stages_take_no_rows(spark, small):
    docs = awkward.table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_archive_files_are_bounded_in_bytes(spark, monkeypatch):
    """Payloads of very different sizes: files of large ones hold fewer records, and all come back."""
    import glob
    import os

    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 64)
    monkeypatch.setattr(warc, "FILE_BYTES", 64 * 2_000)
    rows = [(i, None, f"{i} " * n) for i, n in enumerate([10] * 100 + [2_000] * 30 + [60_000] * 3)]
    path = scratch_path(spark, "archive")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    found = {r.page_id: r.payload_bytes for r in warc.read_archive(spark, path).collect()}
    assert found == {i: len(html) for i, _, html in rows}
    sizes = [os.path.getsize(f) for f in glob.glob(f"{path.removeprefix('file:')}/part-*")]
    assert max(sizes) < 2 * 64 * 2_000 + 2 * max(len(html) for *_, html in rows)
