"""Operators on documents against brute force, on awkward rows and on none."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from corpuscape import runtime
from corpuscape.llm import decontaminate, language, mixing, near_dups, quality, repeats, token_files, toxicity
from corpuscape.llm.catalog import tokenizer_file
from corpuscape.llm.common import NO_ID
from corpuscape.runtime import scratch_path
from tests.llm import awkward

ROWS = awkward.documents()
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return awkward.table(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return awkward.table(spark, [])


def counted(rows):
    return Counter(map(repr, rows))


# --- quality ------------------------------------------------------------------------------


def brute_measures(text: str):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(covered)


def test_measures(docs):
    found = docs.select("text", quality.measures(F.col("text")).alias("m2")).collect()
    assert len(found) == len(ROWS)
    for row in found:
        assert tuple(row.m2)[:6] == brute_measures(row.text or "")


def test_binomial_tail_is_exact():
    exact = sum(math.comb(50, i) * 0.1**i * 0.9 ** (50 - i) for i in range(4))
    assert quality.binomial_tail(3, 50, 0.1) == pytest.approx(exact)


def test_cutoff_needs_proof_and_gain():
    grid = len(quality.GRID)
    bad = np.arange(grid) * 10
    assert quality.best_cutoff(np.zeros(grid), bad, 100, 4) is None  # too few labels
    assert quality.best_cutoff(np.zeros(grid), np.zeros(grid), 10**5, 4) is None  # nothing to gain
    assert quality.best_cutoff(np.zeros(grid), bad, 10**5, 4) == grid - 1
    rising = np.array([0] * 5 + [5000] * (grid - 5))  # false rejections start at the sixth
    assert quality.best_cutoff(rising, bad, 10**5, 4) == 4


def labelled(spark, n=6000):
    """Good texts without symbols, bad ones full of them, some good ones with a few."""
    good = "plain words that say something new in every place of the long sentence number {} and go on"
    rows = []
    for i in range(n):
        bad = i % 10 == 0
        text = good.format(" ".join(str(i * 31 + k) for k in range(12)))
        if bad:
            text = " ".join(w + "$$$" for w in text.split())
        rows.append((i, text, "en", int(not bad)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    return frame.select("doc_id", "text", "lang"), frame.select("doc_id", "quality")


def test_quality_holds_the_risk(spark):
    docs, labels = labelled(spark)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    good = {i for i in range(6000) if i % 10}
    assert len(good - kept) <= quality.RISK * len(good)
    assert not kept - good


def test_quality_awkward(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 0)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    expected = [r for r in ROWS if not (lambda m: m[0] < 20 or 100 * m[5] > 30 * m[0])(brute_measures(r[1] or ""))]
    assert counted(tuple(r) for r in kept.collect()) == counted(expected)
    assert quality.keep_good(none, labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == len(expected)


# --- token files --------------------------------------------------------------------------


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file())
    path = scratch_path(spark, "tokens")
    token_files.encode_files(docs, path, tokenizer_file(), 2)
    expected, start = [], 0
    for i, text in sorted(awkward.ids(ROWS)):
        ids = plain.encode(text, add_special_tokens=False).ids + [2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        expected.append((None if i == NO_ID else i, start, len(ids), crc))
        start += len(ids)
    found = [tuple(r) for r in token_files.digests(spark, path).collect()]
    assert counted(found) == counted(expected)
    assert counted(tuple(r) for r in token_files.read_index(spark, path).collect()) == counted(x[:3] for x in expected)
    empty = scratch_path(spark, "tokens")
    token_files.encode_files(none, empty, tokenizer_file(), 2)
    assert token_files.digests(spark, empty).count() == 0


def test_index_reads_no_lists(spark, docs):
    path = scratch_path(spark, "tokens")
    token_files.encode_files(docs, path, tokenizer_file(), 2)
    plan = token_files.read_index(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan


def test_token_files_have_delta_pages_and_page_indexes(spark, docs):
    import glob

    import pyarrow.parquet as pq

    path = scratch_path(spark, "tokens")
    token_files.encode_files(docs, path, tokenizer_file(), 2)
    files = [pq.ParquetFile(f) for f in glob.glob(f"{path.removeprefix('file:')}/part-*.parquet")]
    columns = [f.metadata.row_group(0).column(i) for f in files for i in range(5) if f.metadata.num_row_groups]
    tokens = [c for c in columns if c.path_in_schema.startswith("tokens")]
    assert tokens and all("DELTA_BINARY_PACKED" in c.encodings for c in tokens)
    assert all(c.has_offset_index for c in tokens)


def test_piece_encoder_equals_the_tokenizer(monkeypatch):
    """Special tokens as literals inside, next to and across words; letters whose small form or composed form is
    another; a memory that is forgotten all the time."""
    import pyarrow as pa
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file())
    encoder = token_files.PieceEncoder(tokenizer_file())
    monkeypatch.setattr(token_files, "KEPT_PIECES", 40)
    monkeypatch.setattr(token_files, "JOINED", 3)

    def check(texts):
        sizes, flat = encoder(pa.array(texts, pa.string()), 2)
        ends = np.cumsum(sizes)
        for text, lo, hi in zip(texts, ends - sizes, ends):
            assert flat[lo:hi].tolist() == plain.encode(text, add_special_tokens=False).ids + [2], text
        assert len(flat) == (ends[-1] if len(ends) else 0)

    end = "<|endoftext|>"
    check([])
    check(["", " ", end, f"a{end}b", f"{end} {end}{end}", f"x <|endof{end}text|>", "<|ENDOFTEXT|>", f"last.{end}", "no special"])
    check(["İSTANBULLU İ... xİ! dİr", "T\u0308, t\u0308 क़, K. ẞ ǅ", "don't, dogs' we'll 's .'s", "q\u3000r s\u00a0. a_b 12,5"])
    pieces = st.one_of(st.characters(codec="utf-8"), st.sampled_from([*"aBΣσİi\u0307\u0308'.,!$ \ń <|>", end, "<|startoftext|>"]))

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(pieces, max_size=30).map("".join), max_size=5))
    def same(texts):
        check(texts)

    same()


# --- repeated passages --------------------------------------------------------------------


def brute_repeats(rows):
    first = {}
    for i, text in rows:
        data = text.encode()
        for p in range(len(data) - 49):
            w = data[p : p + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, text in rows:
        data = text.encode()
        marks = bytearray(len(data))
        for p in range(len(data) - 49):
            if first[data[p : p + 50]] < i:
                marks[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(data, marks) if not m)
        spans = sum(1 for x in bytes(marks).split(b"\0") if x)
        out.append((None if i == NO_ID else i, len(data), sum(marks), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(docs, none):
    found = [(*tuple(r)[:4], bytes(r.kept).decode()) for r in repeats.remove_repeats(docs, keep_bytes=False).collect()]
    assert counted(found) == counted(brute_repeats(awkward.ids(ROWS)))
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_in_many_small_chunks(spark, docs, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 9_000)
    found = [(*tuple(r)[:4], bytes(r.kept).decode()) for r in repeats.remove_repeats(docs, keep_bytes=False).collect()]
    assert counted(found) == counted(brute_repeats(awkward.ids(ROWS)))


def test_every_window_is_in_one_phrase(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 256)
    repeats._tables.clear()
    texts = [t.encode()[:2000] for _, t in awkward.ids(ROWS)]
    seen = [(int(d), w) for doc, a, b, _ in repeats.parse(texts) for d, x, y in zip(doc, a, b) for w in range(x, y + 1)]
    assert sorted(seen) == [(i, w) for i, t in enumerate(texts) for w in range(len(t) - 49)]
    repeats._tables.clear()


# --- near duplicates ----------------------------------------------------------------------


def brute_components(rows, size):
    sets = defaultdict(list)
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        one = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        sets[i].append(one)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(s & t and 100 * len(s & t) >= 80 * len(s | t) for s in sets[i] for t in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, sets


@pytest.mark.parametrize("size", [4, 5])
def test_near_components(docs, none, size):
    expected, sets = brute_components(awkward.ids(ROWS), size)
    found = near_dups.find_components(docs, size).collect()
    assert len(found) == len(ROWS)
    assert {(r.id, r.component) for r in found} == set(expected.items())
    assert counted((r.id, r.n_shingles) for r in found) == counted((i, len(s)) for i, x in sets.items() for s in x)
    assert near_dups.find_components(none, size).count() == 0


def test_one_of_each_group_stays(docs):
    expected, _ = brute_components(awkward.ids(ROWS), 5)
    kept = near_dups.keep_first(docs, 5)
    assert kept.columns == docs.columns
    firsts = {i for i, c in expected.items() if i == c}
    wanted = {r for r in ROWS if awkward.ids([r])[0][0] in firsts}
    assert counted(tuple(r) for r in kept.collect()) == counted(wanted)


def test_near_dups_hands_texts_over_in_small_batches(spark, monkeypatch):
    """Many long texts and one pivot: its text comes with each pair, and a task must not hold all of them."""
    monkeypatch.setattr(runtime, "BATCH_BYTES", 100_000)
    words = [f"w{i}" for i in range(4000)]
    data = [(i, " ".join(words[: 3900 + i])) for i in range(60)]
    sizes, plain = [], near_dups._confirmer

    def watched(size):
        confirm = plain(size)

        def run(batches):
            def seen():
                for batch in batches:
                    assert batch.nbytes < 400_000, batch.nbytes
                    yield batch

            return confirm(seen())

        sizes.append(size)
        return run

    monkeypatch.setattr(near_dups, "_confirmer", watched)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = near_dups.find_components(docs, 5)
    assert {r.component for r in found.collect()} == {0} and sizes
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") != "100000"


def test_family_whose_pivot_is_far_from_some(spark, monkeypatch):
    """Chains a-b-c: a and c have no link but through b; blocks are small, so strays are met in them."""
    monkeypatch.setattr(near_dups, "BLOCK", 3)
    monkeypatch.setattr(near_dups, "MANY_COPIES", 1)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(60):
        words = list(base)
        for j in range(k * 4, k * 4 + 40):
            words[j % 300] = f"x{j % 300}"
        rows.append((k, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected, _ = brute_components(rows, 4)
    found = {r.id: r.component for r in near_dups.find_components(frame, 4).collect()}
    assert found == expected


def test_estimate_follows_the_sets():
    rng = np.random.default_rng(1)
    for n in (3, 40, 400, 4000):
        common = rng.integers(0, 2**64, n * 8, dtype=np.uint64)
        a = np.unique(np.concatenate([common, rng.integers(0, 2**64, n, dtype=np.uint64)]))
        b = np.unique(np.concatenate([common, rng.integers(0, 2**64, n, dtype=np.uint64)]))
        r = near_dups.registers([a, b])
        assert abs(near_dups.estimate(r[:1], r[1:])[0] - 0.8) < 0.2


# --- language and toxicity ----------------------------------------------------------------


def greedy_pieces(sample, text):
    """Quadratic greedy parse by plain search."""
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def test_automaton_parse_is_greedy():
    asked = [" abra ", "zzz", "cadabrab", " a", "", "xabraxcad", "dabr acad"]
    model = language.Model({"a": " abracadabra "})
    assert model.pieces(asked).tolist() == [[greedy_pieces(" abracadabra ", t) for t in asked]]
    assert language.Model({}).pieces(asked).shape == (0, 7) and language.Model({"a": ""}).pieces(["ab", ""]).tolist() == [[2, 0]]


@pytest.mark.parametrize("stretch", [1, 3, 16, 512])
@pytest.mark.parametrize("few", [0, 3])
def test_parse_in_stretches_is_the_parse_of_one_pass(monkeypatch, stretch, few):
    """Runs whose readings never meet, too: three of a kind against stretches of other lengths."""
    monkeypatch.setattr(language, "STRETCH", stretch)
    monkeypatch.setattr(language, "FEW", few)
    rng = np.random.default_rng(stretch)
    for _ in range(20):
        samples = {"p": "".join(rng.choice(list("ab \n"), 60)), "q": "aaab" + "".join(rng.choice(list("abc"), 20))}
        asked = ["".join(rng.choice(list("ab c"), rng.integers(0, 60))) for _ in range(6)] + ["a" * 50, "", "d" * 20]
        found = language.Model(samples).pieces(asked).tolist()
        assert found == [[greedy_pieces(samples[k], t) for t in asked] for k in ("p", "q")]


def test_language_and_score_against_brute_force(spark):
    taught = [
        (1, "The stone, and the river!", "en"), (2, "A river of stones", "en"), (3, "Der Stein und der Fluß", "de"),
        (4, "Der Stein und der Fluß", "de"), (5, "le fleuve et la pierre", "fr"), (6, "x" * 5000 + " la rivière", "fr"),
        (7, "12 !", "none"), (8, "only long " * 3500, "long"), (9, "only longer " * 3500, "long"),
    ]
    frame = spark.createDataFrame(taught, "doc_id long, text string, lang string")
    learned = language.samples(frame.repartition(4), F.lit(True))
    assert learned == language.samples(frame.coalesce(1), F.lit(True))
    assert sorted(learned["en"].split(language.BORDER)) == [" a river of stones ", " the stone and the river "]
    assert learned["de"] == " der stein und der fluß "
    # Long texts come last and stay whole; the first that fills the sample ends it.
    assert [len(x) for x in learned["fr"].split(language.BORDER)] == [24, 5013]
    assert learned["long"] == " " + "only long " * 3500 and "none" not in learned
    asked = [t for _, t, _ in taught] + ["the river and the stone", "İ der\u00a0Fluß, la STONE", "ß", "7", "", None, "only " * 3000]
    found = language.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").repartition(3), learned, "f")
    for row in found.collect():
        letters = " ".join(regex.findall(r"\p{L}[\p{L}\p{M}]*", (row.text or "").lower()))
        if not letters:
            assert row.f == ("und", 0.0)
            continue
        order = sorted((greedy_pieces(own.encode(), f" {letters} ".encode()), lang) for lang, own in learned.items())
        assert row.f == (order[0][1], order[1][0] / (order[0][0] + order[1][0]))


def test_language_of_labelled_text(spark, docs, none):
    rows = [(i, "the stone and the river " * 5, "en") for i in range(5)] + [(i, "der Stein und der Fluß " * 5, "de") for i in range(5, 10)]
    rows += [(10, "le fleuve", None), (11, None, "en"), (12, "", "de")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language.samples(frame, F.lit(True))
    assert set(learned) == {"de", "en"}
    asked = spark.createDataFrame(
        [(1, "the rivers and stones"), (2, "die Flüsse und Steine"), (3, None), (4, "12 !?"), (5, "")], "doc_id long, text string"
    )
    found = {r.doc_id: r.f for r in language.identify(asked, learned, "f").collect()}
    assert [found[i].lang for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert all(0 <= f.score <= 1 for f in found.values())
    assert language.identify(docs, learned, "f").count() == len(ROWS)
    assert language.identify(none, learned, "f").count() == 0
    assert {r.f.lang for r in language.identify(docs, {}, "f").collect()} == {"und"}


def test_machine_learns_a_pair():
    """Neither term alone, only both together: no additive weights can say that."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for _ in range(3000):
        own = {int(x) for x in rng.integers(100, 160, 6)} | ({1} if rng.random() < 0.5 else set()) | ({2} if rng.random() < 0.5 else set())
        rows.append(np.array(sorted(own)))
        labels.append(int({1, 2} <= own))
    machine = toxicity.fit(rows, np.array(labels))
    right = np.mean([(machine.score(set(r.tolist())) >= 0.5) == y for r, y in zip(rows, labels)])
    assert right > 0.97


def test_toxicity_score_against_all_pairs(spark, monkeypatch):
    """Model and scores as a plain version has them: chosen rows, counted terms, a sum over all pairs of terms."""
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 60)
    rng = np.random.default_rng(5)
    vocabulary = [f"word{i}x" for i in range(30)]
    texts = [" ".join(rng.choice(vocabulary, 6)) + (" Stupid, folk!" if i % 3 == 0 else " folk") for i in range(90)] + [None, "", "?"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (3, "another stupid text"), (None, "stupid")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 93)] + [(6, 0)], "doc_id long, toxic int")
    machine = toxicity.learn(docs, labels, F.lit(True))
    hashed = {r.doc_id: r.h for r in labels.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    codes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    ids = sorted(hashed, key=lambda i: (hashed[i], i))[:60]
    order = sorted({(hashed[i], i, codes[t], t) for i, t in rows if i in ids}, key=lambda r: r[:3])[:60]
    sets = [np.array(sorted(toxicity.terms((t or "").encode())), np.int64) for *_, t in order]
    plain = toxicity.fit(sets, np.array([int(i % 3 == 0) for _, i, *_ in order]))
    assert machine.place == plain.place and np.allclose(machine.weights, plain.weights) and np.allclose(machine.factors, plain.factors)
    for row in docs.select("text", toxicity.score(docs, machine).alias("s")).collect():
        own = [machine.place[b] for b in toxicity.terms((row.text or "").encode()) if b in machine.place]
        raw = machine.base + sum(machine.weights[a] for a in own)
        raw += sum(float(machine.factors[a] @ machine.factors[b]) for n, a in enumerate(own) for b in own[:n])
        assert row.s == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-9)


def test_toxicity_awkward(spark, docs, none):
    labels = spark.createDataFrame([(20, 1), (21, 0), (22, None), (None, 1), (20, 0)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        machine = toxicity.learn(docs.select("doc_id", "text"), given, F.lit(True))
        scores = [r[0] for r in docs.select(toxicity.score(docs, machine)).collect()]
        assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    assert none.select(toxicity.score(none, machine)).count() == 0


# --- decontamination ----------------------------------------------------------------------


def brute_hits(text, items):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
    words, hit, names = split(text), set(), set()
    for name, item in items:
        own = split(item or "")
        for i in range(max(1, len(own) - 9) if own else 0):
            w = own[i : i + 10]
            for p in range(len(words) - len(w) + 1):
                if words[p : p + len(w)] == w:
                    hit.update(range(p, p + len(w)))
                    names.add(str(name) if name is not None else "null")
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("chunk", [1 << 20, 400])
def test_decontamination(spark, docs, none, monkeypatch, chunk):
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", chunk)
    base = [r[1] for r in ROWS[8:20]]
    items = [(1, base[0][:150]), (2, base[1].upper()), (3, "a, B; c"), (4, ""), (5, None), (None, base[2][30:140]), (2, base[3][5:200]), (9, "nowhere to be found")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("found", F.lit(1))
    rows = decontaminate.find_items(docs, bench, "hits").select("text", "hits", decontaminate.hit_words("hits").alias("n")).collect()
    assert len(rows) == len(ROWS)
    seen = {}
    for r in rows:
        if len(r.text or "") < 5000:
            assert (r.hits.n_words, r.n, list(r.hits["items"])) == seen.setdefault(r.text, brute_hits(r.text or "", items))
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.n == 0 for r in rows) < len(ROWS)
    assert decontaminate.remove_contaminated(none, bench).count() == 0
    assert decontaminate.remove_contaminated(docs, bench.limit(0)).count() == len(ROWS)


def test_longest_match_runs_over_windows():
    items = decontaminate.Items([("a", " ".join(f"w{i}" for i in range(40)).encode())])
    text = "x y " + " ".join(f"w{i}" for i in range(5, 30)) + " z"
    _, starts, ends, names, longest, at, name = decontaminate.search([text.encode()], items)[0]
    assert (starts, ends, names, longest, at, name) == ([2], [27], ["a"], 25, 2, "a")


# --- mixing -------------------------------------------------------------------------------


def brute_mix(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(SPACE.findall((r[1] or "").encode()))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return sizes, target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        free -= over


def test_mixing(spark, docs, none):
    again = []
    for _ in range(2):
        found = mixing.mix(docs, mixing.plain_share(F.col("text")), into="result").select("doc_id", "source", "text", "result").collect()
        again.append(counted((r.doc_id, r.text, r.result.taken) for r in found))
    assert again[0] == again[1] and len(found) == len(ROWS)
    sizes, target = brute_mix(ROWS)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        size = len(SPACE.findall((r.text or "").encode()))
        assert (r.result.size, r.result.source_size) == (size, sizes[r.source])
        assert r.result.target == pytest.approx(target[r.source])
        assert r.result.taken <= 3 * size
        taken[r.source] += r.result.taken
        largest[r.source] = max(largest[r.source], size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
    rows = mixing.mixed(docs, mixing.plain_share(F.col("text")))
    assert rows.columns == docs.columns
    assert rows.count() == sum(r.result.copies for r in found)
    assert mixing.mixed(none, mixing.plain_share(F.col("text"))).count() == 0


def test_better_documents_come_first(spark):
    rows = [(i, "word " * 10, "a" if i < 2000 else "b") for i in range(2600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weight = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1)
    found = mixing.mix(frame, weight).where("source = 'a' and mix.copies > 0").collect()
    even = sum(r.doc_id % 2 == 0 for r in found)
    assert even > 1.5 * (len(found) - even) and abs(sum(r.mix.taken for r in found) - found[0].mix.target) <= 10
