"""Centroid clustering, line fields and conversation repair against brute force, on awkward rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscape.llm import line_field, repair, walsh
from corpuscape.llm.catalog import op12_line_field

SF = "/root/testdata/sf0.01"

# --- centroids ----------------------------------------------------------------------------


def test_search_equals_brute_force():
    rng = np.random.default_rng(0)
    for spread in (3, 300, 1 << 24):
        x, c = rng.integers(-spread, spread + 1, (300, 64)), rng.integers(-spread, spread + 1, (16, 64))
        c[7], x[0], x[1] = c[3], c[3], 0
        centre, distance, _ = walsh.search(x, c)
        full = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (centre == full.argmin(1)).all() and (distance == full.min(1)).all()
    assert centre[0] == 3


def test_search_drops_far_centroids_early():
    """Groups that differ in their mean are told apart by the first coefficients."""
    rng = np.random.default_rng(1)
    c = np.arange(16)[:, None] * 100 + rng.integers(0, 5, (16, 64))
    x = c[rng.integers(0, 16, 500)] + rng.integers(-3, 4, (500, 64))
    assert walsh.search(x, c)[2] < 500 * 16 * 64 / 4


def test_transform_keeps_distances():
    rng = np.random.default_rng(2)
    x = rng.integers(-99, 99, (5, 64))
    h = walsh.hadamard(x)
    assert ((h**2).sum(1) == 64 * (x**2).sum(1)).all()
    signs = (np.diff(walsh.hadamard(np.eye(64, dtype=int))[:, walsh.coarse_first()], axis=0) != 0).sum(0)
    assert signs.tolist() == list(range(64))


def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 64).tolist()) for i in range(40)]
    rows += [(None, rows[0][1]), (7, rows[1][1]), (7, rows[1][1])]
    odd = [(50, None), (51, [0.1] * 63), (52, [0.1] * 63 + [None]), (53, [0.1] * 63 + [float("nan")]), (54, [float("inf")] * 64), (55, [])]
    return rows, odd


def brute_clusters(rows, k=16):
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    draw = lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or -1, r[1])
    centres = [v for _, v in sorted(kept, key=draw)[:k]]
    find = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(3):
        own = [find(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centres[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return sorted((i if i is not None else -1, *reversed(find(v)), hashlib.sha256(",".join(map(str, centres[find(v)[1]])).encode()).hexdigest()) for i, v in kept)


@pytest.mark.parametrize("some", [43, 5, 0])
def test_centroids(spark, some):
    rows, odd = vectors()
    table = spark.createDataFrame([(*r, "x") for r in rows[:some] + odd], "vec_id long, embedding array<double>, CLUSTER string")
    assigned, centroids = walsh.cluster(walsh.scaled(table))
    found = walsh.described(assigned, centroids).collect()
    mine = sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in found)
    assert mine == (brute_clusters(rows[:some]) if some else [])
    for r in found:
        assert r.inertia == sum(x.distance for x in found)
        assert r.cluster_inertia == sum(x.distance for x in found if x.cluster == r.cluster)


def test_huge_components_are_limited(spark):
    table = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.5] * 64)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.x for r in walsh.scaled(table).collect()}
    assert found == {1: [1 << 24] * 64, 2: [-(1 << 24)] * 64, 3: [32] * 64}


# --- line fields --------------------------------------------------------------------------


def test_chain_sums_equal_all_labellings():
    rng = np.random.default_rng(4)
    odds, pairs = rng.normal(0, 2, (3, 5)), rng.normal(0, 1, (2, 2))
    lengths = [5, 3, 1]
    real = np.arange(5) < np.array(lengths)[:, None]
    marginal, expected = line_field.forward_backward(odds, real, pairs)
    counts = np.zeros((2, 2))
    for i, n in enumerate(lengths):
        total, good, steps = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(o * v for o, v in zip(odds[i], y)) + sum(pairs[a, b] for a, b in zip(y, y[1:])))
            total, good = total + p, good + p * np.array(y)
            for a, b in zip(y, y[1:]):
                steps[a, b] += p
        assert np.allclose(marginal[i, :n], good / total)
        counts += steps / total
    assert np.allclose(expected, counts)


def test_long_chains_stay_in_range():
    marginal, _ = line_field.forward_backward(np.full((1, 5000), -30.0), np.ones((1, 5000), bool), np.full((2, 2), 3.0))
    assert np.isfinite(marginal).all() and marginal.max() < 1e-9


def test_neighbours_decide_over_a_plain_line():
    good, junk = ["some words of a plain line with a full stop at its end."], ["### a&&& b$$$ c*** d%%% e&&& f###"]
    texts = [good * 3] * 40 + [junk * 3] * 40 + [junk + good + junk] * 20
    masks = [np.array(line_field.read_lines("\n".join(t).encode())[0]) for t in texts]
    field = line_field.fit(masks, np.array([1] * 40 + [0] * 60))
    between = [line_field.read_lines("\n".join(t).encode()) for t in (junk + good + junk, good * 3)]
    x, real = line_field._chains([np.array(m) for m, _ in between])
    marginal, _ = line_field.forward_backward(x @ field.weights, real, field.pairs)
    assert marginal[0, 1] < 0.2 < 0.8 < marginal[1, 1]


def test_quality_scores_of_held_out_documents(spark):
    found = op12_line_field(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out and quality is not null").toPandas()
    right = (found["predicted"] == found["quality"]).mean()
    assert right > 0.95 and found["score"].between(0, 1).all()
    again = op12_line_field(spark, SF).agg(F.sum("score")).first()[0]
    assert again == pytest.approx(op12_line_field(spark, SF).agg(F.sum("score")).first()[0], abs=1e-9)


def test_quality_of_awkward_texts(spark):
    texts = [None, "", " \n\t\n", "a", "word " * 200_000, "\n".join(["one line."] * 3000), "é\nü\n日本", "### &&&\n" * 4]
    rows = [(i if i else None, t, 9) for i, t in enumerate(texts)] + [(3, "a", 9), (3, "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, SCORE int")
    labels = spark.createDataFrame([(3, 1), (3, 0), (7, 0), (4, None), (None, 1), (5, 1)], "doc_id long, quality int")
    field = line_field.learn(docs, labels, F.lit(True))
    scores = docs.select("doc_id", "text", line_field.score(docs, field).alias("s"), line_field.line_labels(docs, field).alias("l")).collect()
    assert len(scores) == len(rows) and all(0 <= r.s <= 1 for r in scores)
    assert len({r.s for r in scores if not (r.text or "").strip()}) == 1
    for r in scores:
        masks, sizes = line_field.read_lines((r.text or "").encode())
        assert len(r.l) == len(masks) and r.s == pytest.approx(float(np.dot(r.l, sizes) / sum(sizes)), abs=1e-9)
    none = line_field.learn(docs, labels.limit(0), F.lit(True))
    assert docs.select(line_field.score(docs, none).alias("s")).agg(F.max("s")).first()[0] < 1e-9
    empty = docs.limit(0)
    assert empty.select(line_field.score(empty, field).alias("s")).count() == 0


# --- repair -------------------------------------------------------------------------------


def brute_repair(kinds):
    """All edits, row by row, over what was put out last."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    state = {"": (0, "")}

    def insert(state):
        for _ in range(3):
            for last, (cost, audit) in list(state.items()):
                for role in follow[last].replace("s", ""):
                    new = (cost + 5, audit + "I")
                    state[role] = min(state.get(role, new), new)
        return state

    for kind in kinds:
        after = {}
        for last, (cost, audit) in insert(state).items():
            options = [(last, cost + 2, "D")]
            if kind != "-":
                more = 5 if kind.isupper() else 0
                options += [(kind.lower(), cost + more, "K")] if kind.lower() in follow[last] else []
                options += [(role, cost + more + 1, "R") for role in follow[last].replace("s", "")]
            for to, paid, letter in options:
                new = (paid, audit + letter)
                after[to] = min(after.get(to, new), new)
        state = after
    state = insert(state)
    return min(v for k, v in state.items() if k in ("", "a"))


def test_spans_equal_brute_force():
    rng = random.Random(0)
    for _ in range(1500):
        kinds = "".join(rng.choice("suuaaoSUAO-") for _ in range(rng.randint(0, 22)))
        assert repair.best(repair.span_cells(kinds)) == brute_repair(kinds), kinds


def brute_conversations(rows):
    out = {}
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        kinds, initials, seen, count = "", "", set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in own:
            ink = text.rstrip(repair.SPACES)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            initials += initial
            kinds += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = brute_repair(kinds)
        lines, last, at = [], None, iter(own)
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(at)[2:]
            if letter == "D":
                continue
            role = role if letter == "K" else "assistant" if last == "u" else "user"
            last = role[:1]
            lines.append(f"{role}:{text}")
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talk():
    rng = random.Random(1)
    texts = ["Yes.", "No!", "why", "", " \t\n", "a ", "Fine?  ", None, "Long. " * 3000, "end\n."]
    rows = []
    for conv in [None, 0, 1, 2, 3, -9]:
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 2**40]), rng.choice(["system", "user", "assistant", "tool", "", None, "ux"]), rng.choice(texts)))
    # A conversation with most of the rows, many of them equal.
    rows += [(5, i, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No!", f"Text {i}.", f"Cut {i}"])) for i in range(600)]
    return rows + [(6, 3, "user", "Again.")] * 300


@pytest.mark.parametrize("parts", ["1", "7"])
def test_repair(spark, parts):
    rows, kept = talk(), spark.conf.get("spark.sql.shuffle.partitions")
    table = spark.createDataFrame([(*r, 1.5) for r in rows], "conv_id long, turn long, role string, text string, COST double")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        ordered, found = repair.repair(table)
        hashes = {r.conv_id: r.repaired_sha256 for r in repair.digests(ordered, found.select("conv_id", "audit")).collect()}
        repaired = repair.repaired_rows(ordered, found.select("conv_id", "audit")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    mine = {r["conv_id"]: (*[r[n] for n in names], hashes[r["conv_id"]]) for r in found.collect()}
    expected = brute_conversations(rows)
    assert mine == expected
    five = sorted((r.place, f"{r.role}:{r.text}") for r in repaired if r.conv_id == 5)
    assert hashlib.sha256("\n".join(x for _, x in five).encode()).hexdigest() == hashes[5]


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    ordered, found = repair.repair(empty)
    assert found.count() == 0 and repair.digests(ordered, found.select("conv_id", "audit")).count() == 0


def test_damage(spark):
    rows = [(c, t, "system", "One. Two! Three") for c in [*range(30), None] for t in [0, 1, None]]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expected = []
    for conv, turn, role, text in rows:
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if way:
            row = (conv, turn, "user" if way == 4 else role, "" if way == 1 else "One Two Three" if way == 2 else text)
            expected += [row] * (2 if way == 3 else 1)
    found = [tuple(r) for r in repair.damaged(table).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
