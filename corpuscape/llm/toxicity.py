"""Toxicity by a factorization machine over hashed terms.

A term is a lower-cased word without punctuation at its ends, or its first 4, 5 or 6 bytes, since inflected and
compound insults share their stem; terms are hashed to one of ``BUCKETS`` buckets, and a text is the set of its buckets. The score is the logistic of w0 + sum of w over its terms + the sum over pairs of terms of the
product of their factors, ``FACTORS`` numbers each, which a machine of this kind gets in linear time
from (sum of v)^2 - sum of v^2. So two terms that mean little apart can mean much together, and
reverse, which additive weights miss.

Learning takes a bounded sample: the ``SAMPLE_ROWS`` labelled rows with the smallest hash of their id. Its rows are chosen by
hashes, its terms counted by Spark, and what the driver gets is bounded whatever the texts' lengths: two counts a bucket, and of each
row its learned terms. Of the buckets those in at least ``LEAST_ROWS`` of them are screened by how far their share among toxic rows is from that among
others, and the ``KEPT_TERMS`` most telling ones are learned; all others weigh nothing. Training is mini-batch
AdaGrad with fixed seeds, so reruns agree.

Null or empty text has no terms and gets the score of w0. Null labels teach nothing; of labels that repeat for
one document the highest counts; ids that repeat teach with each of their texts, once where the text repeats too. Without labels of both kinds the
score is the share of label 1, or 0. Other columns are left alone.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscape.llm.common import byte_values, stored
from corpuscape.runtime import temporary_tables

BUCKETS = 1 << 20
FACTORS = 8
SAMPLE_ROWS = 8_000
LEAST_ROWS = 4
KEPT_TERMS = 2_000
PASSES = 30
BATCH = 128
RATE = 0.1
DECAY = 1e-3
#: Bytes at the ends of a word that are no part of the term.
EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KNOWN_WORDS = 100_000
PREFIXES = (4, 5, 6)


def terms(text: bytes, known: dict[bytes, tuple[int, ...]] | None = None) -> set[int]:
    known = {} if known is None else known
    out: set[int] = set()
    for word in set(text.lower().split()):
        buckets = known.get(word)
        if buckets is None:
            stem = word.strip(EDGES)
            parts = [stem, *(b"^" + stem[:n] for n in PREFIXES if len(stem) > n)] if stem else []
            buckets = tuple(zlib.crc32(x) % BUCKETS for x in parts)
            if len(known) < KNOWN_WORDS:
                known[word] = buckets
        out.update(buckets)
    return out


@dataclass
class Machine:
    """w0, and weight and factors of the terms that were learned."""

    base: float
    place: dict[int, int]
    weights: np.ndarray
    factors: np.ndarray

    def score(self, buckets: set[int]) -> float:
        own = [self.place[b] for b in buckets if b in self.place]
        return _logistic(_raw(self.base, self.weights, self.factors, own))


def _raw(base: float, weights: np.ndarray, factors: np.ndarray, own: list[int]) -> float:
    v = factors[own]
    total = v.sum(0)
    return float(base + weights[own].sum() + 0.5 * (total @ total - (v * v).sum()))


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def count_buckets(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """In how many rows of either label each bucket is."""
    count = np.zeros((2, BUCKETS), np.int64)
    for row, y in zip(rows, labels):
        count[y][row] += 1
    return count


def screen(count: np.ndarray, size: np.ndarray) -> list[int]:
    """The most telling buckets, by their rows of either label and the number of such rows."""
    enough = np.flatnonzero(count[0] + count[1] >= LEAST_ROWS)
    share = [(c[enough] + 0.5) / (n + 1) for c, n in zip(count, size)]
    pooled = (count[0][enough] + count[1][enough] + 1) / (size.sum() + 2)
    z = np.abs(share[1] - share[0]) / np.sqrt(pooled * (1 - pooled) * (1 / (size[0] + 1) + 1 / (size[1] + 1)))
    order = np.lexsort((enough, -z))[:KEPT_TERMS]
    return enough[order].tolist()


def fit(rows: list[np.ndarray], labels: np.ndarray, kept: list[int] | None = None) -> Machine:
    """Train on sets of buckets with labels 0 and 1; ``kept`` are the buckets to learn, by default the most telling ones."""
    positive = float(labels.mean()) if len(labels) else 0.0
    none = Machine(-35.0, {}, np.zeros(0), np.zeros((0, FACTORS)))
    if positive in (0.0, 1.0):
        none.base = 35.0 if positive else -35.0
        return none
    if kept is None:
        kept = screen(count_buckets(rows, labels), np.bincount(labels, minlength=2))
    place = {b: i for i, b in enumerate(kept)}
    sets = [[place[b] for b in row.tolist() if b in place] for row in rows]
    draw = np.random.default_rng(11)
    w, v = np.zeros(len(place)), draw.normal(0, 0.01, (len(place), FACTORS))
    w0 = float(np.log(positive / (1 - positive)))
    past_w, past_v, past_0 = np.full_like(w, 1e-8), np.full_like(v, 1e-8), 1e-8
    for _ in range(PASSES):
        order = draw.permutation(len(sets))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            index = np.concatenate([np.array(sets[i], np.int64) for i in some])
            owner = np.repeat(np.arange(len(some)), [len(sets[i]) for i in some])
            own = v[index]
            total = np.zeros((len(some), FACTORS))
            np.add.at(total, owner, own)
            raw = w0 + np.bincount(owner, w[index], len(some)) + 0.5 * ((total**2).sum(1) - np.bincount(owner, (own**2).sum(1), len(some)))
            error = 1 / (1 + np.exp(-np.clip(raw, -35, 35))) - labels[some]
            grad_w, grad_v = DECAY * w, DECAY * v
            np.add.at(grad_w, index, error[owner] / len(some))
            np.add.at(grad_v, index, error[owner][:, None] * (total[owner] - own) / len(some))
            past_w += grad_w**2
            past_v += grad_v**2
            w -= RATE * grad_w / np.sqrt(past_w)
            v -= RATE * grad_v / np.sqrt(past_v)
            past_0 += error.mean() ** 2
            w0 -= RATE * error.mean() / np.sqrt(past_0)
    return Machine(w0, place, w, v)


def _term_lists(texts: pa.Array) -> pa.Array:
    return pa.array([sorted(terms(t)) for t in byte_values(texts)], pa.list_(pa.int32()))


def learn(docs: DataFrame, labels: DataFrame, taught: Column) -> Machine:
    """Fit on ``docs(doc_id, text)`` where ``taught`` holds, with ``labels(doc_id, toxic)``. Ids of
    the sample are chosen first, then its rows by a hash of their text, so only theirs are turned into terms."""
    given = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(taught)
    draw = F.xxhash64(F.col("doc_id").cast("string"))
    # At most SAMPLE_ROWS ids, then as many rows: bounded broadcasts.
    chosen = given.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(draw, "doc_id").limit(SAMPLE_ROWS)
    coded = docs.select("doc_id", "text", F.xxhash64("text").alias("code"))
    with temporary_tables(docs.sparkSession):
        picked = coded.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "code").distinct()
        picked = stored(picked.orderBy(draw, "doc_id", "code").limit(SAMPLE_ROWS), "picked")
        texts = coded.join(F.broadcast(picked), ["doc_id", "code"]).groupBy("doc_id", "code", "toxic").agg(F.min("text").alias("text"))
        own = F.arrow_udf(_term_lists, "array<int>")(F.col("text"))
        sample = stored(texts.select(draw.alias("draw"), "doc_id", "code", (F.col("toxic") > 0).cast("int").alias("y"), own.alias("terms")), "sample")
        size = np.zeros(2, np.int64)
        for r in sample.groupBy("y").count().collect():
            size[r["y"]] = r["count"]
        seen = sample.select("y", F.explode("terms").alias("bucket")).groupBy("y", "bucket").count().toArrow()
        count = np.zeros((2, BUCKETS), np.int64)
        count[seen["y"].to_numpy(), seen["bucket"].to_numpy()] = seen["count"].to_numpy()
        kept = screen(count, size)
        listed = F.lit(kept).cast("array<int>") if kept else F.array().cast("array<int>")
        rows = sample.withColumn("terms", F.array_intersect("terms", listed)).orderBy("draw", "doc_id", "code").select("y", "terms").toArrow()
    sets = [np.array(x, np.int64) for x in rows["terms"].to_pylist()]
    return fit(sets, rows["y"].to_numpy().astype(np.int64), kept)


def _scorer(shared):
    known: dict[bytes, tuple[int, ...]] = {}

    def score(texts: pa.Array) -> pa.Array:
        machine = shared.value
        return pa.array([machine.score(terms(t, known)) for t in byte_values(texts)], pa.float64())

    return score


def score(docs: DataFrame, machine: Machine) -> Column:
    """The score of the column text, for use on ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return F.arrow_udf(_scorer(shared), "double")(F.col("text"))
