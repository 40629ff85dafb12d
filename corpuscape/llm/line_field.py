"""Document quality by a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad. The field's features are flags of the line itself (symbols, shouting,
words that come again, digits, length, repeated lines, how it ends), the same flags of the line before and of
the one behind it, and the labels of adjacent lines. Forward and backward sums give each line its probability of
being good; a document's score is their mean, weighted by the words of the lines. So one odd line in a long clean text
weighs little, and lines between bad ones are doubted.

Learning takes a bounded sample: labelled documents in the order of a hash of their id, at most ``SAMPLE_DOCS`` of them
and as many as have ``SAMPLE_LINES`` lines in all; a line of the sample has the label of its document. Whole texts
are read, only flags leave the tasks. Gradients are exact, steps and their number fixed, so reruns agree.

Null or empty text is a single line without words and gets that line's probability. Null labels teach nothing; of labels
that repeat for a document the lowest counts; ids that repeat teach with each of their texts. Without labels of both
kinds the score is the share of label 1, or 0. Other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscape.llm.common import byte_values, stored

SAMPLE_DOCS = 6_000
SAMPLE_LINES = 200_000
STEPS = 100
RATE = 0.8
DECAY = 1e-4
#: Cells of lines by documents that are worked on at once.
BLOCK_CELLS = 50_000

SYMBOLS = b"#*$%&|<>{}[]\\^~=+_"
DIGITS = b"0123456789"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENDS = b".!?:;\"'"
FLAGS = 24


def _share(line: bytes, some: bytes, n: int) -> float:
    return (len(line) - len(line.translate(None, some))) / n


def flags(line: bytes, before: bytes | None, seen: bool) -> tuple[int, int]:
    """The flags of a line as bits, and its number of words."""
    words = line.split()
    n = len(words)
    if not n:
        return 1 | 1 << 1, 0
    letters = sum(map(len, words))
    distinct = len(set(words)) / n
    symbols, shouts = _share(line, SYMBOLS, n), _share(line, b"!", n)
    upper, digits = _share(line, UPPER, letters), _share(line, DIGITS, letters)
    size = letters / n
    tests = (
        True, False,
        symbols > 0, symbols > 0.2, symbols > 0.8,
        shouts > 0.2, shouts > 0.8,
        upper > 0.25, upper > 0.6,
        digits > 0, digits > 0.3,
        n > 3 and distinct < 0.6, n > 3 and distinct < 0.35, n > 3 and distinct < 0.12,
        size < 3, size > 7, size > 10,
        n < 4, n < 10, n > 60, n > 250,
        seen, before is not None and before == line,
        line.rstrip()[-1:] not in ENDS,
    )
    return sum(1 << i for i, t in enumerate(tests) if t), n


def read_lines(text: bytes) -> tuple[list[int], list[int]]:
    """Flags and words of the lines of a text."""
    masks, sizes, past, before = [], [], set(), None
    for line in text.split(b"\n"):
        if not line.strip():
            continue
        mask, n = flags(line, before, line in past)
        masks.append(mask)
        sizes.append(n)
        past.add(line)
        before = line
    return (masks, sizes) if masks else ([flags(b"", None, False)[0]], [1])


@dataclass
class Field:
    """Weights for good against bad of the flags of a line, of its neighbours before and behind, and
    the scores of label pairs (bad or good, then bad or good)."""

    weights: np.ndarray
    pairs: np.ndarray


def _chains(masks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Flags of chains that are padded to one length: (chains, lines, features), and the lines that exist."""
    longest = max(map(len, masks))
    bits = np.zeros((len(masks), longest), np.int64)
    real = np.zeros((len(masks), longest), bool)
    for i, m in enumerate(masks):
        bits[i, : len(m)] = m
        real[i, : len(m)] = True
    own = ((bits[:, :, None] >> np.arange(FLAGS)) & 1).astype(np.float32)
    none = np.zeros_like(own[:, :1])
    return np.concatenate([own, np.concatenate([none, own[:, :-1]], 1), np.concatenate([own[:, 1:], none], 1)], 2), real


def forward_backward(odds: np.ndarray, real: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected number of each pair of adjacent labels, summed over the chains.

    ``odds``: log odds of good for each line. Sums are scaled line by line, so chains of any length stay in range.
    """
    n, length = odds.shape
    there = real.T
    good = 1 / (1 + np.exp(-np.clip(odds.T.astype(np.float64), -40, 40)))
    bad = 1 - good
    (bb, bg), (gb, gg) = np.exp(pairs)
    # Shares of the label good in the sums up to a line, and in the sums from behind it.
    front, back = np.empty((length, n)), np.full((length, n), 0.5)
    front[0] = good[0]
    for t in range(1, length):
        past = front[t - 1]
        up = good[t] * ((1 - past) * bg + past * gg)
        down = bad[t] * ((1 - past) * bb + past * gb)
        front[t] = up / (up + down)
    for t in range(length - 2, -1, -1):
        low, high = bad[t + 1] * (1 - back[t + 1]), good[t + 1] * back[t + 1]
        up, down = gb * low + gg * high, bb * low + bg * high
        # Nothing comes from behind the end.
        back[t] = np.where(there[t + 1], up / (up + down), 0.5)
    high, low = front * back, (1 - front) * (1 - back)
    marginal = (high / (high + low)).T
    first, then = front[:-1], back[1:]
    joint = [
        [(1 - first) * bb * bad[1:] * (1 - then), (1 - first) * bg * good[1:] * then],
        [first * gb * bad[1:] * (1 - then), first * gg * good[1:] * then],
    ]
    total = joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1]
    expected = np.array([[float((j[there[1:]] / total[there[1:]]).sum()) for j in row] for row in joint])
    return marginal, expected


def _blocks(lengths: np.ndarray) -> list[np.ndarray]:
    """Chains of similar length together, in blocks of bounded size; a longer chain is a block."""
    order, out, at = np.argsort(lengths, kind="stable"), [], 0
    while at < len(order):
        to, longest = at + 1, lengths[order[at]] * 1.3 + 1
        while to < len(order) and lengths[order[to]] <= longest and (to + 1 - at) * lengths[order[to]] <= BLOCK_CELLS:
            to += 1
        out.append(order[at:to])
        at = to
    return out


def fit(masks: list[np.ndarray], labels: np.ndarray) -> Field:
    """Gradient ascent (AdaGrad) on the likelihood of the labels of all lines."""
    width = 3 * FLAGS
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        weights = np.zeros(width)
        weights[0] = 40.0 if share else -40.0
        return Field(weights, np.zeros((2, 2)))
    lengths = np.array(list(map(len, masks)))
    starts = np.cumsum(lengths) - lengths
    lines = np.concatenate([_chains([m])[0][0] for m in masks])
    blocks = []
    for some in _blocks(lengths):
        real = np.arange(lengths[some].max()) < lengths[some][:, None]
        blocks.append((np.where(real, starts[some][:, None] + np.arange(real.shape[1]), 0), real, labels[some]))
    truth = np.repeat(labels, lengths).astype(np.float32)
    theta = np.zeros(width + 4)
    past = np.full(width + 4, 1e-8)
    for _ in range(STEPS):
        odds, pairs = lines @ theta[:width].astype(np.float32), theta[width:].reshape(2, 2)
        good, steps = np.zeros(len(lines), np.float32), np.zeros((2, 2))
        for place, real, y in blocks:
            marginal, expected = forward_backward(odds[place], real, pairs)
            good[place[real]] = marginal[real]
            seen = real[:, 1:].sum(1)
            steps += np.diag([seen[y == 0].sum(), seen[y == 1].sum()]) - expected
        gradient = np.concatenate([(truth - good) @ lines, steps.ravel()]) / len(lines) - DECAY * theta
        past += gradient**2
        theta += RATE * gradient / np.sqrt(past)
    return Field(theta[:width], theta[width:].reshape(2, 2))


def score_chains(field: Field, masks: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
    """Score of each chain of lines."""
    out = np.zeros(len(masks))
    for some in _blocks(np.array(list(map(len, masks)))):
        x, real = _chains([masks[i] for i in some])
        marginal, _ = forward_backward(x @ field.weights, real, field.pairs)
        for i, row, own in zip(some, marginal, [sizes[i] for i in some]):
            out[i] = float((row[: len(own)] * own).sum() / own.sum())
    return np.clip(out, 0.0, 1.0)


def _line_flags(texts: pa.Array) -> pa.Array:
    return pa.array([read_lines(t)[0] for t in byte_values(texts)], pa.list_(pa.int32()))


def learn(docs: DataFrame, labels: DataFrame, taught: Column) -> Field:
    """Fit on ``docs(doc_id, text)`` where ``taught`` holds, with ``labels(doc_id, quality)``."""
    given = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(taught)
    draw = F.xxhash64(F.col("doc_id").cast("string"))
    # At most SAMPLE_DOCS ids: a bounded broadcast.
    known = given.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(draw, "doc_id").limit(SAMPLE_DOCS)
    read = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    lines = F.arrow_udf(_line_flags, "array<int>")(F.col("text"))
    read = stored(read.select("doc_id", "quality", lines.alias("masks")), "field-lines")
    # Ids may repeat: rows are bounded again, then lines, over a table of at most SAMPLE_DOCS rows.
    few = read.orderBy(draw, "doc_id", F.size("masks"), F.hash("masks")).limit(SAMPLE_DOCS)
    few = few.withColumn("n", F.size("masks")).where(F.col("n") <= SAMPLE_LINES)
    order = Window.orderBy(draw, "doc_id", "n", F.hash("masks")).rowsBetween(Window.unboundedPreceding, 0)
    table = few.withColumn("so_far", F.sum("n").over(order)).where(F.col("so_far") <= SAMPLE_LINES).toArrow()
    masks = [np.array(x, np.int64) for x in table.column("masks").to_pylist()]
    return fit(masks, np.array([int(x > 0) for x in table.column("quality").to_pylist()], np.int64))


def score(docs: DataFrame, field: Field) -> Column:
    """The score of the column text, for use on ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        lines = [read_lines(t) for t in byte_values(texts)]
        masks, sizes = [np.array(m, np.int64) for m, _ in lines], [np.array(s, np.float64) for _, s in lines]
        return pa.array(score_chains(shared.value, masks, sizes) if lines else np.zeros(0), pa.float64())

    return scored(F.col("text"))


def line_labels(docs: DataFrame, field: Field) -> Column:
    """For the column text: P(good) of each line that has a word, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf("array<double>")
    def labelled(texts: pa.Array) -> pa.Array:
        out = []
        for text in byte_values(texts):
            x, real = _chains([np.array(read_lines(text)[0], np.int64)])
            out.append(forward_backward(x @ shared.value.weights, real, shared.value.pairs)[0][0])
        return pa.array(out, pa.list_(pa.float64()))

    return labelled(F.col("text"))
