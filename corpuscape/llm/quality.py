"""Quality rules whose cutoffs hold a risk bound on labelled holdouts.

A rule is a share that is high in bad texts (symbols or shouted words per word, repeated lines per line, words
in repeated passages per word, characters per word); it rejects what lies above its cutoff. Cutoffs come
from a fixed grid and are set per stratum, here the language. A cutoff is certified if labelled good documents
prove that it rejects no more than ``RISK / rules`` of the stratum's good ones: the exact binomial probability
of as few rejections at that rate must be at most ``ERROR / (strata * rules)``, Bonferroni's correction over all
chains. Within a chain cutoffs are tested from the most lenient on and testing stops at the first failure,
which needs no further correction. So with probability 1 - ``ERROR`` no stratum loses more than ``RISK`` of its
good documents to all rules together. Among the certified cutoffs the one that gains most is used: bad rejections
minus ``PRICE`` times good ones; without gain, or without enough labels, the rule rejects nothing there.

Null or empty text has no words and fails the base rules. A null stratum is a stratum. Repeated rows are measured
like any other; labels without a document, and null labels, don't count; of labels that repeat for a document
the lowest counts. Empty tables give empty results. Other columns are left alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscape.llm.common import byte_values, stored
from corpuscape.runtime import broadcast_if_small

RISK = 0.02
ERROR = 0.05
PRICE = 10
#: Fixed values of the base rules.
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, "
    "n_caps_words long"
)
#: rule: (measure, per measure, grid from lenient to strict)
GRID = [round(2.0 ** (-i / 2), 4) for i in range(-2, 14)]
RULES = {
    "symbols": ("n_symbols", "n_words", GRID),
    "shouting": ("n_caps_words", "n_words", GRID),
    "lines": ("n_dup_lines", "n_lines", GRID),
    "repeats": ("n_repeat_words", "n_words", GRID),
}


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of ``WINDOW`` words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    width = 1
    while width < WINDOW:  # numbers of single words, pairs, fours and eights: exact, no hash
        pairs = ids[:-width] * len(words) + ids[width:]
        found, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(found) == len(pairs):
            return 0
        width *= 2
    marks = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[ids] > 1)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + WINDOW, -1)
    return int((np.cumsum(marks) > 0).sum())


def measure_one(data: bytes) -> tuple[int, ...]:
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = b"".join(words)
    points = len(letters) if letters.isascii() else len(letters.decode())
    symbols = len(letters) - len(letters.translate(None, SYMBOLS))
    caps = sum(w.isupper() and len(w) > 2 for w in words)
    return (len(words), points, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words), caps)


def _measure(texts: pa.Array) -> pa.Array:
    rows = [measure_one(x) for x in byte_values(texts)]
    names = [x.split()[0] for x in MEASURES.split(", ")]
    columns = np.array(rows, np.int64).reshape(-1, len(names)).T
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=names)


def measures(text: Column) -> Column:
    """The struct ``MEASURES`` of a text."""
    return F.arrow_udf(_measure, f"struct<{MEASURES.replace(' ', ':').replace(',:', ',')}>")(text)


def base_failed(m: str) -> Column:
    n = F.col(f"{m}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > REPEAT_PERCENT * n)


def _share(m: str, rule: str) -> Column:
    what, per, _ = RULES[rule]
    return F.col(f"{m}.{what}") / F.greatest(F.col(f"{m}.{per}"), F.lit(1))


def binomial_tail(k: int, n: int, p: float) -> float:
    """Exact probability of k or fewer of n at rate p."""
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def best_cutoff(good: np.ndarray, bad: np.ndarray, n_good: int, chains: int) -> int | None:
    """Place in the grid; ``good[i]``, ``bad[i]``: labelled documents that cutoff i rejects."""
    best, gain = None, 0.0
    for i, (g, b) in enumerate(zip(good, bad)):
        if n_good == 0 or g > n_good * RISK / len(RULES):  # certain to fail: above the rate itself
            break
        if binomial_tail(int(g), n_good, RISK / len(RULES)) > ERROR / chains:
            break
        if b - PRICE * g > gain:
            best, gain = i, b - PRICE * g
    return best


def cutoffs(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, one nullable cutoff per rule) of ``measured(doc_id, stratum, m)`` and
    ``labels(doc_id, quality)``. Calibrates on what passes the base rules."""
    given = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = measured.where(~base_failed("m")).join(given, "doc_id")
    levels = [
        # How many cutoffs of the rule reject the document: its first ones, from the strict end.
        F.struct(
            F.lit(rule).alias("rule"),
            sum((_share("m", rule) > c).cast("int") for c in RULES[rule][2]).alias("level"),
        )
        for rule in RULES
    ]
    counts = stored(
        held.select("stratum", "quality", F.explode(F.array(*levels)).alias("x"))
        .groupBy("stratum", "x.rule", "x.level", "quality")
        .count(),
        "quality-counts",
    )
    strata = counts.select("stratum").distinct().count()

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        found = {"stratum": rows["stratum"].iloc[0]}
        for rule, (_, _, grid) in RULES.items():
            own = rows[rows["rule"] == rule]
            by = {q: np.zeros(len(grid) + 1, np.int64) for q in (0, 1)}
            for level, q, n in zip(own["level"], own["quality"], own["count"]):
                by[int(q > 0)][level] += n
            # Cutoff i from the lenient end rejects the documents of level len - i or more.
            over = {q: np.cumsum(x[::-1])[: len(grid)] for q, x in by.items()}
            at = best_cutoff(over[1], over[0], int(by[1].sum()), strata * len(RULES))
            found[rule] = None if at is None else grid[at]
        return pd.DataFrame([found]).astype({r: float for r in RULES})

    schema = "stratum string, " + ", ".join(f"{r} double" for r in RULES)
    # At most rules x levels x 2 rows a stratum.
    return stored(counts.groupBy("stratum").applyInPandas(choose, schema), "quality-cutoffs")


def judge(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """``measured`` with base_failed and kept, by the struct column m and the column stratum."""
    few = broadcast_if_small(cuts, rows=cuts.count(), row_bytes=100)
    same = F.col("x.stratum").eqNullSafe(F.col("c.stratum"))
    over = [F.coalesce(_share("m", r) > F.col(f"c.{r}"), F.lit(False)) for r in RULES]
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    return (
        measured.alias("x")
        .join(few.alias("c"), same, "left")
        .select("x.*", base_failed("m").alias("base_failed"), (~base_failed("m") & ~rejected).alias("kept"))
    )


def measured_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, m) of documents, stored: the texts are measured once."""
    rows = docs.select("doc_id", F.col("lang").alias("stratum"), measures(F.col("text")).alias("m"))
    return stored(rows, "quality-measures")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, columns as they were. Documents are stored next to their measures: a text is
    measured once, and doesn't move, as cutoffs go to the rows."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = inner.select("doc", F.col("doc.lang").alias("stratum"), measures(F.col("doc.text")).alias("m"))
    rows = stored(rows, "quality-rows")
    cuts = cutoffs(rows.select(F.col("doc.doc_id").alias("doc_id"), "stratum", "m"), labels)
    return judge(rows, cuts).where("kept").select("doc.*")
