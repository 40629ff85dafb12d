"""Small tables with what real ones hold: nulls, empty and long texts, copies, repeated rows, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import types as T

WORDS = "the of and stone river light garden window letter house winter summer night paper road glass".split()

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators use inside.
        *[T.StructField(c, T.StringType()) for c in ("id", "m", "kept", "stratum", "mix", "own", "found", "label", "key")],
    ]
)


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def documents(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(25, 120)) for _ in range(25)]
    texts: list[str | None] = [None, "", "   \n\t ", "x", "É" * 60, "a b c", "\x00" * 120, "\x00" * 55 + "z"]
    texts += base + base[:6]  # exact copies
    for text in base[:8]:  # near copies
        words = text.split()
        for _ in range(3):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts.append(" ".join(base[0].split()[:12] * 30))  # repeats itself
    texts.append("line of text here\n" * 40)
    texts.append(" ".join(w + "$#" for w in base[1].split()))
    texts.append(base[2].upper())
    texts.append("start " + base[3] + " middle ünï " + base[4][: len(base[4]) // 2])
    texts.append(prose(rng, 60_000))  # very long
    langs, sources = ["en", "de", None], ["a", "b", None, "c"]
    rows = [(i, t, langs[i % 3], sources[i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[10])  # a repeated row
    rows.append((None, base[5], "en", "a", 1))
    rows.append((None, base[6] + " more", None, None, None))
    rows.append((7, base[9], "en", "b", 1))  # an id with two texts
    extra = tuple("x" for _ in SCHEMA.names[5:])
    return [r + extra for r in rows]


def table(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def ids(rows: list[tuple]) -> list[tuple[int, str]]:
    """(id, text) with null ids below all others and null texts empty."""
    return [(-(2**63) + 1 if r[0] is None else r[0], r[1] or "") for r in rows]
