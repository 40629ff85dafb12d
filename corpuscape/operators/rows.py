"""Projections, filters and key joins over documents and clustered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscape import constants as c
from corpuscape.functions.text import (
    char_count,
    keep_unlisted,
    tokenize_words,
    word_count,
)
from corpuscape.runtime import broadcast_if_small

def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``char_count`` and ``word_count``."""
    return df.withColumns(
        {"char_count": char_count(F.col(text)), "word_count": word_count(F.col(text))}
    )


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def select_pair(df: DataFrame, a: str = "word_count", b: str = "char_count") -> DataFrame:
    return df.select(a, b)


def preview(df: DataFrame, n: int = 5, order: str = "id") -> DataFrame:
    """The first rows in key order."""
    return df.orderBy(order).limit(n)


def clipped_char_total(df: DataFrame, text: str = "text", cap: int = c.CLIP_CHARS) -> DataFrame:
    clipped = F.least(F.length(text), F.lit(cap))
    return df.agg(F.sum(clipped).alias("total_chars"))


def cast_vectors(df: DataFrame, v: str = "embedding", dim: int | None = None) -> DataFrame:
    """Vectors as ``array<float>``; a row of another length fails the job."""
    cast = F.col(v).cast("array<float>")
    if dim is not None:
        message = F.lit(f"a vector does not have {dim} components")
        cast = F.when(F.size(v) == dim, cast).otherwise(F.raise_error(message))
    return df.withColumn(v, cast)


def nonempty_docs(df: DataFrame, min_words: int = 1) -> DataFrame:
    return df.where(F.col("word_count") >= min_words)


def docs_up_to(df: DataFrame, n: int = c.SHORT_CAP) -> DataFrame:
    return df.where(F.col("word_count") <= n)


def short_docs(df: DataFrame, n: int = c.TINY_DOC_WORDS) -> DataFrame:
    return docs_up_to(df, n)


def band_label(words: Column, edges: Sequence[int] = c.BAND_EDGES) -> Column:
    """Name of the length band a word count falls in: ``0-500``, ``500-1000``, ``1000+``."""
    low, high = edges
    return (
        F.when(words <= low, F.lit(f"0-{low}"))
        .when(words <= high, F.lit(f"{low}-{high}"))
        .otherwise(F.lit(f"{high}+"))
    )


def length_bands(df: DataFrame, edges: Sequence[int] = c.BAND_EDGES) -> DataFrame:
    """Rows tagged with each subset they belong to; the third subset covers the first two."""
    low, high = edges
    words = F.col("word_count")
    narrow = band_label(words, edges)
    subsets = F.when(words <= high, F.array(narrow, F.lit(f"0-{high}"))).otherwise(F.array())
    return df.withColumn("band", F.explode(subsets))


def token_range(df: DataFrame, lo: int = c.TOKEN_RANGE[0], hi: int = c.TOKEN_RANGE[1]) -> DataFrame:
    return df.where(F.col("token_count").between(lo, hi))


def without_noise(df: DataFrame) -> DataFrame:
    return df.where(F.col("cluster") != c.NOISE)


def cluster_semi_join(df: DataFrame, ids: DataFrame, bound: int | None = None) -> DataFrame:
    """Rows whose cluster is listed in ``ids``, which has at most ``bound`` rows if that is known."""
    return df.join(broadcast_if_small(ids.select("cluster"), rows=bound), "cluster", "left_semi")


def in_clusters(df: DataFrame, ids: Sequence[int] | DataFrame) -> DataFrame:
    """Rows of chosen clusters, given as a short list or as a table."""
    if isinstance(ids, DataFrame):
        return cluster_semi_join(df, ids)
    return df.where(F.col("cluster").isin(list(ids)))


def attach_by_key(left: DataFrame, right: DataFrame, on: str = "id") -> DataFrame:
    """Put result columns back on rows by key. Both sides have one row per key."""
    return left.join(right, on)


def attach_labels(df: DataFrame, labels: DataFrame, on: str = "id") -> DataFrame:
    return attach_by_key(df, labels.select(on, "cluster"), on)


def distinct_clusters(df: DataFrame) -> DataFrame:
    return df.select("cluster").distinct()


def remove_stopwords(df: DataFrame, stop: Sequence[str] | DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by its lower-cased word tokens outside a stoplist, joined by spaces.

    The list becomes a literal set inside the projection, so nothing is shuffled; a table of words is read
    into it. For a list that is too long for that, ``stopword_anti_join`` gives the same texts.
    """
    if isinstance(stop, DataFrame):
        stop = [r["word"] for r in stop.select("word").distinct().collect()]
    tokens = tokenize_words(F.lower(F.col(text)))
    return df.withColumn(text, F.array_join(keep_unlisted(tokens, [w.lower() for w in stop if w]), " "))


def stopword_anti_join(
    df: DataFrame, stop: DataFrame, text: str = "text", key: str = "id", bound: int | None = None
) -> DataFrame:
    """The join form for a stoplist of any length: ``(key, text)``, a row per row.

    The list, of at most ``bound`` words if that is known, is matched against the distinct tokens of a
    document, so a word that fills the corpus is joined once per document instead of once per
    occurrence. Rows find their words again by key and text hash, so null and repeated keys are kept.
    """
    docs = df.select(
        key, tokenize_words(F.lower(F.col(text))).alias("tokens"), F.xxhash64(text).alias("_hash")
    )
    words = stop.select(F.lower("word").alias("word")).distinct()
    seen = docs.select(key, "_hash", F.explode(F.array_distinct("tokens")).alias("word"))
    hits = seen.join(broadcast_if_small(words, rows=bound), "word", "left_semi")
    listed = hits.groupBy(F.col(key).alias("_key"), F.col("_hash").alias("_same")).agg(
        F.collect_set("word").alias("listed")
    )
    kept = F.filter(
        "tokens", lambda t: ~F.array_contains(F.coalesce("listed", F.array().cast("array<string>")), t)
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col("_hash").eqNullSafe(F.col("_same"))
    return docs.join(listed, same, "left").select(key, F.array_join(kept, " ").alias(text))
