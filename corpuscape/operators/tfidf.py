"""TF-IDF weights of documents.

A row is a document: its terms are counted inside the row, from its sorted term array, so no text is
moved. What shuffles is one combined row per term for the vocabulary, and the (term, count) pairs of a
document where its norm or its arrays are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscape import constants as c
from corpuscape.functions.text import tokenize_terms
from corpuscape.functions.vectors import l2_normalize
from corpuscape.operators.cuts import nth_smallest
from corpuscape.runtime import broadcast_if_small, cut_lineage


def count_terms(text: Column) -> Column:
    """``array<struct<term, tf>>`` of one text, in term order; empty for a null text."""
    tokens = F.coalesce(F.sort_array(tokenize_terms(text)), F.array().cast("array<string>"))

    def runs(s: Column) -> Column:
        at = F.filter(
            F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s))).otherwise(F.array().cast("array<int>")),
            lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)),
        )
        pair = lambda a, p, k: F.struct(
            F.get(s, p - 1).alias("term"), (F.coalesce(F.get(a, k + 1), F.size(s) + 1) - p).cast("long").alias("tf")
        )
        return let(at, lambda a: F.transform(a, lambda p, k: pair(a, p, k)))

    return let(tokens, runs)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row: a lambda would compute it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counts(df: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """``(key, term, tf)`` for terms of two or more word characters."""
    return df.select(key, F.inline(count_terms(F.col(text))))


def tfidf_fit(
    df: DataFrame,
    text: str = "text",
    key: str = "id",
    max_features: int = c.MAX_FEATURES,
    min_df: int = c.MIN_DOC_FREQ,
    max_df: float = c.MAX_DOC_SHARE,
) -> DataFrame:
    """The vocabulary ``(term, df, cf, idf)``: terms in at least ``min_df`` documents and at most
    a share ``max_df`` of them, the ``max_features`` most frequent in the corpus, with
    ``idf = ln((1 + N) / (1 + df)) + 1``."""
    n_docs = df.count()
    stats = term_counts(df, text, key).groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf")
    )
    kept = cut_lineage(stats.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)))
    # The most frequent come first; equal counts in term order.
    place = F.struct((-F.col("cf")).alias("turned"), F.col("term").alias("tie"))
    top = kept
    if kept.count() > max_features:
        top = kept.where(place <= nth_smallest(kept.select(place.alias("place")), max_features))
    return top.withColumn("idf", F.log((1 + n_docs) / (1 + F.col("df"))) + 1)


def tfidf_vocab_join(counts: DataFrame, vocab: DataFrame, max_features: int = c.MAX_FEATURES) -> DataFrame:
    """Counts restricted to the vocabulary, weighted by idf. ``max_features`` is the limit that the
    vocabulary was made with, which bounds the broadcast."""
    listed = broadcast_if_small(vocab.select("term", "idf"), rows=max_features)
    joined = counts.join(listed, "term")
    return joined.withColumn("weight", F.col("tf") * F.col("idf")).drop("idf")


def tfidf_transform(
    df: DataFrame, vocab: DataFrame, text: str = "text", key: str = "id", max_features: int = c.MAX_FEATURES
) -> DataFrame:
    """Unit-length rows ``(key, term, weight)`` of the document-term matrix."""
    raw = tfidf_vocab_join(term_counts(df, text, key), vocab, max_features)
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("weight") / norm).alias("weight"))


def sparse_rows(
    df: DataFrame, vocab: DataFrame, text: str = "text", key: str = "id", max_features: int = c.MAX_FEATURES
) -> DataFrame:
    """The same matrix with one row per document: ``(key, terms array<int>, weights array<double>)``.

    Term numbers follow term order. A document without a listed term has empty arrays.
    """
    numbered = number_terms(vocab).select("term", "term_id", "idf")
    every = df.select(key, F.inline_outer(count_terms(F.col(text))))
    joined = every.join(broadcast_if_small(numbered, rows=max_features), "term", "left")
    pair = F.when(F.col("term_id").isNotNull(), F.struct("term_id", (F.col("tf") * F.col("idf")).alias("w")))
    grouped = joined.groupBy(key).agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    terms = F.transform("pairs", lambda p: p["term_id"])
    weights = l2_normalize(F.transform("pairs", lambda p: p["w"]))
    return grouped.select(key, terms.alias("terms"), weights.alias("weights"))


def number_terms(vocab: DataFrame) -> DataFrame:
    """Add ``term_id`` 0, 1, .. in term order; a vocabulary is bounded by ``max_features``."""
    return vocab.withColumn("term_id", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))
