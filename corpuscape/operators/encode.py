"""Turning texts into vectors in batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from corpuscape import constants as c
from corpuscape.functions.text import prefix_passage
from corpuscape.functions.vectors import l2_normalize, sign_of_hash
from corpuscape.operators.tfidf import term_counts, tfidf_fit
from corpuscape.runtime import broadcast_if_small

DEFAULT_DIMS = 64
WORD_BITS = 32


def embed_batches(
    df: DataFrame,
    text: str = "text",
    key: str = "id",
    encoder: Callable[[], Callable] | None = None,
    batch: int = c.ENCODE_BATCH,
    prefix: str = c.PASSAGE_PREFIX,
    out: str = "embedding",
    **fit,
) -> DataFrame:
    """Add a vector per document.

    ``encoder`` loads a model once per Python worker and returns a function from an array of
    texts to a matrix; each text gets the passage prefix first. Without one, the default encoder
    ``project_terms`` runs on Spark alone.
    """
    if encoder is not None:
        encode = predict_batch_udf(encoder, return_type=ArrayType(FloatType()), batch_size=batch)
        return df.withColumn(out, encode(prefix_passage(F.col(text), prefix)))
    vectors = project_terms(df, text, key, **fit).withColumnRenamed("vector", out)
    zero = F.array_repeat(F.lit(0.0), DEFAULT_DIMS)
    return df.join(vectors, key, "left").withColumn(out, F.coalesce(out, zero))


def project_terms(
    df: DataFrame,
    text: str = "text",
    key: str = "id",
    max_features: int = c.MAX_FEATURES,
    **fit,
) -> DataFrame:
    """Signed random projection of tf-idf weights to 64 dimensions, unit length.

    The sign of a term in dimension j is bit j of the term's MD5. It is taken once per vocabulary
    term; the 64 sums of a document are one aggregation, combined before its shuffle.
    """
    vocab = tfidf_fit(df, text, key, max_features, **fit)
    digest = F.md5(F.col("term").cast("binary"))
    word = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    hashed = vocab.select("term", "idf", word(0).alias("h0"), word(1).alias("h1"))
    counts = term_counts(df, text, key)
    listed = broadcast_if_small(hashed, rows=max_features)
    rows = counts.join(listed, "term").withColumn("weight", F.col("tf") * F.col("idf"))
    sums = [
        F.sum(F.col("weight") * sign_of_hash(F.col(f"h{j // WORD_BITS}"), j % WORD_BITS)).alias(f"d{j}")
        for j in range(DEFAULT_DIMS)
    ]
    wide = rows.groupBy(key).agg(*sums)
    vector = F.array(*[f"d{j}" for j in range(DEFAULT_DIMS)])
    return wide.select(key, l2_normalize(vector).alias("vector"))
