"""The operators composed end to end."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscape import constants as c
from corpuscape.functions.text import (
    Tokenizer,
    cap_chars_word_boundary,
    cap_words,
    char_count,
    count_tokens,
    remove_small_numbers,
    truncate_tokens,
    word_count,
)
from corpuscape.functions.vectors import l2_normalize, spread_vector
from corpuscape.operators.density import hdbscan_cluster
from corpuscape.operators.graph import graph_reduce, neighbor_graph
from corpuscape.operators.kmeans import (
    best_k_scan,
    component_term_join,
    kmeans_fit,
    kmeans_large_k,
    nearest_centroid,
    top_terms_per_cluster,
)
from corpuscape.operators.layout import graph_layout
from corpuscape.operators.neighbours import knn_graph
from corpuscape.operators.profile import describe_lengths
from corpuscape.operators.reduce import SvdModel, pca_fit, pca_project, svd_project, truncated_svd
from corpuscape.operators.rows import attach_by_key, measure, nonempty_docs, remove_stopwords
from corpuscape.operators.sampling import cluster_stratified_sample
from corpuscape.operators.tfidf import number_terms, sparse_rows, tfidf_fit
from corpuscape.runtime import broadcast_if_small, cut_lineage, stored
from corpuscape.sources.readers import scan_jsonl_dir, scan_parquet
from corpuscape.sources.writers import sink_parquet


def clean_corpus(docs: DataFrame, stop: Sequence[str] | DataFrame, min_words: int = 1) -> DataFrame:
    """``id, title, text``: documents with words, without stopwords, measured again. One map."""
    kept = nonempty_docs(measure(docs), min_words)
    cleaned = remove_stopwords(kept.select("id", "title", "text"), stop)
    return measure(cleaned)


class CleanCorpus(NamedTuple):
    """The written documents, and the lengths of texts with words before and after cleaning, one row per
    measure."""

    docs: DataFrame
    before: DataFrame
    after: DataFrame


def clean_lines(
    spark: SparkSession, dump: str, out: str, stop: Sequence[str] | DataFrame, min_words: int = 1
) -> CleanCorpus:
    """A tree of JSON lines to a cleaned Parquet corpus in ``out``, described before and after.

    Lines are parsed once: parsed documents are a stage table, which the cleaning and the first description
    read; the second description reads two columns of lengths from ``out``.
    """
    parsed = stored(nonempty_docs(measure(scan_jsonl_dir(spark, dump)), min_words), "parsed")
    cleaned = remove_stopwords(parsed.select("id", "title", "text"), stop)
    sink_parquet(measure(cleaned), out)
    docs = scan_parquet(spark, out)
    return CleanCorpus(docs, describe_lengths(parsed), describe_lengths(nonempty_docs(docs, min_words)))


def cluster_view(
    rows: DataFrame,
    clusters: int = c.STRATIFIED_CLUSTERS,
    n: int = c.STRATIFIED_ROWS,
    v: str = "embedding",
    seed: int = c.SEED,
) -> DataFrame:
    """Up to ``n`` rows of each of some drawn clusters with their coordinates on three axes fitted to
    those rows: the input with ``x3d, y3d, z3d``. The drawn rows are bounded by ``clusters * n``."""
    drawn = stored(cluster_stratified_sample(rows, clusters, n, seed), "drawn")
    placed = pca_project(drawn, 3, v, "_view")
    return placed.select("*", *spread_vector(F.col("_view"), ["x3d", "y3d", "z3d"])).drop("_view")


def limit_tokens(
    docs: DataFrame,
    stop: Sequence[str] | DataFrame,
    words: int = c.WORD_CAP,
    chars: int = c.CHAR_CAP,
    tokens: int = c.TOKEN_CAP,
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """Texts that fit an encoder: small numbers and stopwords out, then the word cap, the
    character cap with its token count, and the token cap. One map."""
    numberless = docs.select("id", "title", remove_small_numbers(F.col("text")).alias("text_cleaned"))
    counted = numberless.withColumn("word_count_cleaned", word_count(F.col("text_cleaned")))
    cleaned = remove_stopwords(counted, stop, "text_cleaned")
    capped = cleaned.withColumn("text_350_words", cap_words(F.col("text_cleaned"), words))
    by_words = F.col("text_350_words")
    by_chars = capped.withColumns(
        {
            "char_count_350": char_count(by_words),
            "text_2015char_clean": cap_chars_word_boundary(by_words, chars),
        }
    )
    return by_chars.withColumns(
        {
            "token_count_350_char": count_tokens(F.col("text_2015char_clean"), tokenizer),
            "text_exact_500": truncate_tokens(by_words, tokens, tokenizer),
        }
    )


def component_rows(vocab: DataFrame, model: SvdModel) -> DataFrame:
    """Components as long rows ``(component, term, value)``: terms meet their rows of the model by number."""
    named = number_terms(vocab).select("term", "term_id")
    loads = model.vectors.term_rows().join(broadcast_if_small(named, rows=model.vectors.n_terms), "term_id")
    long = loads.select("lo", F.posexplode("loads").alias("at", "value"), "term")
    return long.select((F.col("lo") + F.col("at")).alias("component"), "value", "term")


def centre_components(centres: DataFrame) -> DataFrame:
    """k-means centres as long rows ``(cluster, component, value)``."""
    return centres.select("cluster", F.posexplode("centre").alias("component", "value"))


def group_topics(
    docs: DataFrame,
    components: int = c.SVD_COMPONENTS,
    k_range: tuple[int, int] = c.K_RANGE,
    seed: int = c.SEED,
    **fit,
) -> Topics:
    """TF-IDF, truncated SVD, the best k by silhouette, k-means."""
    vocab = cut_lineage(tfidf_fit(docs, **fit))
    n_terms = vocab.count()
    sparse = sparse_rows(docs, vocab, max_features=n_terms).persist()
    svd = truncated_svd(sparse, n_terms, components, seed)
    reduced = cut_lineage(svd_project(sparse, svd))
    sparse.unpersist()
    scores = cut_lineage(best_k_scan(reduced, "reduced", *k_range, seed=seed))
    best = scores.where("best").first()["k"]
    labelled, found = kmeans_fit(reduced, best, "reduced", seed)
    weights = component_term_join(centre_components(found), component_rows(vocab, svd), bound=best * components)
    plane = pca_fit(reduced, 2, "reduced")
    centres = plane.project(found, "centre", "plane")
    xy = spread_vector(F.col("plane"), ["x", "y"])
    return Topics(
        plane.project(labelled, "reduced", "plane").select("id", "cluster", *xy),
        top_terms_per_cluster(weights),
        scores,
        centres.select("cluster", *xy),
    )


class Topics(NamedTuple):
    """Documents ``(id, cluster, x, y)``, top terms of each cluster, ``(k, silhouette, best)`` of every k that
    was tried, and the centres ``(cluster, x, y)`` in the same plane."""

    docs: DataFrame
    terms: DataFrame
    scores: DataFrame
    centres: DataFrame


def group_vectors(
    rows: DataFrame, k: int = c.LARGE_K, v: str = "embedding", seed: int = c.SEED
) -> DataFrame:
    """Unit vectors, k-means with many centres, nearest centre, coordinates in the plane:
    the input with ``cluster, x, y``."""
    unit = rows.withColumn("_unit", l2_normalize(F.col(v)))
    centres = kmeans_large_k(unit, k, "_unit", seed=seed)
    assigned = nearest_centroid(unit, centres, "_unit").drop("distance")
    plane = pca_project(assigned, 2, "_unit", "_plane")
    return plane.select("*", *spread_vector(F.col("_plane"), ["x", "y"])).drop("_unit", "_plane")


def group_by_density(
    rows: DataFrame,
    dims: int = c.GRAPH_DIMS,
    pca_dims: int | None = c.PCA_DIMS,
    neighbours: int = c.NEIGHBOURS,
    min_cluster_size: int = c.COARSE_MIN_CLUSTER_SIZE,
    v: str = "embedding",
    seed: int = c.SEED,
    layout: bool = False,
) -> DataFrame:
    """PCA (left out where ``pca_dims`` is None), neighbour graph, ``dims`` graph coordinates,
    density clusters: the input with ``umap_0 .. umap_n`` and ``cluster``.

    Coordinates are spectral, or those of the force layout that starts from them. Spectral graph coordinates are brought to unit length, so that distance compares directions as the
    cosine graph does.
    """
    wide = rows if pca_dims is None else pca_project(rows, pca_dims, v, "_flat")
    knn = knn_graph(wide, neighbours, v if pca_dims is None else "_flat", seed=seed)
    weights = neighbor_graph(knn)
    if layout:
        placed = graph_layout(weights, dims, seed)
    else:
        coords = graph_reduce(weights, dims, seed)
        placed = coords.withColumn("coords", l2_normalize(F.col("coords")))
    labelled = hdbscan_cluster(placed, min_cluster_size, v="coords", seed=seed)
    names = [f"umap_{i}" for i in range(dims)]
    columns = labelled.select("id", *spread_vector(F.col("coords"), names), "cluster")
    return attach_by_key(rows.drop("cluster"), columns)
