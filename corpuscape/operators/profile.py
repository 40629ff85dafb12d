"""Counts, length statistics, histograms and token reports.

Lengths are integers with few distinct values, so the statistics are taken from a table
``(value, n)`` built by one map-side combined aggregation over the corpus. Where a report needs
the range of the data first, it reads that same table again and Spark reuses its exchange: the
texts are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscape import constants as c
from corpuscape.functions.text import small_number_count, tokenize_words
from corpuscape.operators.frequent import most_frequent
from corpuscape.operators.rows import band_label, length_bands, token_range
from corpuscape.operators.sampling import exact_sample

QUARTILES = (0.25, 0.5, 0.75)


def frequencies(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """``(value, n)``, or ``(by, value, n)``: how often each value occurs."""
    keys = [F.col(col).alias("value")] if by is None else [F.col(by), F.col(col).alias("value")]
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def share(part: Column, whole: Column) -> Column:
    return F.round(part / whole, 6)


# --- counts -------------------------------------------------------------------------------


def corpus_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_docs"))


def zero_word_report(df: DataFrame) -> DataFrame:
    zero = F.count_if(F.col("word_count") == 0)
    total = F.count("*")
    return df.agg(
        zero.alias("zero_docs"), total.alias("n_docs"), share(zero, total).alias("zero_share")
    )


def drop_report(df: DataFrame, min_words: int = 1) -> DataFrame:
    """What ``nonempty_docs`` would drop."""
    before = F.count("*")
    after = F.count_if(F.col("word_count") >= min_words)
    return df.agg(
        before.alias("before"),
        after.alias("after"),
        (before - after).alias("dropped"),
        share(before - after, before).alias("dropped_share"),
    )


def over_word_limit(df: DataFrame, col: str = "word_count", n: int = c.LONG_DOC_WORDS) -> DataFrame:
    return df.agg(F.count_if(F.col(col) > n).alias("n_over"))


def over_token_limit(df: DataFrame, n: int = c.MODEL_TOKEN_LIMIT) -> DataFrame:
    return over_word_limit(df, "token_count", n)


def band_counts(df: DataFrame, edges: Sequence[int] = c.BAND_EDGES) -> DataFrame:
    band = band_label(F.col("word_count"), edges).alias("band")
    return df.groupBy(band).agg(F.count("*").alias("n_docs"))


def total_words(df: DataFrame, col: str = "word_count") -> DataFrame:
    return df.agg(F.sum(col).alias("total_words"))


def removed_numbers(df: DataFrame, text: str = "text") -> DataFrame:
    return df.agg(F.sum(small_number_count(F.col(text))).alias("removed"))


def word_occurrences(df: DataFrame, text: str = "text", word: str = c.PROBE_WORD) -> DataFrame:
    """Whole-word, case-sensitive hits of one word in all texts."""
    hits = F.size(F.filter(tokenize_words(F.col(text)), lambda t: t == F.lit(word)))
    return df.agg(F.sum(hits).alias("occurrences"))


def chars_by_tokens(df: DataFrame) -> DataFrame:
    return df.groupBy("token_count").agg(
        F.round(F.avg("char_count"), 6).alias("mean_chars"), F.count("*").alias("n_docs")
    )


def avg_chars_in_range(df: DataFrame, lo: int = c.TOKEN_RANGE[0], hi: int = c.TOKEN_RANGE[1]) -> DataFrame:
    return token_range(df, lo, hi).agg(F.round(F.avg("char_count"), 6).alias("mean_chars"))


def long_doc_median(df: DataFrame, col: str = "word_count", n: int = c.LONG_DOC_WORDS) -> DataFrame:
    long = frequencies(df.where(F.col(col) > n), col)
    return long.agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("median_words"))


def long_doc_mean(df: DataFrame, col: str = "word_count", n: int = c.LONG_DOC_WORDS) -> DataFrame:
    return df.where(F.col(col) > n).agg(F.round(F.avg(col), 6).alias("mean_words"))


# --- distributions ------------------------------------------------------------------------


def describe_lengths(df: DataFrame, cols: Sequence[str] = ("char_count", "word_count"), approximate: bool = False) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, one row per column.

    All columns are described in a single pass. Quartiles are exact and interpolated; the
    aggregation keeps one counter per distinct length. ``approximate`` uses a sketch instead,
    for columns with unbounded distinct values.
    """
    levels = F.array(*[F.lit(q) for q in QUARTILES])

    def summary(col: str) -> Column:
        quartiles = (
            F.percentile_approx(col, list(QUARTILES), 10_000)
            if approximate
            else F.percentile(F.col(col), levels)
        )
        return F.struct(
            F.lit(col).alias("column"),
            F.count(col).alias("n"),
            F.round(F.avg(col), 6).alias("mean"),
            F.round(F.stddev_samp(col), 6).alias("std"),
            F.min(col).cast("double").alias("min"),
            quartiles[0].cast("double").alias("q1"),
            quartiles[1].cast("double").alias("median"),
            quartiles[2].cast("double").alias("q3"),
            F.max(col).cast("double").alias("max"),
        )

    one_row = df.agg(F.array(*[summary(col) for col in cols]).alias("summaries"))
    return one_row.select(F.inline("summaries"))


def _bins(df: DataFrame, counted: DataFrame, bins: int) -> DataFrame:
    """Every bin of 1..bins with its count; empty bins count zero. At most ``bins`` rows."""
    all_bins = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    joined = all_bins.join(F.broadcast(counted), "bin", "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0)))


def histogram_auto(df: DataFrame, col: str, bins: int = c.HISTOGRAM_BINS) -> DataFrame:
    """Equal bins over min..max: ``(bin, lo, hi, n)``, the last bin closed on the right.

    Edges are ``min + i * width`` in double precision and a value is placed by comparison with
    them, as numpy does. A single-valued column gets the range value ± 0.5.
    """
    freq = frequencies(df, col)
    # Summing n keeps the counted table in the subquery, so both readers share its exchange.
    ends = freq.agg(
        F.struct(
            F.min("value").cast("double").alias("least"),
            F.max("value").cast("double").alias("most"),
            F.sum("n").alias("total"),
        ).alias("ends")
    ).scalar()
    flat = F.col("ends.least") == F.col("ends.most")
    first = F.when(flat, F.col("ends.least") - 0.5).otherwise(F.col("ends.least"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("ends.most") - F.col("ends.least"))
    layout = {"first": first, "width": width / F.lit(float(bins))}
    ranged = freq.withColumn("ends", ends).withColumns(layout)
    x, lo, step = F.col("value").cast("double"), F.col("first"), F.col("width")
    guess = F.least(F.floor((x - lo) / step), F.lit(bins - 1))
    placed = (
        F.when(x < lo + guess * step, guess - 1)
        .when((x >= lo + (guess + 1) * step) & (guess != bins - 1), guess + 1)
        .otherwise(guess)
    )
    counted = ranged.groupBy((placed + 1).cast("int").alias("bin")).agg(F.sum("n").alias("n"))
    full = _bins(df, counted, bins).withColumn("ends", ends).withColumns(layout)
    edge = lambda i: F.round(F.col("first") + i * F.col("width"), 6)
    return full.select(
        "bin", edge(F.col("bin") - 1).alias("lo"), edge(F.col("bin")).alias("hi"), "n"
    )


def histogram_fixed(
    df: DataFrame,
    col: str,
    lo: int = c.LENGTH_RANGE[0],
    hi: int = c.LENGTH_RANGE[1],
    step: int = c.LENGTH_STEP,
) -> DataFrame:
    """Fixed edges lo, lo+step, .., hi. Values outside are left out; ``hi`` is in the last bin."""
    bins = (hi - lo) // step
    inside = df.where(F.col(col).between(lo, hi))
    number = F.least(F.floor((F.col(col) - lo) / step) + 1, F.lit(bins)).cast("int")
    counted = inside.groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    left = lo + (F.col("bin") - 1) * step
    return _bins(df, counted, bins).select(
        "bin", left.cast("long").alias("lo"), (left + step).cast("long").alias("hi"), "n"
    )


def histogram_short(df: DataFrame, col: str = "word_count", cap: int = c.SHORT_CAP, bins: int = c.SHORT_BINS) -> DataFrame:
    return histogram_auto(df.where(F.col(col) <= cap), col, bins)


def histogram_bands(
    df: DataFrame, col: str = "word_count", edges: Sequence[int] = c.BAND_EDGES, step: int = c.BAND_STEP
) -> DataFrame:
    """Two histograms in one pass: 0..low, and above low up to high, in bins of ``step``."""
    low, high = edges
    x = F.col(col)
    bins = high // step
    at_edge = F.when(x == low, F.lit(low // step)).when(x == high, F.lit(bins))
    number = F.coalesce(at_edge, F.floor(x / step) + 1).cast("int")
    counted = df.where(x.between(0, high)).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    left = (F.col("bin") - 1) * step
    band = F.when(left < low, F.lit(f"0-{low}")).otherwise(F.lit(f"{low}-{high}"))
    return _bins(df, counted, bins).select(
        band.alias("band"), left.cast("long").alias("lo"), (left + step).cast("long").alias("hi"), "n"
    )


def histogram_integer(df: DataFrame, col: str = "word_count", lo: int = 0, hi: int = c.TINY_DOC_WORDS) -> DataFrame:
    """One bin per integer in lo..hi."""
    counted = frequencies(df.where(F.col(col).between(lo, hi)), col)
    values = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("value"))
    joined = values.join(F.broadcast(counted), "value", "left")
    return joined.select("value", F.coalesce("n", F.lit(0)).alias("n"))


def boxplot_stats(df: DataFrame, col: str = "word_count", by: str | None = None) -> DataFrame:
    """Quartiles and the whiskers: the outermost values within 1.5 IQR of the box."""
    freq = frequencies(df, col, by)
    freq = freq if by is not None else freq.withColumn("all", F.lit("all"))
    key = by or "all"
    levels = F.array(*[F.lit(q) for q in QUARTILES])
    quartiles = freq.groupBy(key).agg(F.percentile(F.col("value"), levels, F.col("n")).alias("q"))
    boxed = freq.join(quartiles, key)
    q1, q3 = F.col("q")[0], F.col("q")[2]
    reach = c.WHISKER * (q3 - q1)
    stats = boxed.groupBy(key).agg(
        F.first(q1).alias("q1"),
        F.first(F.col("q")[1]).alias("median"),
        F.first(q3).alias("q3"),
        F.min(F.when(F.col("value") >= q1 - reach, F.col("value"))).alias("whisker_low"),
        F.max(F.when(F.col("value") <= q3 + reach, F.col("value"))).alias("whisker_high"),
        F.sum("n").alias("n_docs"),
    )
    return stats if by is not None else stats.drop("all")


def boxplot_bands(df: DataFrame, col: str = "word_count") -> DataFrame:
    return boxplot_stats(length_bands(df), col, "band")


def running_share(bins: DataFrame) -> DataFrame:
    """Cumulative count and share over a histogram. A histogram is a few rows, so the unkeyed
    window costs nothing."""
    so_far = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy())
    return bins.withColumns({"cumulative": so_far, "share": share(so_far, total)})


def length_cdf(df: DataFrame, col: str = "word_count", bins: int = c.CDF_BINS) -> DataFrame:
    """Share of documents up to the right edge of each bin."""
    curve = running_share(histogram_auto(df, col, bins))
    return curve.select("bin", F.col("hi").alias("edge"), "cumulative", "share")


# --- tokens -------------------------------------------------------------------------------


def token_counts(df: DataFrame, text: str = "text", lower: bool = True) -> DataFrame:
    source = F.lower(F.col(text)) if lower else F.col(text)
    return df.select(F.explode(tokenize_words(source)).alias("token")).groupBy("token").agg(
        F.count("*").alias("freq")
    )


def top_tokens(df: DataFrame, k: int, text: str = "text", lower: bool = True) -> DataFrame:
    """The most frequent tokens; ties in token order."""
    return token_counts(df, text, lower).orderBy(F.desc("freq"), "token").limit(k)


def top_tokens_corpus(df: DataFrame, text: str = "text", k: int = c.TOP_CORPUS_TOKENS) -> DataFrame:
    return top_tokens(df, k, text)


def top_tokens_threshold(df: DataFrame, text: str = "text", k: int = c.TOP_CORPUS_TOKENS, lower: bool = True) -> DataFrame:
    """As ``top_tokens``, for vocabularies too large to shuffle: about k counts of a task move."""
    source = F.lower(F.col(text)) if lower else F.col(text)
    found = most_frequent(df.select(tokenize_words(source).alias("tokens")), "tokens", k)
    return found.withColumnsRenamed({"value": "token", "n": "freq"})


def top_tokens_cleaned(df: DataFrame, text: str = "text_cleaned", k: int = c.TOP_CLEANED_TOKENS) -> DataFrame:
    """Over text that is already lower-case."""
    return top_tokens(df, k, text, lower=False)


def top_tokens_short(df: DataFrame, text: str = "text", k: int = c.TOP_SHORT_TOKENS, n: int = c.TINY_DOC_WORDS) -> DataFrame:
    return top_tokens(df.where(F.col("word_count") <= n), k, text)


def top_tokens_sample(
    df: DataFrame,
    text: str = "text",
    k: int = c.TOP_SAMPLE_TOKENS,
    sample: int = c.TOKEN_SAMPLE,
    key: str = "id",
    seed: int = c.SEED,
) -> DataFrame:
    """Over a seeded sample of ``sample`` documents, drawn by key before any text moves."""
    return top_tokens(exact_sample(df, sample, seed, key), k, text)


# --- clusters -----------------------------------------------------------------------------


def cluster_sizes(df: DataFrame, noise: bool = True, order: str = "id") -> DataFrame:
    """Rows per cluster, by cluster id or (``order="size"``) largest first."""
    rows = df if noise else df.where(F.col("cluster") != c.NOISE)
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("n_rows"))
    keys = ["cluster"] if order == "id" else [F.desc("n_rows"), "cluster"]
    return sizes.orderBy(*keys)


def cluster_count(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of clusters without noise."""
    counter = F.approx_count_distinct if approximate else F.count_distinct
    real = F.when(F.col("cluster") != c.NOISE, F.col("cluster"))
    return df.agg(counter(real).alias("n_clusters"))


def noise_share(df: DataFrame) -> DataFrame:
    noise = F.count_if(F.col("cluster") == c.NOISE)
    return df.agg(noise.alias("noise_rows"), share(noise, F.count("*")).alias("noise_share"))
