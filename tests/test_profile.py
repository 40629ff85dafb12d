"""Profile and sample properties, and plan shapes."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscape.operators import cuts, frequent, profile, rows, sampling
from corpuscape.plans import flows
from corpuscape.sources import readers

SF = "/root/testdata/sf0.001"


def lengths(spark, values):
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "id long, word_count int")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_histograms_equal_numpy(spark):
    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 12_000, 500), rng.integers(3, 9, 50), np.full(7, 42)):
        table = lengths(spark, values)
        for bins in (7, 50, 100):
            found = profile.histogram_auto(table, "word_count", bins).orderBy("bin").toPandas()
            counts, edges = np.histogram(values, bins=bins)
            assert found["n"].tolist() == counts.tolist()
            assert np.allclose(found["hi"], edges[1:])
        found = profile.histogram_fixed(table, "word_count").orderBy("bin").toPandas()
        assert found["n"].tolist() == np.histogram(values, bins=np.arange(0, 10_001, 500))[0].tolist()


def test_band_histograms_equal_numpy(spark):
    values = np.array([0, 24, 25, 499, 500, 501, 524, 525, 975, 999, 1000, 1001])
    found = profile.histogram_bands(lengths(spark, values)).orderBy("lo").toPandas()
    low, high = values[values <= 500], values[(values > 500) & (values <= 1000)]
    expected = np.r_[np.histogram(low, np.arange(0, 501, 25))[0], np.histogram(high, np.arange(500, 1001, 25))[0]]
    assert found["n"].tolist() == expected.tolist()


def test_cdf_ends_at_one(spark):
    curve = profile.length_cdf(lengths(spark, range(100))).orderBy("bin").collect()
    assert curve[-1]["share"] == 1.0 and curve[-1]["cumulative"] == 100


def test_nth_smallest_in_rounds(spark, monkeypatch):
    table = spark.range(0, 1000).select(((F.col("id") * 7919) % 1009).alias("k")).repartition(5)
    expected = sorted((i * 7919) % 1009 for i in range(1000))
    monkeypatch.setattr(cuts, "FEW_KEYS", 3)
    monkeypatch.setattr(cuts, "RANGES", 4)
    for n in (4, 500, 1000, 2000):
        found = spark.range(1).select(cuts.nth_smallest(table, n).alias("v")).first()["v"]
        assert found == expected[min(n, 1000) - 1]


def test_samples_are_exact_and_stable(spark, monkeypatch):
    table = spark.range(0, 1000)
    once = {r["id"] for r in sampling.exact_sample(table, 300).collect()}
    monkeypatch.setattr(cuts, "FEW_KEYS", 10)
    again = {r["id"] for r in sampling.exact_sample(table.repartition(13), 300).collect()}
    assert len(once) == 300 and once == again
    assert sampling.exact_sample(table, 5000).count() == 1000
    split = sampling.train_test_split(table).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"test": 200, "train": 800}
    assert readers.first_fraction(table, order="id").agg(F.max("id"), F.count("*")).first() == (499, 500)


def test_stratified_sample_of_a_hot_cluster(spark):
    table = spark.range(0, 5000).select("id", F.when(F.col("id") < 4000, 1).otherwise(F.col("id") % 7).alias("cluster"))
    sizes = sampling.cluster_stratified_sample(table, 10, 50).groupBy("cluster").count().collect()
    assert all(r["count"] == 50 for r in sizes) and len(sizes) == 7
    examples = sampling.cluster_examples(table.withColumn("title", F.col("id").cast("string")))
    assert all(len(r["example_titles"]) == 5 for r in examples.collect())
    assert "WindowGroupLimit" in plan(examples)


def test_plans(spark):
    docs = readers.scan_parquet(spark, f"{SF}/documents.parquet").withColumnRenamed("doc_id", "id")
    measured = rows.measure(docs)
    top = profile.top_tokens_corpus(docs)
    assert "TakeOrderedAndProject" in plan(top) and "Python" not in plan(top)
    cleaned = rows.remove_stopwords(docs, ["der", "die"] * 20)
    assert "Exchange" not in plan(cleaned) and "Python" not in plan(cleaned)
    narrow = plan(readers.scan_parquet_columns(spark, f"{SF}/documents.parquet", ["doc_id"]))
    assert "ReadSchema: struct<doc_id:bigint>" in narrow
    assert "text" not in plan(profile.corpus_count(docs))
    described = plan(profile.describe_lengths(measured))
    assert described.count("Exchange") == 1


def test_texts_are_read_once_for_a_histogram(spark):
    docs = readers.scan_parquet(spark, f"{SF}/documents.parquet").withColumnRenamed("doc_id", "id")
    found = profile.histogram_auto(rows.measure(docs), "word_count")
    found.collect()
    assert "ReusedExchange" in plan(found)


def most_frequent_by_hand(arrays, k):
    counts = Counter(x for a in arrays if a for x in a if x is not None)
    return sorted(counts.items(), key=lambda p: (-p[1], p[0]))[:k]


@pytest.mark.parametrize("parts,list_values", [(1, 1_000_000), (7, 50), (40, 1_000_000)])
def test_most_frequent_is_exact(spark, parts, list_values):
    rng = np.random.default_rng(parts)
    # A steep head, a flat tail of ties, and values that only one task holds.
    arrays = [[f"w{x}" for x in rng.zipf(1.3, 30) % 5000] + [f"tie{i % 90}"] for i in range(900)]
    arrays += [None, [], [None, "w1"]] + [["alone"] * 60]
    table = spark.createDataFrame([(a,) for a in arrays], "v array<string>").repartition(parts)
    for k in (1, 25, 120, 10_000):
        found = [tuple(r) for r in frequent.most_frequent(table, "v", k, list_values).collect()]
        assert found == most_frequent_by_hand(arrays, k)


def test_most_frequent_moves_candidates_only(spark):
    rng = np.random.default_rng(3)
    arrays = [[f"w{x}" for x in rng.zipf(1.3, 200)] + [f"u{i}_{j}" for j in range(20)] for i in range(1000)]
    table = spark.createDataFrame([(a,) for a in arrays], "v array<string>").repartition(8)
    lists = frequent.count_lists(table, "v", 20)
    assert lists.n_lists == 8
    vocabulary, held = lists.rows.agg(F.count_distinct("value"), F.count("*")).first()
    assert vocabulary > 20_000 and lists.rows.where("leads").count() == 8 * 20
    assert 20 <= frequent.candidates(lists).count() <= 60 < held / 100


def test_most_frequent_of_nothing(spark):
    table = spark.createDataFrame([], "v array<string>")
    assert frequent.most_frequent(table, "v", 5).collect() == []


def test_view_of_drawn_clusters(spark):
    rng = np.random.default_rng(8)
    data = [(i, int(i % 4), rng.normal(size=6).tolist()) for i in range(200)]
    table = spark.createDataFrame(data, "id long, cluster int, embedding array<double>")
    view = flows.cluster_view(table, 3, 20).toPandas()
    assert len(view) == 60 and view.groupby("cluster").size().tolist() == [20, 20, 20]
    x = np.stack(view["embedding"].to_numpy())
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(view[["x3d", "y3d", "z3d"]]), np.abs(u[:, :3] * s[:3]), atol=1e-8)
