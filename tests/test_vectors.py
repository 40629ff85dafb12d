"""Vector operators against numpy brute force, with copies, hot cells and split components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscape import runtime
from corpuscape.functions.vectors import l2_normalize
from corpuscape.operators import density, encode, graph, kmeans, neighbours, reduce, rows, sampling, tfidf
from corpuscape.plans import flows

SF = "/root/testdata/sf0.001"


def table(spark, x, extra=None):
    data = [(i, [float(a) for a in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(data, "id long, embedding array<double>")


def blobs(seed=0, copies=40):
    """Three tight groups far apart, loose points, and many copies of one row."""
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0, 0], [50, 0, 0, 0], [0, 80, 0, 0]])
    tight = [c + rng.normal(0, 0.4, (30, 4)) for c in centres]
    loose = rng.uniform(-20, 100, (12, 4))
    return np.vstack([*tight, loose, np.repeat(tight[0][:1], copies, axis=0)])


def distances(x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return d


@pytest.fixture
def tiny_cells(monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 12)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 9)
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 10)


def check_knn(spark, x, k):
    found = neighbours.knn_graph(table(spark, x), k, metric="euclidean").toPandas().sort_values(["id", "rank"])
    d = distances(x).round(9)
    for i in range(len(x)):
        mine = found[found["id"] == i]
        order = np.lexsort((np.arange(len(x)), d[i]))[:k]
        assert mine["neighbour"].tolist() == order.tolist(), i
        assert np.allclose(mine["distance"], d[i][order], atol=1e-8)


def test_knn_with_copies_and_pruning(spark, tiny_cells):
    check_knn(spark, blobs(), 7)


def test_knn_moves_a_vector_a_bounded_number_of_times(spark, monkeypatch):
    """Vectors without structure: every query has to see all 60 cells, but isn't sent once for each."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 10)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 100)
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 200)
    moved, best = spark.sparkContext.accumulator(0), neighbours._k_best

    def counting(k):
        def compare_with(shared):
            def compare(asked, held):
                moved.add(asked.num_rows + held.num_rows)
                return best(k)(shared)(asked, held)

            return compare

        return compare_with

    monkeypatch.setattr(neighbours, "_k_best", counting)
    x = np.random.default_rng(12).normal(size=(600, 24))
    check_knn(spark, x, 5)
    # At most 7 bands, one more than six times 100 rows fill, and 3 chunks.
    assert 600 * 2 <= moved.value <= 600 * (7 + 3)


def test_knn_cell_larger_than_a_band(spark):
    cells = neighbours.Cells(np.arange(4), np.arange(8.0).reshape(4, 2), np.array([5.0, 95, 0, 12]), np.ones(4))
    bands, pieces = neighbours.band_layout(cells, 20)
    held = [0.0] * len(bands)
    for cell, _, band in pieces:
        assert cell in bands[band]
        held[band] += cells.counts[cell] / sum(c == cell for c, _, _ in pieces)
    assert sum(held) == 112 and max(held) <= 20 and len(bands) <= 7


def test_knn_with_fewer_rows_than_k(spark):
    x = blobs(copies=1)[:5]
    found = neighbours.knn_graph(table(spark, x), 9, metric="euclidean")
    assert found.groupBy("id").count().agg(F.min("count"), F.max("count")).first() == (4, 4)


def brute_forest(x, m):
    d = distances(x)
    core = np.sort(d, axis=1)[:, m - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    best, inside, out = w[0].copy(), np.zeros(len(x), bool), []
    origin = np.zeros(len(x), int)
    inside[0] = True
    for _ in range(len(x) - 1):
        j = np.where(inside, np.inf, best).argmin()
        out.append((best[j], origin[j], j))
        inside[j] = True
        closer = w[j] < best
        origin[closer], best[closer] = j, w[j][closer]
    return sorted(out)


def brute_clusters(x, mcs):
    """Textbook reading of the merge tree: condense, weigh, select."""
    edges = brute_forest(x, mcs)
    members, label = {i: [i] for i in range(len(x))}, list(range(len(x)))
    tree = []
    for w, a, b in edges:
        p, q = label[a], label[b]
        tree.append((w, list(members[p]), list(members[q])))
        members[p] = members[p] + members.pop(q)
        for i in members[p]:
            label[i] = p

    def grow(points, birth):
        """Stability and children of the cluster that holds ``points``."""
        total = 0.0
        while True:
            inner = [t for t in tree if set(t[1] + t[2]) == points]
            if not inner:
                return total, []
            w, left, right = inner[0]
            at = 1 / max(w, 1e-9)
            if len(left) >= mcs and len(right) >= mcs:
                total += len(points) * (at - birth)
                return total, [(set(left), at), (set(right), at)]
            stay = set(left) if len(left) >= mcs else set(right) if len(right) >= mcs else set()
            total += (len(points) - len(stay)) * (at - birth)
            if not stay:
                return total, []
            points = stay

    def select(points, birth, root=False):
        own, children = grow(points, birth)
        below = [select(p, b) for p, b in children]
        worth = sum(v for v, _ in below)
        if not root and own >= worth:
            return own, [points]
        return worth, [c for _, cs in below for c in cs]

    return select(set(range(len(x))), 0.0, root=True)[1]


def test_forest_is_exact_where_the_graph_falls_apart(spark, tiny_cells):
    x = blobs()
    found = density.reachability_forest(table(spark, x), 4).toPandas()
    expected = [w for w, _, _ in brute_forest(x, 4)]
    assert len(found) == len(x) - 1
    assert np.allclose(np.sort(found["w"]), expected, atol=1e-8)


@pytest.mark.parametrize("local_edges", [4096, 32])
def test_density_clusters(spark, local_edges):
    x = blobs(seed=3, copies=3)
    found = density.hdbscan_cluster(table(spark, x), 8, local_edges=local_edges).toPandas()
    mine = {frozenset(g["id"]) for c, g in found.groupby("cluster") if c >= 0}
    assert mine == {frozenset(s) for s in brute_clusters(x, 8)}
    firsts = found[found["cluster"] >= 0].groupby("cluster")["id"].min()
    assert firsts.is_monotonic_increasing


def test_density_without_structure(spark):
    x = np.random.default_rng(0).normal(0, 1, (20, 3))
    found = density.hdbscan_cluster(table(spark, x), 15).toPandas()
    assert set(found["cluster"]) == {-1} and len(found) == 20


def test_spanning_forest_of_parts(spark):
    edges = [(0, 1, 3.0), (1, 2, 1.0), (0, 2, 2.0), (5, 6, 1.0), (6, 7, 1.0), (5, 7, 1.0)]
    found = density.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double")).collect()
    assert {tuple(r) for r in found} == {(1, 2, 1.0), (0, 2, 2.0), (5, 6, 1.0), (5, 7, 1.0)}


def test_pointers_reach_the_end(spark):
    chain = spark.createDataFrame([(i, max(i - 1, 0)) for i in range(50)], "node long, root long")
    assert graph.follow_pointers(chain, "node", "root").agg(F.max("root")).first()[0] == 0


def test_graph_coordinates(spark):
    x = blobs(copies=1)[:91] / 10
    knn = neighbours.knn_graph(table(spark, x), 10, metric="euclidean")
    weights = graph.neighbor_graph(knn)
    assert weights.where((F.col("weight") <= 0) | (F.col("weight") > 1 + 1e-9)).count() == 0
    coords = graph.graph_reduce(weights, 3).orderBy("id").toPandas()
    e = np.stack(coords["coords"].to_numpy())
    assert np.allclose(e.T @ e, np.eye(3), atol=1e-8)
    group = np.repeat([0, 1, 2], 30)
    d = distances(e)[:90, :90]
    assert (group[d.argmin(axis=1)] == group).mean() > 0.95


def test_nearest_centre_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, centres = rng.normal(size=(60, 5)), rng.normal(size=(9, 5))
    c = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(centres)], "cluster int, centre array<double>")
    expected = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(2)).argmin(1)
    for limit in (2**28, 8 * 5 * 2):
        monkeypatch.setattr(kmeans, "BROADCAST_LIMIT", limit)
        found = kmeans.nearest_centroid(table(spark, x), c).orderBy("id").toPandas()
        assert found["cluster"].tolist() == expected.tolist()


def test_large_k_centres(spark):
    x = np.vstack([blobs(copies=60)])
    rows_ = table(spark, x)
    centres = kmeans.kmeans_large_k(rows_, 20)
    assert centres.count() == 20
    again = kmeans.kmeans_large_k(rows_.repartition(5), 20)
    assert centres.collect()[0]["centre"] == pytest.approx(again.collect()[0]["centre"])
    unit = rows_.withColumn("embedding", l2_normalize(F.col("embedding")))
    loss = kmeans.nearest_centroid(unit, centres).agg(F.avg(F.col("distance") ** 2)).first()[0]
    single = kmeans.nearest_centroid(unit, kmeans.kmeans_large_k(rows_, 1)).agg(F.avg(F.col("distance") ** 2)).first()[0]
    assert loss < single / 4


def test_best_k(spark):
    scan = kmeans.best_k_scan(table(spark, blobs(copies=1)[:90]), k_min=2, k_max=5)
    assert scan.where("best").first()["k"] == 3
    tied = spark.createDataFrame([(2, 0.5), (3, 0.7), (4, 0.7)], "k int, silhouette double")
    assert kmeans.mark_best(tied).where("best").first()["k"] == 3


def test_svd_equals_numpy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("doc_id", "id")
    vocab = tfidf.tfidf_fit(docs).persist()
    sparse = tfidf.sparse_rows(docs, vocab).persist()
    dense = np.zeros((docs.count(), vocab.count()))
    for i, r in enumerate(sparse.orderBy("id").collect()):
        dense[i, r["terms"]] = r["weights"]
    model = reduce.truncated_svd(sparse, dense.shape[1], 10)
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    # A randomised solver: separated values are sharp, the flat tail is close from below.
    assert np.allclose(model.values[:5], s[:5], rtol=1e-3)
    assert np.allclose(model.values, s[:10], rtol=2e-2) and (model.values <= s[:10] + 1e-9).all()
    found = np.stack(reduce.svd_project(sparse, model).orderBy("id").toPandas()["reduced"].to_numpy())
    assert np.allclose(np.abs(found[:, 0]), np.abs(u[:, 0] * s[0]), atol=1e-4)
    long = tfidf.tfidf_transform(docs, vocab).groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).toPandas()
    assert np.allclose(long["n"], 1.0)


def test_svd_stops_by_residual(spark):
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0][:, :6]
    dense = rng.normal(size=(90, 6)) @ np.diag([50, 20, 9, 4, 2, 1]) @ turn.T
    data = [(i, list(range(40)), [float(x) for x in row]) for i, row in enumerate(dense)]
    sparse = spark.createDataFrame(data, "id long, terms array<int>, weights array<double>").persist()
    s = np.linalg.svd(dense, full_matrices=False)[1]
    # Six directions in all: the second pass is exact.
    model = reduce.truncated_svd(sparse, 40, 6)
    assert model.passes == 2 and np.allclose(model.values, s[:6]) and model.residuals.max() <= reduce.TOLERANCE
    noisy = dense + rng.normal(size=dense.shape)
    data = [(i, list(range(40)), [float(x) for x in row]) for i, row in enumerate(noisy)]
    sparse = spark.createDataFrame(data, "id long, terms array<int>, weights array<double>").persist()
    gram, found = noisy.T @ noisy, []
    for rounds in (1, 4):
        model = reduce.truncated_svd(sparse, 40, 6, rounds=rounds)
        v, largest = model.components, model.values[0] ** 2
        apart = np.linalg.norm(gram @ v - v * model.values**2, axis=0) / largest
        assert model.passes == rounds + 1 and np.allclose(model.residuals, apart, atol=1e-12)
        found.append(model.residuals.max())
    assert found[1] < found[0] / 5


def test_svd_sends_one_part_per_group(spark, monkeypatch):
    """However many tasks hold the documents, a pass sends one matrix of terms x width for each group of them, and its
    slices of columns run side by side."""
    rng = np.random.default_rng(13)
    dense = rng.normal(size=(64, 30))
    data = [(i, list(range(30)), [float(x) for x in row]) for i, row in enumerate(dense)]
    sparse = spark.createDataFrame(data, "id long, terms array<int>, weights array<double>").repartition(16, "id").persist()
    basis = rng.normal(size=(30, 20))
    grid = reduce._grid(sparse, 20)
    assert grid == (1, 3)
    assert np.allclose(reduce._gram_times(sparse, basis, grid), dense.T @ (dense @ basis))
    assert reduce._gram_times(sparse, basis, (4, 2)) == pytest.approx(dense.T @ (dense @ basis))
    monkeypatch.setattr(reduce, "GROUP_ENTRIES", 700)
    assert reduce._grid(sparse, 20) == (3, 2)
    parts = sparse.coalesce(1).mapInArrow(lambda it: it, sparse.schema)
    with runtime.side_by_side(spark):
        assert parts.unionByName(parts).rdd.getNumPartitions() == 2


def test_svd_keeps_the_model_out_of_the_driver(spark, monkeypatch):
    """Many blocks of terms and pieces of columns, a rank below the width: only pieces pass through the driver."""
    monkeypatch.setattr(reduce, "BLOCK_TERMS", 16)
    monkeypatch.setattr(reduce, "PIECE_BYTES", 8 * 60 * 3)
    rng = np.random.default_rng(8)
    dense = rng.normal(size=(50, 5)) @ np.diag([30, 20, 9, 5, 2]) @ rng.normal(size=(5, 60))
    dense[:, 40:] = 0
    data = [(i, list(range(40)), [float(x) for x in row[:40]]) for i, row in enumerate(dense)]
    sparse = spark.createDataFrame(data, "id long, terms array<int>, weights array<double>").persist()
    sizes, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: [sizes.append(getattr(x, "size", 0)), send(x)][1])
    model = reduce.truncated_svd(sparse, 60, 7)
    found = np.stack(reduce.svd_project(sparse, model).orderBy("id").toPandas()["reduced"].to_numpy())
    assert sizes and max(sizes) <= 60 * 3
    _, s, vt = np.linalg.svd(dense, full_matrices=False)
    v = model.components
    assert model.passes == 2 and np.allclose(model.values[:5], s[:5]) and np.allclose(v.T @ v, np.eye(7))
    assert np.allclose(np.abs(found[:, :5]), np.abs(dense @ vt[:5].T)) and np.allclose(found[:, 5:], 0, atol=1e-6)
    terms = spark.createDataFrame([(f"t{i:02}", 1.0) for i in range(60)], "term string, idf double")
    long = flows.component_rows(terms, model).toPandas()
    assert len(long) == 420
    wide = long.pivot(index="term", columns="component", values="value").to_numpy()
    assert np.array_equal(wide, v)


def test_pca_equals_numpy(spark):
    x = np.random.default_rng(4).normal(size=(80, 6)) * [5, 3, 2, 1, 1, 1] + 7
    found = np.stack(reduce.pca_project(table(spark, x), 3).orderBy("id").toPandas()["reduced"].to_numpy())
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(found), np.abs(u[:, :3] * s[:3]), atol=1e-8)


def test_encoder_plug_in(spark):
    def load():
        def encode_texts(texts):
            return np.array([[len(t), t.startswith("passage: ")] for t in texts], dtype="float32")

        return encode_texts

    docs = spark.createDataFrame([(1, "ab"), (2, "abc")], "id long, text string")
    found = encode.embed_batches(docs, encoder=load).orderBy("id").collect()
    assert [r["embedding"] for r in found] == [[11.0, 1.0], [12.0, 1.0]]


def test_vector_checks(spark):
    zero = spark.createDataFrame([(1, [0.0, 0.0])], "id long, embedding array<double>")
    assert zero.select(l2_normalize(F.col("embedding"))).first()[0] == [0.0, 0.0]
    with pytest.raises(Exception, match="does not have 3 components"):
        rows.cast_vectors(zero, "embedding", 3).collect()


def test_split_keeps_every_row(spark):
    split = sampling.train_test_split(table(spark, blobs()))
    assert split.count() == len(blobs()) and split.where("split is null").count() == 0


def test_null_and_odd_vectors_get_no_centre(spark):
    data = [(1, [0.0, 1.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [9.0, 9.0]), (6, [float("inf"), 0.0])]
    table = spark.createDataFrame(data, "id long, embedding array<double>")
    centres = spark.createDataFrame([(0, [0.0, 0.0]), (1, [9.0, 8.0])], "cluster int, centre array<double>")
    found = {r.id: (r.cluster, r.distance) for r in kmeans.nearest_centroid(table, centres).collect()}
    assert found == {1: (0, 1.0), 5: (1, 1.0), **{i: (None, None) for i in (2, 3, 4, 6)}}


def test_silhouette_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 1, (40, 3)) for m in (0, 3)])
    data = [(i, r.tolist(), int(i >= 40)) for i, r in enumerate(x)]
    table = spark.createDataFrame(data, "id long, embedding array<double>, cluster int")
    whole = kmeans.silhouette_score(table).first()[0]
    monkeypatch.setattr(kmeans, "SAMPLE_BLOCK", 7)
    assert kmeans.silhouette_score(table, sample=100_000).first()[0] == whole


def test_large_k_trains_on_every_row(spark):
    """The far group is under one row in a thousand: a sample per centre would miss it."""
    data = [(i, [1.0, (i % 97) / 1e5, 0.0]) for i in range(6000)] + [(10_000 + i, [0.0, 0.0, 1.0]) for i in range(3)]
    table = spark.createDataFrame(data, "id long, embedding array<double>")
    centres = kmeans.kmeans_large_k(table, 4, rounds=30)
    found = kmeans.nearest_centroid(table, centres).where("id >= 10000").agg({"distance": "max"}).first()[0]
    assert found < 1e-3


def test_texts_are_not_shuffled_for_weights(spark):
    from corpuscape.operators import encode, tfidf

    docs = spark.createDataFrame([(i, f"alpha beta gamma{i % 3} beta") for i in range(40)], "id long, text string")
    vocab = tfidf.tfidf_fit(docs, min_df=1, max_df=1.0)
    made = [tfidf.tfidf_transform(docs, vocab), tfidf.sparse_rows(docs, vocab), encode.project_terms(docs, min_df=1, max_df=1.0)]
    for frame in made:
        frame.collect()
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        exchanges = frame._jdf.queryExecution().executedPlan().toString().split("Exchange ")[1:]
        assert exchanges and plan
        for part in exchanges:
            child = part.split("\n")[1] if "\n" in part else part
            assert "text#" not in child or "count_terms" in child or "Scan" not in child
    counts = {(r.id, r.term): r.tf for r in tfidf.term_counts(docs).collect()}
    assert counts[0, "beta"] == 2 and counts[0, "gamma0"] == 1 and len(counts) == 120


def test_tree_worth_takes_few_rounds_on_a_path(spark, monkeypatch):
    """10,000 levels: each cluster has a leaf and the next cluster below it."""
    rng = np.random.default_rng(5)
    levels, rows_ = 10_000, []
    for i in range(levels):
        up = i - 1 if i else None
        rows_.append((i, up, float(rng.uniform(0, 2))))
        rows_.append((levels + i, i, float(rng.uniform(0, 0.01))))
    worth = {}
    for i in reversed(range(levels)):
        worth[levels + i] = rows_[2 * i + 1][2]
        worth[i] = max(rows_[2 * i][2], worth[levels + i] + worth.get(i + 1, 0.0))
    steps = []
    for name in ("cut_lineage", "cut_and_count"):
        run = getattr(density, name)
        monkeypatch.setattr(density, name, lambda *a, run=run: steps.append(1) or run(*a))
    clusters = spark.createDataFrame(rows_, "top long, up long, stability double")
    found = dict(density.tree_worth(clusters).collect())
    assert found.keys() == worth.keys()
    assert np.allclose([found[k] for k in worth], list(worth.values()), rtol=1e-9)
    assert len(steps) < 40


def test_tree_worth_of_random_forests(spark):
    rng = np.random.default_rng(6)
    rows_, worth = [], {}
    for i in range(400):
        up = int(rng.integers(0, i)) if i and rng.random() < 0.97 else None
        rows_.append((i, up, float(rng.uniform(0, 1))))
    below = dict.fromkeys(range(400), 0.0)
    for i, up, s in reversed(rows_):
        worth[i] = max(s, below[i])
        if up is not None:
            below[up] += worth[i]
    found = dict(density.tree_worth(spark.createDataFrame(rows_, "top long, up long, stability double")).collect())
    assert found == pytest.approx(worth)


def test_temporary_tables_go(spark):
    import os

    from corpuscape.runtime import shared_dir, stored, temporary_tables

    root = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    with temporary_tables(spark) as keep:
        inner = stored(spark.range(5))
        with temporary_tables(spark) as keep_inner:
            other = keep_inner(stored(spark.range(3)).select((F.col("id") * 2).alias("id")))
        kept = keep(inner.join(other, "id"))
    assert sorted(r.id for r in kept.collect()) == [0, 2, 4]
    assert len(set(os.listdir(root)) - before) == 1


def test_kmeans_does_not_depend_on_splits(spark):
    """Copies, three tight groups and loose points: the same centres, to the last bit."""
    rows_ = table(spark, blobs(copies=30))
    found = []
    for parts in (1, 8, 37):
        labelled, centres = kmeans.kmeans_fit(rows_.repartition(parts), 6)
        found.append(sorted((r.cluster, *r.centre) for r in centres.collect()))
        assert labelled.groupBy("cluster").count().count() == 6
    assert found[0] == found[1] == found[2]


def test_kmeans_trains_on_blocks_in_all_cores(spark):
    """One file is one task: its rows train as blocks dealt over the cores, with the draws and sums of single rows."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 16))
    rows_ = table(spark, x).coalesce(1).select(F.col("id").alias("key"), F.col("embedding").alias("vec"))
    blocks = kmeans._blocks(rows_, 42).persist()
    assert blocks.agg(F.sum("n")).first()[0] == 6000
    assert blocks.where("n > 0").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    drawn = rows_.select(F.xxhash64("key", F.lit(42)).alias("a"), F.xxhash64("key", F.lit(42), F.lit(7)).alias("b")).toPandas()
    assert (kmeans._next_hash(drawn["a"].to_numpy(), 7) == drawn["b"].to_numpy()).all()
    points, scale = x[:150], 2.0**30
    n, sums = kmeans._exact_sums(blocks, np.zeros(150, dtype=int), points, scale)
    near = kmeans.squared_distances(x, points).argmin(axis=1)
    assert n.tolist() == np.bincount(near, minlength=150).tolist()
    expected = np.zeros((150, 16), dtype="int64")
    np.add.at(expected, near, np.floor(x * scale).astype("int64"))
    assert (sums == expected).all()
    cells = kmeans._in_tree(blocks, x[:5]).persist()
    own = kmeans.squared_distances(x, x[:5]).argmin(axis=1)
    assert kmeans._distinct_rows(cells) == {i: int((own == i).sum()) for i in range(5)}


def test_centres_left_over_go_to_the_largest_remainder():
    assert kmeans._allot({0: 410, 1: 295, 2: 295}, 10) == {0: 4, 1: 3, 2: 3}
    assert kmeans._allot({0: 390, 1: 310, 2: 300}, 10) == {0: 4, 1: 3, 2: 3}
    assert kmeans._allot({0: 3, 1: 1, 2: 1}, 9) == {0: 3, 1: 1, 2: 1}
    for sizes, k in (({i: 1 + i * i for i in range(40)}, 2000), ({i: 10 ** (i % 4) for i in range(44)}, 2000)):
        given = kmeans._allot(sizes, k)
        assert sum(given.values()) >= min(k, sum(sizes.values())) and all(1 <= given[i] <= n for i, n in sizes.items())


def test_kmeans_with_fewer_vectors_than_centres(spark):
    rows_ = table(spark, np.repeat(np.eye(3), 5, axis=0))
    labelled, centres = kmeans.kmeans_fit(rows_, 9)
    assert centres.count() == 3 and kmeans.kmeans_large_k(rows_, 9).count() == 3
    assert labelled.groupBy("cluster").count().collect() and labelled.count() == 15


def test_best_of_starts_finds_planted_groups():
    rng = np.random.default_rng(8)
    middles = rng.normal(0, 10, (25, 6))
    x = np.repeat(middles, 20, axis=0) + rng.normal(0, 0.05, (500, 6))
    centres = kmeans.best_of_starts(x, np.ones(500), 25, np.random.default_rng(0))
    assert np.sqrt(kmeans.squared_distances(middles, centres).min(axis=1)).max() < 0.1


def test_forest_does_not_depend_on_splits(spark):
    from corpuscape.operators import classify

    x = blobs(copies=1)[:90]
    rows_ = table(spark, x).withColumn("label", (F.col("id") / 30).cast("int"))
    found = []
    for parts in (1, 7):
        model = classify.train_classifier(rows_.repartition(parts), trees=9)
        scored = classify.predict(model, rows_)
        found.append((model.stages[0].toDebugString.split("\n", 1)[1], scored.where("label <> predicted").count()))
    assert found[0] == found[1] and found[0][1] == 0


@pytest.mark.parametrize("dims, centres, share", [(4, 900, 0.8), (64, 6000, 0.1)])
def test_centre_tree_is_exact_and_leaves_out_most(dims, centres, share):
    from corpuscape.operators import centre_tree

    rng = np.random.default_rng(9)
    middles = rng.normal(0, 1, (60, dims))
    points = middles[rng.integers(0, 60, centres)] + rng.normal(0, 0.1, (centres, dims))
    points[7] = points[3]
    rows_ = np.vstack([points[rng.integers(0, centres, 400)] + rng.normal(0, 0.05, (400, dims)), points[3:4], rng.normal(0, 1, (50, dims))])
    place, distance, work = centre_tree.nearest(centre_tree.build_tree(np.arange(centres), points), rows_)
    gaps = np.sqrt(((rows_[:, None] - points[None]) ** 2).sum(2)) if dims == 4 else centre_tree.gaps_between(rows_, points)
    assert np.allclose(distance, gaps.min(axis=1), atol=1e-7)
    assert (place == gaps.round(9).argmin(axis=1)).mean() > 0.999 and place[400] == 3
    assert work < share * gaps.size


def test_centre_tree_of_copies():
    from corpuscape.operators import centre_tree

    points = np.repeat(np.eye(3), 100, axis=0)
    place, distance, _ = centre_tree.nearest(centre_tree.build_tree(np.arange(300), points), np.eye(3))
    assert place.tolist() == [0, 100, 200] and distance.max() == 0


def test_descent_finds_most_neighbours(spark):
    rng = np.random.default_rng(10)
    x = np.vstack([rng.normal(0, 1, (900, 12)), np.repeat(rng.normal(0, 1, (1, 12)), 40, axis=0)])
    rows_ = table(spark, x)
    exact = neighbours.knn_graph(rows_, 10, metric="euclidean").select("id", "neighbour")
    near = neighbours.knn_graph(rows_, 10, metric="euclidean", method="descent")
    assert near.count() == exact.count() == 9400
    assert near.join(exact, ["id", "neighbour"]).count() > 0.9 * 9400
    few = table(spark, blobs(copies=1)[:5])
    assert neighbours.knn_graph(few, 9, metric="euclidean", method="descent").groupBy("id").count().agg(F.min("count")).first()[0] == 4


def test_reduction_sends_a_vector_once_a_block(spark):
    """A step's sums by block equal those of the whole matrix, also where an edge ends outside the table."""
    import pyarrow as pa

    rng = np.random.default_rng(14)
    a, b = rng.integers(0, 40, 300), rng.integers(0, 42, 300)
    w, x = rng.normal(size=300), rng.normal(size=(40, 3))
    edges = pa.table({"a": a, "b": b, "w": w})
    turned = rng.permutation(40)
    seen = pa.table({"id": turned, "x": pa.array(list(x[turned]), pa.list_(pa.float64()))})
    found = graph._averaged(edges, seen)
    dense = np.zeros((40, 42))
    np.add.at(dense, (a, b), w)
    ids = found["id"].to_numpy()
    assert len(ids) == len(set(ids)) and set(ids) == set(a[b < 40])
    assert np.allclose(np.stack(found["x"].to_numpy()), (dense[:, :40] @ x / 2)[ids])


def test_layout_step_adds_forces_as_before():
    from corpuscape.operators import layout

    rng = np.random.default_rng(15)
    y, a = rng.normal(size=(30, 4)), np.sort(rng.integers(0, 20, 200))
    b, w = rng.integers(0, 30, 200), rng.random(200)
    moved = layout._moved(y, 20, (a, b), w, np.arange(30), 0.5, (1.5, 0.9), np.random.default_rng(1))
    p, q, draws, total = 1.5, 0.9, np.random.default_rng(1), np.zeros((20, 4))
    near = y[a] - y[b]
    far = np.maximum((near**2).sum(1), 1e-12)
    np.add.at(total, a, np.clip((-2 * p * q * far ** (q - 1) / (1 + p * far**q) * w)[:, None] * near, -4, 4))
    for _ in range(layout.NEGATIVES):
        other = np.arange(30)[draws.integers(0, 30, 200)]
        near = y[a] - y[other]
        far = (near**2).sum(1)
        push = np.where(other == a, 0.0, 2 * q / ((0.001 + far) * (1 + p * far**q))) * w
        np.add.at(total, a, np.clip(push[:, None] * near, -4, 4))
    assert np.allclose(moved, y[:20] + 0.5 * total / np.maximum(np.bincount(a, w, 20), 1.0)[:, None])


def test_layout_in_blocks(spark, monkeypatch):
    """Blocks of vertices, a vertex with more edges than take part in a round; groups stay apart; reruns agree."""
    from corpuscape.operators import layout

    p, q = layout.fit_curve()
    assert abs(p - 1.577) < 0.01 and abs(q - 0.895) < 0.01
    monkeypatch.setattr(layout, "BLOCK_VERTICES", 40)
    monkeypatch.setattr(layout, "MOST_EDGES", 8)
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (90, 5)) + np.repeat([0.0, 2.0, 4.0], 30)[:, None]
    weights = graph.neighbor_graph(neighbours.knn_graph(table(spark, x), 10, metric="euclidean"))
    found = [layout.graph_layout(w, 2, rounds=4).orderBy("id").toPandas() for w in (weights, weights.repartition(3))]
    e = np.stack(found[0]["coords"].to_numpy())
    assert found[0]["id"].tolist() == list(range(90))
    assert np.allclose(e, np.stack(found[1]["coords"].to_numpy()), atol=1e-3)
    group = np.repeat([0, 1, 2], 30)
    assert (group[distances(e).argmin(axis=1)] == group).mean() > 0.8


def test_predict_returns_every_held_out_row(spark, tmp_path):
    from corpuscape.catalog.queries import predict

    rng = np.random.default_rng(16)
    data = [(i, [float(x) for x in rng.normal(0, 0.1, 64)], i % 4) for i in range(200)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = predict(spark, str(tmp_path)).toPandas()
    assert found.columns.tolist() == ["id", "label", "predicted"] and len(found) == found["id"].nunique() == 40
    assert (found["label"] == found["id"] % 4).all() and (found["predicted"] == found["label"].astype(str)).all()
