"""Footers against DuckDB's, stored matrices and tables laid out by key."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpuscape.operators import rows
from corpuscape.sources import readers, writers


@pytest.fixture
def table(tmp_path):
    """Two files of several row groups: nulls, a column of nulls, lists and an extent below zero."""
    path = tmp_path / "some table"
    path.mkdir()
    for part, first in enumerate((-50, 1000)):
        data = {
            "id": pa.array([first + i if i % 7 else None for i in range(95)], pa.int64()),
            "none": pa.nulls(95, pa.int32()),
            "x": pa.array([i / 3 for i in range(95)]),
            "words": pa.array([["a"] * (i % 3) for i in range(95)]),
            "text": pa.array(["ä" * i for i in range(95)]),
        }
        pq.write_table(pa.table(data), path / f"part-{part}.parquet", row_group_size=30)
    return str(path)


def test_footers_agree_with_duckdb(spark, table):
    found = readers.read_footers(spark, table).selectExpr(
        "regexp_extract(path, '[^/]+$', 0)", "row_group", "n_rows", "kind", "n_values", "n_nulls", "bytes_stored", "bytes_plain"
    )
    expected = duckdb.sql(
        f"""SELECT regexp_extract(file_name, '[^/]+$'), row_group_id, row_group_num_rows, type, num_values, stats_null_count,
            total_compressed_size, total_uncompressed_size FROM parquet_metadata('{table}/*.parquet')"""
    )
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected.fetchall())
    files = {r.file: r for r in readers.table_inventory(spark, table).collect()}
    assert set(files) == {"some table/part-0.parquet", "some table/part-1.parquet"}
    assert all(r.n_rows == 95 and r.n_row_groups == 4 and r.columns == "id,none,x,words,text" for r in files.values())


def test_footers_without_arrow_file_system(spark, table, monkeypatch):
    order = lambda df: sorted(map(repr, df.withColumn("path", F.regexp_extract("path", "[^/]+$", 0)).collect()))
    expected = order(readers.read_footers(spark, table))

    def refuse(path):
        raise ValueError(path)

    refusing = type("Refusing", (), {"from_uri": staticmethod(refuse)})
    monkeypatch.setattr(readers, "fs", type("System", (), {"FileSystem": refusing}))
    assert order(readers.read_footers(spark, table)) == expected


def test_extents(spark, table, tmp_path):
    found = {r.column: r for r in readers.column_extents(spark, table).collect()}
    assert tuple(found["id"])[1:] == (190, 28, -49, 1094)
    assert tuple(found["none"])[1:] == (190, 190, None, None)
    assert tuple(found["x"])[1:] == (190, 0, None, None)
    empty = str(tmp_path / "empty")
    spark.range(0).write.parquet(empty)
    (row,) = readers.column_extents(spark, empty).collect()
    assert (row.n_values, row.lowest, row.highest) == (0, None, None)
    assert [r.n_row_groups for r in readers.table_inventory(spark, empty).collect()] == [0]


def test_weights_round_trip_and_ranges(spark, tmp_path):
    path = str(tmp_path / "weights")
    long = spark.range(0, 40000).selectExpr("id div 4 as id", "concat('t', id % 4) as term", "cast(id as double) / 7 as weight")
    odd = spark.createDataFrame([(None, "a", 1.0), (3, "t1", 2.5), (3, "t1", 2.5), (4, None, None)], long.schema)
    both = long.union(odd)
    writers.save_weights(both.repartition(5), path, block_bytes=4096)
    order = lambda df: sorted(map(repr, df.collect()))
    assert order(writers.load_weights(spark, path)) == order(both)
    assert order(writers.load_weights(spark, path, 2000, 2010)) == order(both.where("id >= 2000 and id < 2010"))
    rows_back = writers.load_weight_rows(spark, path)
    assert rows_back.count() == 10001
    # Row groups hold disjoint ranges, and the limits reach the scan.
    groups = readers.read_footers(spark, path).where("column = 'id' and lowest is not null").selectExpr("bigint(lowest) a", "bigint(highest) b")
    spans = sorted((r.a, r.b) for r in groups.collect())
    assert len(spans) > 3 and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    plan = writers.load_weight_rows(spark, path, 2000, 2010)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,2000)" in plan and "LessThan(id,2010)" in plan


def test_stages_join_without_exchange(spark, tmp_path):
    left = spark.createDataFrame([(i, i * 2) for i in range(200)] + [(None, -1)], "id long, a long")
    right = spark.createDataFrame([(i, str(i)) for i in range(0, 300, 3)] + [(None, "x")], "id long, b string")
    names = ["stage_left", "stage_right"]
    one, two = (writers.save_stage(df, n, str(tmp_path / n), "id", 4) for df, n in zip((left, right), names))
    joined = rows.attach_by_key(one.hint("merge"), two)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert sorted(map(tuple, joined.collect())) == [(i, i * 2, str(i)) for i in range(0, 200, 3)]
    counted = one.groupBy("id").count()
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    # Written anew under the same name, as other rows.
    again = writers.save_stage(left.limit(3), names[0], str(tmp_path / names[0]), "id", 4)
    assert again.count() == 3
    for name in names:
        writers.drop_stage(spark, name)
    assert not any(spark.catalog.tableExists(n) for n in names)
