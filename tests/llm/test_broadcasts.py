"""Tables that grow with the input are not sent through the driver, even where Spark takes them for small ones."""

from __future__ import annotations

from weftline.llm import common, line_dedup, simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_of_all_segments_are_not_broadcast(spark, tmp_path):
    # a file far below Spark's threshold: the explode's rows are taken to be as large as those before it
    spark.range(2000).selectExpr("xxhash64(id) as fp").write.parquet(f"{tmp_path}/prints")
    prints = spark.read.parquet(f"{tmp_path}/prints")
    assert "Broadcast" not in plan(simhash.near_pairs(prints))


def test_counted_tables_beyond_the_bound_are_not_broadcast(spark, tmp_path, monkeypatch):
    # few different numbers: Spark sees a file of some kilobytes
    spark.range(200_000).selectExpr("id % 7 as node", "1L as root").coalesce(1).write.parquet(f"{tmp_path}/roots")
    roots = spark.read.parquet(f"{tmp_path}/roots")
    rows = spark.range(200_000).selectExpr("id as node").repartition(2)
    assert "Broadcast" in plan(rows.join(common.small(roots, 200_000), "node", "left"))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 100_000)
    assert "Broadcast" not in plan(rows.join(common.small(roots, 200_000), "node", "left"))


def test_marks_of_lines_in_many_buckets_are_not_broadcast(spark, tmp_path):
    marks = ", ".join(f"id % 50 as m{i}" for i in range(line_dedup.MARKS))
    spark.range(20_000).selectExpr("id div 20 as key", "id % 50 as node", "id % 50 as root", "100L as size", *marks.split(", ")).write.parquet(f"{tmp_path}/lines")
    assert "Broadcast" not in plan(line_dedup._across(spark.read.parquet(f"{tmp_path}/lines")))
