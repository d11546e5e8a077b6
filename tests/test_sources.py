"""Reading and writing of records, schemas and edges."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fixtures import RETAIL, json_tables
from weftline.operators import joins
from weftline.sources import catalog

SCHEMA = "query_id string, split string, label int, weight double, target struct<table:string,column:string>"
RULES = {"required": ["query_id"], "allowed": {"split": ["train", "val", "test"], "label": [0, 1]}, "defaults": {"split": "train", "label": 0, "weight": 1.0}, "lowered": ["split"]}


def test_validated_lines(spark, tmp_path):
    lines = [
        '{"query_id":"q1","split":"VAL","label":1,"target":{"table":"t","column":"c"}}', '{"query_id":"q2"}', "", "   ", '{"query_id":"q3","split":"dev","label":7}', '{"split":"train"}', '{"query_id":""}',
        '{"query_id":"q4","label":"one"}', '{"query_id":"q5"', "[1, 2]", '"text"', "null", '{"query_id":"q6","target":{"table":null}}', '{"query_id":"q7","more":[1,{"x":2}]}',
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    valid, rejected = catalog.read_records(spark, str(tmp_path), SCHEMA, **RULES)
    assert [(r.query_id, r.split, r.label, r.weight, r.target and r.target.table) for r in valid.orderBy("query_id").collect()] == [
        ("q1", "val", 1, 1.0, "t"), ("q2", "train", 0, 1.0, None), ("q6", "train", 0, 1.0, None), ("q7", "train", 0, 1.0, None)]
    assert {r.line: r.reasons for r in rejected.collect()} == {
        lines[4]: ["invalid split: dev", "invalid label: 7"], lines[5]: ["missing query_id"], lines[6]: ["missing query_id"], lines[7]: ["malformed"], lines[8]: ["malformed"],
        "[1, 2]": ["malformed"], '"text"': ["malformed"], "null": ["malformed"]}
    empty = catalog.checked_records(spark.createDataFrame([], "value string"), SCHEMA, **RULES)
    assert empty.count() == 0


def test_plain_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, [1, 2])], "id int, name string, xs array<int>")
    catalog.write_records(df, str(tmp_path / "out"))
    assert sorted(map(str, catalog.read_lines(spark, str(tmp_path / "out"), "id int, name string, xs array<int>").collect())) == sorted(map(str, df.collect()))
    (tmp_path / "bad.jsonl").write_text('{"id": "x"}\n')
    with pytest.raises(Exception, match="Malformed|malformed"):
        catalog.read_lines(spark, str(tmp_path / "bad.jsonl"), "id int").collect()


def test_schema_text_summary_and_edges(spark, tmp_path):
    (tmp_path / "tables.json").write_text(json.dumps(json_tables(RETAIL)))
    columns = catalog.from_json_tables(catalog.read_json_tables(spark, str(tmp_path / "tables.json")))
    rows = [("stores", ["region_id"], "regions", ["region_id"], "N:1", "right_parent", 0.91237, [], "single")] * 2 + [("orders", ["store_id", "customer_id"], "stores", ["store_id", "region_id"], "N:1", "", 0.8, [], "composite")]
    edges = spark.createDataFrame(rows, joins.EDGE)
    text = {r.table: r.text for r in catalog.schema_text(columns, edges).collect()}
    assert text["stores"] == (
        "stores(store_id int PK, store_name string, city string, region_id int FK)\n"
        "orders.store_id = stores.store_id AND orders.customer_id = stores.region_id\nstores.region_id = regions.region_id")
    assert text["regions"].count("\n") == 1 and "\n" not in text["products"]
    assert {r.table: r.text for r in catalog.schema_text(columns).collect()}["regions"] == "regions(region_id int PK, region_code string, region_name string)"
    told = {r.table: r for r in catalog.summary(columns, spark.createDataFrame([("orders", 5)], "table string, row_count long")).collect()}
    assert (told["orders"].n_columns, told["orders"].row_count, told["stores"].row_count, told["orders"].columns[0].column) == (5, 5, None, "order_id")
    assert {json.loads(r.value)["confidence"] for r in catalog.edges_json(edges).collect()} == {0.912, 0.8}
    assert columns.where("is_pk and not is_unique").count() == 0 and columns.where(F.col("is_pk")).count() == 7
