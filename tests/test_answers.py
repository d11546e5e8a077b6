"""Prompts and answers of a mapping model."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtures import RETAIL, json_tables
from weftline.operators import answers, joins
from weftline.sources import catalog

TRANSFORMS, OPERATIONS = ["rename", "concat", "date_part", "fk_lookup"], ["year", "month", "first_last"]


def columns(spark):
    return catalog.from_json_tables(catalog.json_tables(spark, json_tables(RETAIL)))


def test_answers_are_read_and_checked(spark):
    rows = [
        (1, "Source_columns: customers.first_name, customers.last_name.\nTransform_Type: CONCAT\nsub_operation: first\nreasoning: both\nparts"),
        (2, "source_column: orders.order_date, nowhere.x, a.b.c, plain\ntransform_type: date_part_extract"), (3, "no idea"), (4, None), (5, "source_columns: nowhere.y\ntransform_type: zzz\nsub_operation: odd"),
    ]
    parsed = answers.parsed(spark.createDataFrame(rows, "id int, response string"), TRANSFORMS, OPERATIONS)
    got = {r.id: r for r in answers.validated(parsed, columns(spark), ["id"]).collect()}
    assert (got[1].source_columns, got[1].transform_type, got[1].sub_operation, got[1].reasoning, got[1].parse_success) == (["customers.first_name", "customers.last_name"], "concat", "first_last", "both\nparts", True)
    assert (got[2].source_columns, got[2].transform_type, got[2].sub_operation, got[2].confidence) == (["orders.order_date"], "date_part", "", 0.90)
    for i, operation in ((3, ""), (4, ""), (5, "odd")):
        assert (got[i].source_columns, got[i].transform_type, got[i].sub_operation, got[i].parse_success, got[i].confidence) == ([], "unmapped", operation, False, 0.10)


def test_prompts(spark):
    edges = spark.createDataFrame([("stores", ["region_id"], "regions", ["region_id"], "N:1", "", 0.9, [], "single")] * 2, joins.EDGE)
    targets = spark.createDataFrame([("dim_store", "city", "string", "store city"), ("dim_store", "x", "int", None)], "table string, column string, type string, description string")
    got = {r.column: r.prompt for r in answers.prompts(targets, columns(spark), edges).collect()}
    assert got["city"].endswith('Joins:\n  stores.region_id = regions.region_id\n\nMap target: dim_store.city (string) - "store city"') and got["city"].startswith("Source Schema:\n  categories(category_id int PK")
    assert got["x"].endswith("Map target: dim_store.x (int)")


def test_composite_plausibility(spark):
    kinds = "target string, money boolean, sources array<struct<type:string,valid_count:long,concepts:map<string,double>>>, want boolean"
    amount, rate = {"monetary": 0.5}, {"exchange_rate": 0.4}
    rows = [
        ("int", False, [("string", 1, {}), ("string", 1, {})], False), ("int", False, [("string", 1, {}), ("date", 1, {})], True), ("decimal", True, [("decimal", 1, amount), ("decimal", 1, rate)], True),
        ("decimal", True, [("decimal", 1, amount), ("decimal", 1, {})], False), ("decimal", True, [("decimal", 1, {})], True), ("date", False, [("int", 1, {})], False), ("date", None, [("string", 1, {})], True),
        ("boolean", False, [("int", 0, {}), ("int", None, {})], False), ("boolean", False, [("int", 0, {}), ("int", 3, {})], True), ("string", False, [("int", 0, {})], True), ("string", False, [], False),
    ]
    df = spark.createDataFrame(rows, kinds)
    for r in df.select("*", answers.composite_possible(F.col("target"), F.col("money"), F.col("sources")).alias("got")).collect():
        assert r.got == r.want, r
