from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fixtures import RETAIL, json_tables
from weftline.operators import candidates, joins, metrics, profile, value_similarity
from weftline.plans import match_queries
from weftline.sources import catalog


@pytest.fixture(scope="module")
def scored(spark):
    words = ["us", "in", "uk", "us", "in", "ca"]
    one = lambda values: spark.createDataFrame([(str(v),) for v in values], "v string")
    tables = {
        "a": one(words * 20), "b": one([w.upper() for w in words] * 15), "c": one(["dog", "cat", "fish"] * 50), "d": one(["red", "green", "blue"] * 50),
        "e": one(range(1, 1001)), "f": one(range(100, 1100)), "g": one(range(5000, 6000)), "h": one(["", "null"]),
    }
    counts = profile.value_counts(profile.cells(tables)).persist()
    p = profile.profiles(counts).persist()
    pairs = spark.createDataFrame([("a", "v", "b", "v"), ("c", "v", "d", "v"), ("e", "v", "f", "v"), ("e", "v", "g", "v"), ("a", "v", "e", "v"), ("a", "v", "h", "v"), ("e", "v", "e", "v"), ("f", "v", "e", "v")], "lt string, lc string, rt string, rc string")
    return {(r.lt, r.rt): r for r in value_similarity.similarity(counts, p, pairs).collect()}, {r.table: r for r in p.collect()}


def test_value_similarity_thresholds(scored):
    s, _ = scored
    assert s["a", "b"].value_score >= 0.8
    assert s["c", "d"].value_score <= 0.2
    assert s["e", "f"].value_score >= 0.7
    assert s["e", "g"].value_score <= 0.2
    assert s["a", "e"].reason == "type_mismatch" and s["a", "e"].value_score == 0
    assert s["a", "h"].reason == "empty"
    assert s["e", "e"].value_score == 1.0
    assert s["e", "f"].value_score == s["f", "e"].value_score


def test_profiles(scored):
    _, p = scored
    assert (p["a"].kind, p["a"].n_distinct, p["a"].valid_count, p["h"].kind, p["e"].kind) == ("categorical", 4, 120, "unknown", "numeric")
    assert p["e"].q50 == 500.5 and p["e"].integer_ratio == 1.0 and p["e"].outlier_ratio == 0.0 and p["e"].entropy == 0.0
    assert p["c"].entropy == pytest.approx(1.0986, abs=1e-3)


def test_mapping_of_retail_targets(spark):
    columns = catalog.from_json_tables(catalog.json_tables(spark, json_tables(RETAIL)))
    wanted = {"store_name": ("dim_store", "string", {"stores.store_name"}), "city": ("dim_store", "string", {"stores.city"}), "email": ("dim_customer", "string", {"customers.email"}),
              "unit_cost": ("dim_product", "decimal", {"products.unit_cost"}), "product_name": ("dim_product", "string", {"products.product_name"})}
    targets = spark.createDataFrame([(t, c, k, "") for c, (t, k, _) in wanted.items()], "table string, column string, type string, description string")
    found = {r.tc: r for r in candidates.select_mappings(candidates.candidates(candidates.scored_sources(targets, columns))).collect()}
    assert all(set(found[c].refs) == refs for c, (_, _, refs) in wanted.items())
    assert found["city"].transform == "direct_copy"


def test_mapping_order_and_join_paths(spark):
    schema = {
        "employees": ("emp_id int pk, first_name string, last_name string, dept_id int fk, manager_id int fk, salary decimal", [(1, "A", "B", 7, 2, 10.0)]),
        "departments": ("dept_id int pk, dept_name string, budget decimal", [(7, "R", 5.0)]), "projects": ("project_id int pk, project_name string, dept_id int fk", [(3, "P", 7)]),
    }
    columns = catalog.from_json_tables(catalog.json_tables(spark, json_tables(schema)))
    targets = [("employee_name", "string", ""), ("manager_name", "string", ""), ("full_name", "string", ""), ("department_name", "string", "name of the department"), ("owning_department", "string", ""), ("salary", "decimal", ""), ("label", "string", "first and last name")]
    targets = spark.createDataFrame([("dim_employee", *t) for t in targets], "table string, column string, type string, description string")
    edges = [("employees", ["dept_id"], "departments", ["dept_id"], "many_to_one", "left_to_right", 0.91, ["pk_fk_relation"], "single"), ("projects", ["dept_id"], "departments", ["dept_id"], "many_to_one", "left_to_right", 0.95, ["pk_fk_relation"], "single")]
    got = {r.tc: r for r in candidates.plan_mappings(targets, columns, spark.createDataFrame(edges, joins.EDGE)).collect()}
    for name in ("employee_name", "manager_name", "full_name", "label"):
        assert (got[name].by, got[name].transform, got[name].refs, got[name].join_path) == ("concat", "concat", ["employees.first_name", "employees.last_name"], None), name
    # a single column that scores as high as the lookup, here the same one, is left to the ranking
    for name, by in (("department_name", "rank"), ("owning_department", "lookup")):
        assert (got[name].by, got[name].transform, got[name].refs) == (by, "fk_lookup", ["departments.dept_name"]), got[name]
        # the weaker edge is taken: it leads to the target's own table
        assert [(p["from"], p["to"], p.left_cols, p.confidence) for p in got[name].join_path] == [("employees", "departments", ["dept_id"], 0.91)]
    assert (got["salary"].by, got["salary"].refs, got["salary"].join_path) == ("rank", ["employees.salary"], None)
    none = candidates.plan_mappings(targets.limit(0), columns, spark.createDataFrame([], joins.EDGE))
    assert none.count() == 0


def test_transform_inference(spark):
    src = "array<struct<table:string,column:string,type:string>>"
    rows = [
        ("signup_year", "int", [("c", "signup_date", "date")], False, "date_part"), ("customer_name", "string", [("c", "first_name", "string"), ("c", "last_name", "string")], False, "concat"),
        ("line_total", "decimal", [("o", "quantity", "int"), ("o", "unit_price", "decimal")], False, "arithmetic"), ("region_label", "string", [("r", "region_name", "string")], True, "fk_lookup"),
        ("tenure_days", "int", [("e", "start_date", "date"), ("e", "end_date", "date")], False, "date_diff"), ("x", "int", [], False, "unmapped"), ("d", "date", [("t", "created_text", "string")], False, "date_parse")]
    df = spark.createDataFrame(rows, f"t string, k string, s {src}, j boolean, want string")
    for r in df.select("t", "want", candidates.infer_transform(F.col("t"), F.col("k"), F.col("s"), F.col("j")).alias("got")).collect():
        assert r.got == r.want, r.t


def test_metrics_and_matching(spark):
    ranked = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 1), (3, 1, 0)], "query int, place int, label int")
    assert {r.k: round(r.recall, 4) for r in metrics.recall_at(ranked, [1, 2]).collect()} == {1: 0.3333, 2: 0.6667}
    v = spark.createDataFrame([("customer_name",), ("customer_names",), ("zzz",)], "t string").select("t", candidates.hashed_grams(F.col("t")).alias("v"))
    a = {r.t: r.v for r in v.collect()}
    dot = lambda x, y: sum(w * y.get(k, 0) for k, w in x.items())
    assert dot(a["customer_name"], a["customer_names"]) > 0.8 > dot(a["customer_name"], a["zzz"])


def test_mapping_of_the_star_schema(spark):
    """Prefixes that abbreviate a table stand for it."""
    got = {(r.tt, r.tc): r for r in match_queries.mapping(spark, "/root/testdata/sf0.001").collect()}
    want = {("fact_order", "order_key"): "orders.o_orderkey", ("fact_order", "customer_name"): "customer.c_name", ("fact_order", "order_status"): "orders.o_orderstatus",
            ("fact_order", "total_price"): "orders.o_totalprice", ("fact_order", "nation_name"): "nation.n_name", ("dim_customer", "customer_key"): "customer.c_custkey", ("dim_customer", "nation_name"): "nation.n_name"}
    assert {k: r.refs[0] for k, r in got.items()} == want
    assert [p["to"] for p in got["fact_order", "customer_name"].join_path] == ["customer"] and got["fact_order", "customer_name"].transform == "fk_lookup"
    assert [(p["from"], p["to"]) for p in got["fact_order", "nation_name"].join_path] == [("orders", "customer"), ("customer", "nation")]
    assert all(r.primary == {"fact_order": "orders", "dim_customer": "customer"}[tt] for (tt, _), r in got.items())


def test_flagship(spark):
    df = match_queries.flagship(spark, "/root/testdata/sf0.001")
    assert df.columns == ["order_key", "customer_name", "order_year", "is_open"]
    assert df.count() == 1500 and df.where("customer_name is null").count() == 0


def test_stream_profile_equals_batch(spark):
    from weftline.streaming.profiles import event_profile, read_events

    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = event_profile(read_events(spark, "/root/testdata/sf0.001", batch.schema))
    q = stream.writeStream.format("memory").queryName("profiled").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.event_type): r.n for r in spark.table("profiled").collect()}
    want = {(r.start, r.event_type): r.n for r in event_profile(batch).collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_monotonic_over_parts_equals_one_pass(spark):
    import random

    rng = random.Random(4)
    for n in (0, 3, 4, 5, 400):
        values = [rng.randint(0, 9) if rng.random() < 0.9 else None for _ in range(n)]
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int").repartition(5)
        kept = [v for v in values if v is not None]
        steps = [b - a for a, b in zip(kept, kept[1:])]
        want = max(sum(s >= 0 for s in steps), sum(s <= 0 for s in steps)) / len(steps) if len(kept) >= 5 else 0.0
        assert profile.monotonic(df, "v", ["i"]).first()[0] == pytest.approx(want)
