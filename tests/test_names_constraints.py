from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.functions import legacy, values
from weftline.operators import constraints, names
from weftline.sources import catalog


def scores(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    x, y = F.col("a"), F.col("b")
    return df.select("a", "b", names.join_name_score(x, y).alias("join"), names.name_similarity(x, y).alias("name"), names.conflicts(names.expand(names.words(x)), names.expand(names.words(y))).alias("conflicts"), names.bridge_similarity(x, y).alias("bridge")).collect()


def test_names(spark):
    rows = {(r.a, r.b): r for r in scores(spark, [
        ("customer_id", "customer_id"), ("customer_id", "customerid"), ("cust_id", "customer_id"), ("store_id", "line_id"), ("first_name", "name"), ("min_price", "max_price"),
        ("cust_addr", "customer_address"), ("start_date", "end_date"), ("created_at", "deleted_at"), ("buyer_id", "seller_id"), ("amount_usd", "amount_eur"), ("emp", "employee")])}
    assert rows["customer_id", "customer_id"].join == 1.0
    assert rows["customer_id", "customerid"].join == 0.95
    assert rows["cust_id", "customer_id"].join == 0.88  # one stem is part of the other
    assert rows["store_id", "line_id"].join == 0.48
    assert rows["first_name", "name"].join == pytest.approx(0.5)
    assert rows["cust_addr", "customer_address"].name == 1.0
    assert rows["min_price", "max_price"].conflicts == ["directional"]
    assert rows["start_date", "end_date"].conflicts == ["directional"]
    assert rows["created_at", "deleted_at"].conflicts == ["temporal"]
    assert rows["buyer_id", "seller_id"].conflicts == ["role"]
    assert "unit" in rows["amount_usd", "amount_eur"].conflicts
    assert rows["emp", "employee"].bridge == 1.0
    # a name never conflicts with itself, nor a unit with what it stands for; different units of a kind do
    rows = {(r.a, r.b): r for r in scores(spark, [("amount_usd", "amount_usd"), ("price_usd", "price_dollar"), ("speed_m_sec", "speed_m_hr"), ("fname", "firstname"), ("lname", "lastname"), ("fname", "first_name")])}
    assert rows["amount_usd", "amount_usd"].name == 1.0 and rows["amount_usd", "amount_usd"].conflicts == []
    assert rows["price_usd", "price_dollar"].conflicts == [] and "unit" in rows["speed_m_sec", "speed_m_hr"].conflicts
    assert all(rows[p].bridge > 0.2 for p in (("fname", "firstname"), ("lname", "lastname"), ("fname", "first_name")))


def test_labels_of_united_records(spark):
    parts = [spark.createDataFrame([(1, "date_trunc_week"), (2, "concat")], "id int, label string"), spark.createDataFrame([(3, "date_diff_days", 0.5)], "id int, label string, weight double")]
    got = [tuple(r) for r in catalog.union_records(parts, "label", legacy.ALIASES, 7).collect()]
    assert sorted(got) == [(1, "truncate_to_period", None), (2, "concat", None), (3, "date_difference", 0.5)]
    assert got == [tuple(r) for r in catalog.union_records(parts[::-1], "label", legacy.ALIASES, 7).collect()]


def constraint(spark, a, b):
    blank = {"table": "t", "column": "c", "ordinal": 0, "type": "int", "nullable": True, "is_pk": False, "is_fk": False, "is_unique": False, "enum": None, "regex": None, "min": None, "max": None, "description": None}
    names_ = [f.split()[0] for f in catalog.COLUMNS.split(", ")]
    row = lambda x: tuple((blank | x)[n] for n in names_)
    df = spark.createDataFrame([(row(a), row(b))], f"a struct<{catalog.COLUMNS.replace(' ', ':').replace(',:', ',')}>, b struct<{catalog.COLUMNS.replace(' ', ':').replace(',:', ',')}>")
    score, reasons = constraints.constraint_score("a", "b")
    return df.select(score.alias("s"), reasons.alias("r")).first()


def test_constraints(spark):
    pk, fk = {"is_pk": True, "nullable": False, "min": 1.0, "max": 1000.0}, {"is_fk": True, "min": 1.0, "max": 1200.0}
    assert constraint(spark, pk, fk).s >= 0.75
    assert "pk_fk_relation" in constraint(spark, pk, fk).r
    assert constraint(spark, {"enum": ["us", "in", "uk"]}, {"enum": ["fr", "de", "es"]}).s == 0
    assert constraint(spark, {"min": 1.0, "max": 100.0}, {"min": 1000.0, "max": 2000.0}).s == 0
    assert constraint(spark, {"regex": r"^\d+$"}, {"regex": r"^\d+$"}).s >= 0.55


def test_values(spark):
    df = spark.createDataFrame([(" 1,200% ",), ("NaN",), ("n/a",), ("  A  b ",), ("inf",), ("2024-01-02T03",), ("02/01/2024",), (None,)], "v string")
    v = F.col("v")
    got = df.select(values.parse_number(v).alias("x"), values.normalize(v).alias("n"), values.parse_date(v).alias("d")).collect()
    assert [r.x for r in got] == [1200.0, None, None, None, None, None, None, None]
    assert [r.n for r in got] == ["1,200%", None, None, "a b", "inf", "2024-01-02t03", "02/01/2024", None]
    assert [r.d for r in got][5:7] == ["2024-01-02", "2024-01-02"]
    kinds = spark.createDataFrame([("int", "bigint"), ("int", "INT"), ("date", "timestamp"), ("string", "text"), ("int", "string"), ("boolean", "boolean")], "a string, b string")
    assert [r[0] for r in kinds.select(values.type_score(F.col("a"), F.col("b"))).collect()] == [0.95, 1.0, 0.93, 0.90, 0.0, 1.0]


def test_names_are_cut_into_words(spark):
    rows = ["custfirstname", "linenumber", "acctbal", "orderkey", "mktsegment", "shipdate", "birthdate", "ab", "x", "", None, "zzqqj", "extendedprice", "customer"]
    got = {r.t: r.w for r in spark.createDataFrame([(r,) for r in rows], "t string").select("t", names.segment(F.col("t")).alias("w")).collect()}
    want = {
        "custfirstname": ["cust", "first", "name"], "linenumber": ["line", "number"], "acctbal": ["acct", "bal"], "orderkey": ["order", "key"], "mktsegment": ["mktsegment"], "shipdate": ["ship", "date"],
        "birthdate": ["birthdate"], "ab": ["ab"], "x": ["x"], "": [], None: [], "zzqqj": ["zzqqj"], "extendedprice": ["extended", "price"], "customer": ["customer"],
    }
    assert got == want


def test_cuts_equal_brute_force(spark):
    import random
    from itertools import product

    rng, words = random.Random(2), {"ab": 1.0, "abc": 1.5, "cd": 0.5, "bcd": 0.7, "da": 2.0, "aab": 0.1}
    tokens = ["".join(rng.choice("abcd") for _ in range(rng.randint(4, 9))) for _ in range(60)]

    def brute(t):
        if t in words:
            return [t]
        best = None
        for cuts in product([0, 1], repeat=len(t) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(t)]
            parts = [t[i:j] for i, j in zip(at, at[1:])]
            if min(map(len, parts)) >= 2:
                value = (sum(words.get(p, 3 + 1.5 * len(p)) for p in parts), parts)
                best = min(best, value) if best and abs(best[0] - value[0]) > 1e-9 else best if best and best[1] < parts else value
        return best[1]

    got = {r.t: r.w for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", names.segment(F.col("t"), words).alias("w")).collect()}
    cost = lambda parts: sum(words.get(p, 3 + 1.5 * len(p)) for p in parts)
    for t in tokens:
        assert "".join(got[t]) == t and abs(cost(got[t]) - cost(brute(t))) < 1e-9, (t, got[t], brute(t))


def test_meaning_of_the_star_schema(spark):
    from weftline.plans import match_queries

    rows = [(c,) for cs in match_queries.SCHEMA.values() for c in cs] + [("CustFirstName",), ("xyzw_qty",)]
    got = {r.c: r.m for r in spark.createDataFrame(rows, "c string").select("c", names.meaning(F.col("c")).alias("m")).collect()}
    assert got["c_custkey"] == ["c", "customer", "key"] and got["c_acctbal"] == ["c", "account", "balance"] and got["l_shipdate"] == ["l", "shipment", "date"]
    assert got["CustFirstName"] == ["customer", "first", "name"] and got["n_nationkey"][1:] == ["nation", "key"]
    asked = spark.createDataFrame(rows, "c string").select("c", names.meaning(F.col("c"), expander=lambda t: F.when(t == "xyzw", "xylophone").otherwise("no")).alias("m"))
    assert {r.c: r.m for r in asked.collect()}["xyzw_qty"] == ["xylophone", "quantity"]
