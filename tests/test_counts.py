"""Counts of stored values, sets of columns and cells give what counts of text, joins of values and single numbers give."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import profile, value_similarity


def frames(spark):
    a = spark.createDataFrame(
        [(1, 0.0, "A b", True, "1.0"), (2, -0.0, " a  B", False, "NaN"), (2, float("nan"), "null", None, "1,000"), (None, float("inf"), None, True, "x"), (3, 1e20, "", True, None), (3, None, "7%", False, "-0.0")],
        "i int, d double, s string, b boolean, t string")
    b = spark.range(400).select((F.col("id") % 90).alias("k"), (F.col("id") / 7).alias("x"), F.date_add(F.lit("2020-01-01"), (F.col("id") % 5).cast("int")).alias("day"),
                                (F.col("id") / 10).cast("decimal(8,2)").alias("m"), (F.col("id") / 3).cast("float").alias("f"), F.array("id").alias("list"))
    return {"a": a, "b": b, "c": b.select((F.col("k") + 30).alias("k2"), (F.col("x") * 2).alias("x2"), "day")}


def rows(df):
    return sorted((str(r.table), r.column, str(r.value), str(r.number), r.n) for r in df.collect())


def test_stored_values_are_counted_as_text_is(spark):
    tables = frames(spark)
    assert rows(profile.counted(tables)) == rows(profile.value_counts(profile.cells(tables)))
    some = {"a": ["s", "i"], "c": ["x2"]}
    assert rows(profile.counted({k: tables[k] for k in some}, some)) == rows(profile.value_counts(profile.cells({k: tables[k] for k in some}, some)))


def test_counting_makes_no_text_of_each_cell(spark):
    plan = profile.counted({"b": frames(spark)["b"].select("k", "day")})._jdf.queryExecution().optimizedPlan().toString()
    # what is under the last aggregate; its own line may make text of what it counted
    below = plan[plan.rindex("Aggregate"):].split("\n", 1)[1]
    assert "as string" not in below and "lower(" not in below


def test_shared_values_and_histograms(spark, monkeypatch):
    counts = profile.counted(frames(spark)).persist()
    p = profile.profiles(counts).persist()
    pairs = value_similarity.column_pairs(p).persist()
    held = {}
    for r in counts.where("value is not null").collect():
        held.setdefault((r.table, r.column), set()).add(round(r.number, 6) + 0.0 if r.number is not None else r.value)
    want = {(*x, *y): len(held[x] & held[y]) for x in held for y in held if held[x] & held[y]}
    got = {tuple(r)[:4]: r.shared for r in value_similarity.shared_values(counts, pairs).collect()}
    asked = {tuple(r) for r in pairs.collect()}
    assert got == {k: n for k, n in want.items() if k in asked} and any(got.values())
    scores = []
    for cells in (1, 7, 1 << 14):
        monkeypatch.setattr(value_similarity, "CELLS", cells)
        scores.append(sorted(map(tuple, value_similarity.similarity(counts, p, pairs).select(*value_similarity.KEY, F.round("hist", 12), "value_score").collect())))
    # one cell bins every number by itself
    assert scores[0] == scores[1] == scores[2] and any(0 < s[4] < 1 for s in scores[0])
