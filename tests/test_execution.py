"""Execution-guided scores against a version in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.operators import execution as ex
from weftline.operators.paths import Step
from weftline.plans import match_queries


def test_the_right_template_wins(spark):
    rows = match_queries.execution_scores(spark, "/root/testdata/sf0.01").collect()
    best = {}
    for r in rows:
        best.setdefault(r.target, []).append((-r.score, r.refs, r.family))
    first = {t: sorted(x)[0][1:] for t, x in best.items()}
    assert first["order_year"] == ("orders.o_orderdate", "date_part")
    assert first["segment_lower"][0] == "customer.c_mktsegment"
    assert first["price_hundredth"] == ("orders.o_totalprice", "scale")
    assert first["customer_label"] == ("customer.c_name+customer.c_mktsegment", "concat")
    assert first["priority_end"] == ("orders.o_orderpriority", "substring")
    assert first["price_total"][0] == "orders.o_totalprice"


def overlap(a, b):
    shared = sum((Counter(a) & Counter(b)).values())
    return shared / min(len(a), len(b)) if a and b else 0.0


def score(p, t):
    """p, t: texts in the sample's order."""
    number = lambda v: float(v.replace(",", "").removesuffix("%")) if re.fullmatch(r"-?[\d,]+(\.\d+)?%?", v) else None
    px, tx = ([x for v in vs if (x := number(v)) is not None] for vs in (p, t))
    if len(px) >= 0.8 * len(p) and len(tx) >= 0.8 * len(t):
        n = min(len(px), len(tx))
        a, b = sorted(px[:n]), sorted(tx[:n])
        span = max(max(a) - min(a), max(b) - min(b), 1e-9)
        near = max(0.0, 1 - sum(abs(x - y) for x, y in zip(a, b)) / n / span)
        return 0.75 * near + 0.25 * overlap([round(x, 6) for x in a], [round(x, 6) for x in b])
    words = lambda vs: [w for v in vs for w in re.split("[^a-z0-9]+", v.lower()) if w]
    return 0.6 * overlap([v.lower() for v in p], [v.lower() for v in t]) + 0.4 * overlap(words(p), words(t))


def test_scores_equal_plain_python(spark):
    rng = random.Random(7)
    draw = [lambda: str(rng.randint(0, 30)), lambda: f"{rng.random() * 9:.2f}", lambda: rng.choice(["Red", "red fox", "blue", "a-b", "12"]), lambda: f"{rng.randint(1, 9)}%"]
    made = {("r", f"f{i}"): [rng.choice(draw[i % 4:i % 4 + 1 + i % 2])() for _ in range(rng.randint(1, 40))] for i in range(12)}
    bags = {f"t{j}": [rng.choice(draw[j:j + 1])() for _ in range(rng.randint(1, 40))] for j in range(4)}
    m = spark.createDataFrame([(*k, i, v) for k, vs in made.items() for i, v in enumerate(vs)], "refs string, family string, pos int, value string")
    e = spark.createDataFrame([(k, i, v) for k, vs in bags.items() for i, v in enumerate(vs)], "target string, pos int, value string")
    pairs = spark.createDataFrame([(t, *k) for t in bags for k in made], "target string, refs string, family string")
    got = {(r.target, r.family): r.score for r in ex.match_scores(m, e, pairs).collect()}
    assert len(got) == 48
    for (t, f), value in got.items():
        assert value == pytest.approx(score(made["r", f], bags[t]), abs=1e-9), (t, f)


def test_templates(spark):
    rows = [("Ann.Lee@x.org", "7"), ("report.PDF", "0"), ("2024-03-09 10:00:00", "2024-03-01"), ("1,200.555", "2"), ("a_b c", "x"), ("Yes", "1"), (".x.", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    one = lambda f: [r[0] for r in df.select(ex.template(f, [F.col("a")])).collect()]
    two = lambda f: [r[0] for r in df.select(ex.template(f, [F.col("a"), F.col("b")])).collect()]
    assert one("email_username_extract")[:2] == ["Ann.Lee", None] and one("regex_extract")[:2] == ["Ann.Lee@x.org", "pdf"]
    assert one("split") == ["Ann.Lee", "report.PDF", "2024", "1,200.555", "a", "Yes", "x"]
    assert one("substring")[-1] is None and one("date_part")[2] == "2024" and float(one("scale")[3]) == pytest.approx(12.00555) and one("conditional")[5] == "true"
    assert two("ratio")[3] == "600.2775" and two("ratio")[1] is None and two("date_diff")[2] == "8" and two("concat")[4] == "a_b c x" and two("currency_convert")[3] == "2401.11"


def test_partial_joins(spark):
    tables = {
        "a": spark.createDataFrame([(1, " K ", 10), (2, "k", 20), (3, "", 30), (4, "Z", 40)], "id int, code string, n int"),
        "b": spark.createDataFrame([("K", 10, "by both"), ("k", 99, "by code"), ("Q", 40, "by n"), ("", 0, "blank")], "code string, n long, what string"),
        "c": spark.createDataFrame([("by both", 1.0, "x"), ("by code", 2.0, "y"), ("by code", 2.0, "z")], "what string, w double, leaf string"),
        "d": spark.createDataFrame([(7, "unneeded")], "leaf int, name string"),
    }
    code, number = Step("a", "b", ("code",), ("code",), 0.9, "N:1"), Step("b", "a", ("n",), ("n",), 0.8, "1:N")
    onward, lost = Step("b", "c", ("what",), ("what",), 0.9, "1:N"), Step("c", "d", ("leaf",), ("leaf",), 0.9, "1:N")
    run = lambda edges, needed: sorted((r.a__id, r.b__what) for r in ex.partial_joined(tables, "a", tables["a"], edges, needed).collect())
    assert run([code], {"b"}) == [(1, "by both"), (2, "by code")]
    assert run([number], {"b"}) == [(1, "by both"), (4, "by n")]
    # a pair that both edges join counts once; a table that nobody needs drops no row
    assert run([code, number], {"a", "b"}) == [(1, "by both"), (2, "by code"), (4, "by n")]
    assert run([code, number, onward, lost], {"b"}) == [(1, "by both"), (2, "by code"), (2, "by code"), (4, "by n")]
    assert run([code, number, onward, lost], {"c"}) == [(1, "by both"), (2, "by code"), (2, "by code")]
    assert run([code, number, onward, lost], {"d"}) == []
    both = Step("a", "b", ("code", "n"), ("code", "n"), 0.9, "1:1")
    assert run([both], {"b"}) == [(1, "by both")]
    assert [r.a__id for r in ex.partial_joined(tables, "a", tables["a"], [code], set()).orderBy("a__id").collect()] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        ex.partial_joined(tables, "a", tables["a"], [code], {"c"})
    empty = tables | {"b": tables["b"].limit(0)}
    assert ex.partial_joined(empty, "a", empty["a"], [code], {"b"}).count() == 0


def test_samples_are_the_same_whatever_the_partitions(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    one = [(r.k, r.pos) for r in ex.sample_rows(df, ["k"], 50).orderBy("pos").collect()]
    assert one == [(r.k, r.pos) for r in ex.sample_rows(df.repartition(7), ["k"], 50).orderBy("pos").collect()] and [p for _, p in one] == list(range(1, 51))
    assert one != [(r.k, r.pos) for r in ex.sample_rows(df, ["k"], 50, "salt").orderBy("pos").collect()]


def test_final_scores(spark):
    rows = [(0.6, 0.9, "identity", 0.5, 1, 0), (0.6, 0.2, "concat", 0.5, 3, 2), (0.0, 0.0, "other", 0.0, 5, 9)]
    df = spark.createDataFrame(rows, "b double, q double, f string, s double, n int, e int")
    c = {x: F.col(x) for x in "bqfsne"}
    got = [r[0] for r in df.select(ex.final_score(c["b"], c["q"], c["f"], c["s"], c["n"], c["e"])).collect()]
    assert got[0] == pytest.approx(0.35 * 0.6 + 0.42 * 0.9 + 0.12 * 0.78 + 0.11 * 0.5)
    assert got[1] == pytest.approx(0.48 * 0.6 + 0.28 * 0.2 + 0.13 * 0.74 + 0.11 * 0.5 - 0.05 - 0.03) and got[2] == 0.0
    q = df.select(ex.quick_score(F.lit(None).cast("double"), F.lit("lookup_join"), F.lit(0.9), F.lit(0.5)), ex.quick_score(F.lit(0.5), F.lit("lower"), F.lit(1.0), F.lit(1.0)), ex.final_confidence(F.lit(0.42))).first()
    assert tuple(q) == pytest.approx((0.22 + 0.38 * 0.9 + 0.1, 0.57, 0.5))
    assert df.select(ex.fine_score(*[F.lit(1.0)] * 8), ex.null_distinct_score(F.lit(0.1), F.lit(1.0), F.lit(0.3), F.lit(0.5))).first()[:] == pytest.approx((1.0, 0.55 * 0.8 + 0.45 * 0.5))
