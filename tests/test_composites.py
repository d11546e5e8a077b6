"""Composite joins: sketches against exact counts, and edges whatever the size of a sketch."""

from __future__ import annotations

import random

import pytest

from weftline.operators import joins
from weftline.sources import catalog


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    keys = [(r, s, d) for r in range(8) for s in range(12) for d in range(30)]
    rng.shuffle(keys)
    plan = [(*k, rng.random()) for k in keys]
    fact = [(*rng.choice(keys[:2000]), rng.choice([None, "x", "y"])) for _ in range(6000)]
    fact += [(None, 1, 1, "x")] * 50
    return {
        "plan": spark.createDataFrame(plan, "region_no int, store_no int, day_no int, goal double"),
        "visits": spark.createDataFrame(fact, "region_no int, store_no int, day_no int, note string"),
    }


def edges(spark, tables, **limits):
    found = joins.discover(tables, catalog.from_frames(spark, tables), joins.Limits(top_composites=9, **limits)).where("kind = 'composite'").collect()
    return {(frozenset(zip(e.left_cols, e.right_cols)), e.cardinality, e.confidence) for e in found}


def test_edges_do_not_depend_on_the_sketch(spark, tables):
    whole = edges(spark, tables, sketch=10**9)
    key = frozenset((c, c) for c in ("region_no", "store_no", "day_no"))
    assert (key, "1:N") in {e[:2] for e in whole}
    assert edges(spark, tables, sketch=64) == whole == edges(spark, tables)


def combination(left, right, number=0):
    return joins.Combination(number, left, right, 0.8, 1.0, 0.5, False, False)


def distinct(df, columns):
    return {r for r in map(tuple, df.select(*columns).collect()) if None not in r}


def test_sketches_count_like_sets(spark, tables):
    combos = [
        combination(("plan", ("region_no", "store_no")), ("visits", ("region_no", "store_no")), 0),
        combination(("plan", ("store_no", "day_no")), ("visits", ("day_no", "store_no")), 1),
        combination(("visits", ("region_no", "day_no", "store_no")), ("plan", ("region_no", "day_no", "store_no")), 2),
        combination(("plan", ("region_no", "goal")), ("visits", ("region_no", "note")), 3),
    ]
    exact, sampled = joins.sketched(tables, combos, 10**9), joins.sketched(tables, combos, 400)
    for c in combos:
        sides = [distinct(tables[t], columns) for t, columns in (c.left, c.right)]
        contain = len(sides[0] & sides[1]) / min(map(len, sides))
        e, s = exact[c.number], sampled[c.number]
        assert e.whole and e.drawn in map(len, sides) and e.hits == len(sides[0] & sides[1])
        assert contain <= e.contain and contain <= s.contain and s.drawn <= 1.3 * 400
        assert e.apart == (contain == 0)
        assert abs(s.hits / s.drawn - contain) < 0.15


def test_only_hopeless_combinations_are_rejected():
    limits, c = joins.Limits(), combination(("a", ("x", "y")), ("b", ("x", "y")))
    may = lambda *sketch, **more: joins._open(c, joins.Sketch(*sketch), joins.Limits(**more))
    assert may(80, 60, True) and not may(80, 9, True) and not may(0, 0, True)
    # a sample may stray by .32, and nothing is known from an empty one
    assert may(100, 60, False) and may(100, 20, False, min_composite=0.7) and not may(100, 0, False, min_composite=0.75) and may(0, 0, False)
    assert limits.sketch == 1024


def test_three_pairs_need_alive_parts():
    class Pair:
        lt, rt, confidence, type_score, constraint_score = "a", "b", 0.9, 1.0, 0.5
        lis_pk = ris_pk = lis_fk = ris_fk = lis_unique = ris_unique = False

        def __init__(self, lc, rc):
            self.lc, self.rc = lc, rc

    found = [Pair("p", "p"), Pair("q", "q"), Pair("r", "r"), Pair("p", "q")]
    two = joins.combinations_of(found, 2, 0)
    assert [(c.left[1], c.right[1]) for c in two] == [(("p", "q"), ("p", "q")), (("p", "r"), ("p", "r")), (("q", "r"), ("q", "r")), (("r", "p"), ("r", "q"))]
    alive = {frozenset(zip(c.left[1], c.right[1])) for c in two}
    assert [c.left[1] for c in joins.combinations_of(found, 3, 4, alive)] == [("p", "q", "r")]
    assert joins.combinations_of(found, 3, 4, alive - {frozenset({("p", "p"), ("q", "q")})}) == []


def test_no_rows_and_no_pairs(spark, tables):
    assert edges(spark, {"plan": tables["plan"], "none": tables["visits"].limit(0)}) == set()
    assert edges(spark, {"plan": tables["plan"].select("goal"), "visits": tables["visits"].select("note")}) == set()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tuples_are_made_without_lambdas_and_counted_in_one_shuffle(spark, tables):
    lists = [(0, ("region_no", "store_no"), 1.0), (1, ("region_no", "store_no", "day_no"), 1.0)]
    assert "lambda" not in plan(joins.tuple_hashes(tables["plan"], lists))
    sides = [joins.tuples(tables[t], [(n, list(columns)) for n, columns, _ in lists]) for t in ("plan", "visits")]
    assert "lambda" not in plan(sides[0])
    metrics = plan(joins.tuple_metrics(*sides))
    assert "Join" not in metrics and metrics.count("Exchange hashpartitioning") == 2


def test_unlike_tuples_have_unlike_keys(spark):
    rows = [("a", "b:c", None), ("a:b", "c", "x"), ("1:a", "1:b", "x"), ("a", "1:b1:c", "x"), ("a1:b", "c", "x"), (" A ", "b:c", "y"), ("", "b", "y"), (None, "b", "y")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    combos = [(0, ["a", "b"]), (1, ["b", "a"]), (2, ["a", "b", "c"])]
    got = {(r.combo, r.key): r.n for r in joins.tuple_counts(df, combos).collect()}
    assert sorted((c, n) for (c, _), n in got.items()) == [(0, 1)] * 4 + [(0, 2)] + [(1, 1)] * 4 + [(1, 2)] + [(2, 1)] * 5
    hashes = joins.tuple_hashes(df, [(n, tuple(columns), 1.0) for n, columns in combos]).distinct().groupBy("list").count().collect()
    assert {r["list"]: r["count"] for r in hashes} == {0: 5, 1: 5, 2: 5}
    m = joins.tuple_metrics(joins.tuple_counts(df, combos), joins.tuples(df.where("c = 'y'"), combos)).where("combo = 0").first()
    assert (m.contain, m.jacc, m.freq, m.lu, m.ru) == (1.0, 1 / 5, 1 / 6, 5 / 6, 1.0)
