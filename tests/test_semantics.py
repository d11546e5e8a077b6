"""Concept scores, affinity and roles on vectors made by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.operators import semantics

AXES = {c: [1.0 if i == j else 0.0 for j in range(21)] for i, c in enumerate(semantics.CONCEPTS)}


def vector(**parts):
    v = [float(parts.get(c, 0.0)) for c in semantics.CONCEPTS]
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v]


@pytest.fixture(scope="module")
def scored(spark):
    names = {
        "signup_year": vector(date_extraction=1, date_temporal=0.2), "signup_date": vector(date_temporal=1), "login": vector(username=1), "mail": vector(email=1), "full": vector(full_name=1), "first": vector(name_component=1),
        "last": vector(name_component=1, identifier=0.1), "price_eur": vector(monetary=1, currency=0.9), "price": vector(monetary=1), "rate": vector(exchange_rate=1), "tenure": vector(duration_span=1), "odd": vector(aggregation=1),
    }
    df = spark.createDataFrame(list(names.items()), "name string, vector array<double>")
    return {r.name: r.concepts for r in semantics.concept_scores(df, AXES).collect()}, names


def ask(spark, scored, target, *sources):
    concepts, vectors = scored
    similarity = lambda a, b: sum(x * y for x, y in zip(vectors[a], vectors[b]))
    row = (concepts[target], [(concepts[s], similarity(target, s)) for s in sources])
    df = spark.createDataFrame([row], "t map<string,double>, s array<struct<concepts:map<string,double>,similarity:double>>")
    first = F.get("s", F.lit(0))
    return df.select(semantics.cross_type_affinity(F.col("t"), first["concepts"], first["similarity"]), semantics.role_compatibility(F.col("t"), F.col("s")), semantics.target_roles(F.col("t")), semantics.best_concepts(F.col("t"), 2)).first()


def test_rules(spark, scored):
    d = scored[0]["signup_year"]["date_extraction"]
    affinity, role, roles, best = ask(spark, scored, "signup_year", "signup_date")
    assert affinity == pytest.approx(0.35 * d / 0.5) and role == pytest.approx(min(1.0, 0.35 * d / 0.5 + 0.40)) and roles == ["date_part_like"]
    assert [b.concept for b in best] == ["date_extraction", "date_temporal"]
    assert ask(spark, scored, "login", "mail")[:2] == pytest.approx((0.70, 1.0))
    assert ask(spark, scored, "full", "first")[1] == pytest.approx(0.30 + 0.25) and ask(spark, scored, "full", "first", "last")[1] == pytest.approx(0.30 + 0.60)
    assert ask(spark, scored, "price_eur", "price", "rate")[1] == pytest.approx(0.30 + 0.25 + 0.30) and "currency_like" in ask(spark, scored, "price_eur", "price")[2]
    assert ask(spark, scored, "tenure", "signup_date")[0] == pytest.approx(0.60)
    affinity, role, roles, _ = ask(spark, scored, "odd", "mail")
    assert affinity == 0.0 and role == pytest.approx(0.0) and roles == []
    assert ask(spark, scored, "odd")[1] == 0.0


def test_fallbacks_and_blend(spark):
    df = spark.createDataFrame([("order_date", ["order_date", "ship_date"]), ("x", [])], "t string, s array<string>")
    got = [r[0] for r in df.select(semantics.lexical_compatibility(F.col("t"), F.col("s"))).collect()]
    assert got == pytest.approx([0.20 * (1 + 1 / 3) / 2, 0.0])
    blend = lambda *x: spark.range(1).select(semantics.blended_similarity(*map(F.lit, x))).first()[0]
    assert blend(0.9, 0.0, 0.0) == 0.9 and blend(0.2, 0.9, 0.3) == pytest.approx(0.55 * 0.9 + 0.06 + 0.045) and blend(0.5, 0.5, 1.0) == pytest.approx(0.625)
    none = spark.createDataFrame([("a", None), ("b", [])], "name string, vector array<double>")
    assert {r.name: r.concepts["email"] for r in semantics.concept_scores(none, {"email": [1.0]}).collect()} == {"a": None, "b": None}
