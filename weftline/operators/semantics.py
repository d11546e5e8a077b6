"""Meaning of names by supplied vectors: concepts, affinity across types, roles.

Any embedding serves: names come with unit vectors, and concepts with the unit vectors of their descriptions. All
scores are column expressions over a map of concept scores; the concepts are a handful of literals, so names are only
scanned. Without vectors the lexical fallbacks apply.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import jaccard, simple_tokens

# Concepts that names are compared with.
CONCEPTS = (
    "monetary", "exchange_rate", "currency", "email", "username", "full_name", "name_component", "date_temporal", "date_extraction", "duration_span", "identifier", "location_geo", "status_flag",
    "text_description", "file_resource", "aggregation", "percentage_ratio", "phone_contact", "category_class", "concatenation", "parsing_extraction",
)
# Roles of targets, by the concept and the least score that give them.
ROLES = {
    "amount_like": ("monetary", 0.42), "username_like": ("username", 0.42), "email_like": ("email", 0.42), "full_name_like": ("full_name", 0.42), "date_part_like": ("date_extraction", 0.40),
    "duration_like": ("duration_span", 0.40), "identifier_like": ("identifier", 0.42),
}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def concept_scores(names: DataFrame, concepts: dict[str, list[float]], vector: str = "vector") -> DataFrame:
    """names with concepts, a map from each concept to the cosine of its vector and the name's. Both are unit vectors."""
    told = json.dumps([{"concept": c, "v": [float(x) for x in v]} for c, v in sorted(concepts.items())])
    each = F.from_json(F.lit(told), "array<struct<concept string, v array<double>>>")
    mine = F.transform(F.col(vector), lambda x: x.cast("double"))
    scores = F.map_from_entries(F.transform(each, lambda c: F.struct(c["concept"], dot(mine, c["v"]))))
    return names.withColumn("concepts", scores)


def of(scores: Column, concept: str) -> Column:
    """A concept's score, 0 where it has none."""
    return F.coalesce(F.try_element_at(scores, F.lit(concept)), F.lit(0.0))


def best_concepts(scores: Column, top: int = 3) -> Column:
    """The concepts of the highest scores as structs (concept, score), of equal scores the first by name."""
    each = F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("concept")))
    return F.transform(F.slice(F.array_sort(each), 1, top), lambda e: F.struct(e["concept"].alias("concept"), (-e["less"]).alias("score")))


def cross_type_affinity(target: Column, source: Column, similarity: Column) -> Column:
    """How likely a source becomes a target by a transformation, by what both are about; 0 where nothing is known.

    A date gives parts and spans, an address a user's name, a rate an amount, parts of a name the whole one, text what is
    parsed from it; names alike beyond .55 count a tenth.
    """
    t, s = (lambda c: of(target, c)), (lambda c: of(source, c))
    least = lambda a, b: F.least(a, b) / 0.50
    text = F.greatest(s("text_description"), s("email"), s("file_resource"))
    rules = [
        F.when((t("date_extraction") > 0.38) & (s("date_temporal") > 0.38), 0.35 * least(t("date_extraction"), s("date_temporal"))),
        F.when((t("duration_span") > 0.38) & (s("date_temporal") > 0.38), 0.30 * least(t("duration_span"), s("date_temporal"))),
        F.when((t("username") > 0.38) & (s("email") > 0.38), 0.35 * least(t("username"), s("email"))),
        F.when((t("monetary") > 0.38) & (s("exchange_rate") > 0.35), 0.30), F.when((t("full_name") > 0.38) & (s("name_component") > 0.38), 0.30),
        F.when((t("parsing_extraction") > 0.35) & (text > 0.35), 0.20), F.when(similarity > 0.55, 0.10 * similarity),
    ]
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), *[F.coalesce(r, F.lit(0.0)) for r in rules]))


def target_roles(scores: Column) -> Column:
    """The roles that a target plays, sorted."""
    money = (of(scores, "currency") > 0.42) | ((of(scores, "monetary") > 0.45) & (of(scores, "exchange_rate") > 0.30))
    found = [F.when(money, "currency_like"), *[F.when(of(scores, c) > least, role) for role, (c, least) in ROLES.items()]]
    return F.array_sort(F.array_compact(F.array(*found)))


def role_compatibility(target: Column, sources: Column) -> Column:
    """How well sources serve a target's role, 0 to 1. sources: array of structs (concepts, similarity)."""
    t = lambda c: of(target, c)
    some = lambda c, least: F.exists(sources, lambda s: of(s["concepts"], c) > least)
    affinity = F.aggregate(sources, F.lit(0.0), lambda a, s: F.greatest(a, cross_type_affinity(target, s["concepts"], s["similarity"])))
    parts = F.size(F.filter(sources, lambda s: of(s["concepts"], "name_component") > 0.40))
    money, whole = (t("monetary") > 0.40) | (t("currency") > 0.40), (t("full_name") > 0.40) | (t("concatenation") > 0.35)
    gains = [
        F.when(affinity > 0.1, affinity), F.when(money & some("monetary", 0.40), 0.25), F.when(money & some("exchange_rate", 0.35), 0.30), F.when(whole, F.when(parts >= 2, 0.60).when(parts == 1, 0.25)),
        F.when((t("username") > 0.40) & some("email", 0.40), 0.50), F.when(((t("date_extraction") > 0.40) | (t("duration_span") > 0.40)) & some("date_temporal", 0.40), 0.40),
    ]
    score = reduce(lambda a, b: a + b, [F.coalesce(g, F.lit(0.0)) for g in gains])
    nearest = F.aggregate(sources, F.lit(-1.0), lambda a, s: F.greatest(a, s["similarity"]))
    score = F.when(F.size(sources) == 0, 0.0).when(score < 0.1, 0.20 * nearest).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def lexical_compatibility(target: Column, sources: Column) -> Column:
    """The fallback without vectors: a fifth of the mean overlap of names' words. sources: array of names."""
    words = lambda c: F.array_distinct(simple_tokens(c))
    total = F.aggregate(F.transform(sources, lambda s: jaccard(words(target), words(s))), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(sources) > 0, 0.20 * total / F.size(sources)).otherwise(0.0)


def blended_similarity(lexical: Column, semantic: Column, cross: Column) -> Column:
    """Of names: meaning, spelling and affinity, never below spelling alone."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(0.55 * semantic + 0.30 * lexical + 0.15 * cross, 0.40 * lexical + 0.35 * semantic + 0.25 * cross, lexical)))
