"""Compatibility of declared constraints of two columns, as expressions over structs a and b of catalog fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def regex_signature(pattern: Column) -> Column:
    """Which kinds of characters a pattern names; the pattern is lower-cased first."""
    p = F.lower(pattern)
    has = lambda what: F.contains(p, F.lit(what))
    return F.concat_ws(
        "|", F.when(has("\\d") | has("[0-9]"), "digit"), F.when(has("[a-z]") | has("\\w"), "alpha"),
        F.when(has("^") & has("$"), "anchor"), F.when(has("+"), "plus"), F.when(has("*"), "star"))


def range_overlap(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Share of the narrower range that both have; inverted bounds are swapped; a point counts as inside or not."""
    al, ah, bl, bh = F.least(a_min, a_max), F.greatest(a_min, a_max), F.least(b_min, b_max), F.greatest(b_min, b_max)
    low, high, narrow = F.greatest(al, bl), F.least(ah, bh), F.least(ah - al, bh - bl)
    return F.when(high < low, 0.0).when(narrow == 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(high - low, narrow)))


def constraint_score(a: str, b: str) -> tuple[Column, Column]:
    """(score, reasons) for struct columns named a and b. Disjoint enumerations or ranges score 0."""
    x, y = (lambda f: F.col(f"{a}.{f}")), (lambda f: F.col(f"{b}.{f}"))
    no = F.lit(False)
    flag = lambda s, f: F.coalesce(s(f), no)
    pk, fk = (flag(x, "is_pk"), flag(y, "is_pk")), (flag(x, "is_fk"), flag(y, "is_fk"))
    unique = (flag(x, "is_unique") | pk[0], flag(y, "is_unique") | pk[1])
    may = tuple(F.coalesce(s("nullable"), F.lit(True)) for s in (x, y))
    null = (may[0] & ~pk[0], may[1] & ~pk[1])
    relation = (pk[0] & fk[1]) | (pk[1] & fk[0])
    key = F.when(relation, 0.34).when(pk[0] & pk[1], 0.17).when(fk[0] & fk[1], 0.09).otherwise(0.0)
    uniq = F.when(unique[0] & unique[1], 0.08).when(unique[0] != unique[1], -0.10).otherwise(-0.01)
    nulls = F.when(null[0] != null[1], -0.05).otherwise(0.02)
    clean = lambda s: F.array_distinct(F.transform(F.coalesce(s("enum"), F.array().cast("array<string>")), lambda v: F.lower(F.trim(v))))
    ea, eb = clean(x), clean(y)
    shared, either = F.size(F.array_intersect(ea, eb)), F.size(F.array_union(ea, eb))
    disjoint = (F.size(ea) > 0) & (F.size(eb) > 0) & (shared == 0)
    enums = F.when((F.size(ea) > 0) & (F.size(eb) > 0), -0.05 + 0.25 * F.try_divide(shared, either)).when(either > 0, -0.04).otherwise(0.0)
    ra, rb = x("regex"), y("regex")
    regex = F.when(ra.isNull() & rb.isNull(), 0.0).when(ra.isNull() | rb.isNull(), -0.02).when(ra == rb, 0.06).when(regex_signature(ra) == regex_signature(rb), 0.02).otherwise(-0.08)
    ranged = tuple(s("min").isNotNull() & s("max").isNotNull() for s in (x, y))
    overlap = range_overlap(x("min"), x("max"), y("min"), y("max"))
    apart = ranged[0] & ranged[1] & (overlap <= 0)
    ranges = F.when(ranged[0] & ranged[1], -0.04 + 0.22 * overlap).when(ranged[0] | ranged[1], -0.03).otherwise(0.0)
    lax = F.when(pk[0] & may[0], -0.03).otherwise(0.0) + F.when(pk[1] & may[1], -0.03).otherwise(0.0)
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.52 + key + uniq + nulls + enums + regex + ranges + lax))
    score = F.when(disjoint | apart, 0.0).otherwise(F.round(total, 4))
    reasons = F.array_compact(F.array(
        F.when(relation, "pk_fk_relation"), F.when(pk[0] & pk[1], "pk_pk"), F.when(unique[0] != unique[1], "unique_mismatch"),
        F.when(disjoint, "enum_disjoint"), F.when(apart, "range_disjoint"), F.when(ra == rb, "regex_equal"), F.when(null[0] != null[1], "nullable_mismatch")))
    return score, reasons
