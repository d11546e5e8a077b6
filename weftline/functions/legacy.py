"""Original operators behind older labels, and compositions that scenarios name; see ALIASES for their present labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import transforms as t

_c = t._c

# Older labels and the label that stands for each now.
ALIASES = {
    "format_date": "format_datetime", "parse_date": "parse_datetime", "date_diff_days": "date_difference", "add_days": "add_interval", "date_trunc_year": "truncate_to_period",
    "date_trunc_week": "truncate_to_period", "date_trunc_month": "truncate_to_period", "date_trunc_day": "truncate_to_period", "extract_month": "extract_quarter", "cast_to_int": "type_cast",
    "cast_to_decimal": "type_cast", "in_list": "in_list_check", "between": "range_check", "is_null": "null_presence_flag", "is_not_null": "null_presence_flag", "eq": "equality_check",
    "gt": "threshold_flag", "gte": "threshold_flag", "lt": "threshold_flag", "lte": "threshold_flag", "and_op": "case_when_multi", "or_op": "case_when_multi", "not_op": "case_when_multi",
}


def compare(c, how: str, value) -> Column:
    """eq, neq, gt, gte, lt or lte."""
    c, v = _c(c), F.lit(value)
    return {"eq": c == v, "neq": c != v, "gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[how]


def and_op(*cs) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & _c(c)
    return out


def or_op(*cs) -> Column:
    out = F.lit(False)
    for c in cs:
        out = out | _c(c)
    return out


def not_op(c) -> Column:
    return ~_c(c)


def cast_to_int(c) -> Column:
    return _c(c).try_cast("long")


def cast_to_decimal(c, precision: int = 18, scale: int = 2) -> Column:
    return _c(c).try_cast(f"decimal({precision},{scale})")


def add_days(c, n: int) -> Column:
    return F.date_add(_c(c), n)


def concat_with(sign: str, *cs) -> Column:
    """concat_comma, concat_plus and concat_dash by the sign."""
    return t.concat(*cs, sep=sign)


def lower_trim(c) -> Column:
    return t.lower(t.trim(c))


def trim_upper(c) -> Column:
    return t.upper(t.trim(c))


def conditional_bucket(c, edge, low: str, high: str) -> Column:
    return t.bucketing_binning(c, [(edge, low)], high)


def conditional_recent(c, since: str) -> Column:
    return _c(c) >= F.lit(since).cast("timestamp")


def date_to_quarter_format(c) -> Column:
    return F.concat(F.year(_c(c)).cast("string"), F.lit("-Q"), F.quarter(_c(c)).cast("string"))
