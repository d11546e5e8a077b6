"""Value rules of the matcher as column expressions. The three normalisations differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings that count as null, in lower case.
NULL_WORDS = ("", "null", "none", "nan", "na", "n/a", "nil")
# Declared types by family.
TYPES = {
    "numeric": ("int", "integer", "bigint", "float", "double", "decimal", "number", "numeric"),
    "string": ("string", "varchar", "text", "char", "clob"),
    "date": ("date", "datetime", "timestamp", "time"),
}


def is_null(v: Column) -> Column:
    return v.isNull() | F.lower(F.trim(v)).isin(list(NULL_WORDS))


def normalize(v: Column) -> Column:
    """Profiles: trimmed, lower case, inner white space collapsed; null words are null."""
    return F.when(~is_null(v), F.trim(F.regexp_replace(F.lower(v), r"\s+", " ")))


def normalize_join(v: Column) -> Column:
    """Join tuples: trimmed and lower case; only empty is null."""
    return F.nullif(F.lower(F.trim(v)), F.lit(""))


def normalize_match(v: Column) -> Column:
    """Candidate matching: trimmed, case kept."""
    return F.nullif(F.trim(v), F.lit(""))


def parse_number(v: Column) -> Column:
    """Commas go, a trailing percent sign goes without dividing; only finite numbers."""
    x = F.regexp_replace(F.replace(F.trim(v), F.lit(","), F.lit("")), "%$", "").try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def parse_date(v: Column) -> Column:
    """YYYY-MM-DD by its beginning, or DD-MM-YYYY, with - or /; as text, without a look at the calendar."""
    y, d = r"^(\d{4})[-/](\d{2})[-/](\d{2})", r"^(\d{2})[-/](\d{2})[-/](\d{4})"
    part = lambda pattern, i: F.regexp_extract(v, pattern, i)
    first = F.concat_ws("-", part(y, 1), part(y, 2), part(y, 3))
    return F.when(v.rlike(y), first).when(v.rlike(d), F.concat_ws("-", part(d, 3), part(d, 2), part(d, 1)))


def type_family(declared: Column) -> Column:
    out = F.lit(None).cast("string")
    for family, names in TYPES.items():
        out = F.when(F.lower(declared).isin(list(names)), family).otherwise(out)
    return out


def type_score(a: Column, b: Column) -> Column:
    """Equal 1, both numeric .95, both dates .93, both strings .90, else 0."""
    fa, fb = type_family(a), type_family(b)
    out = F.lit(0.0)
    for family, score in (("string", 0.90), ("date", 0.93), ("numeric", 0.95)):
        out = F.when((fa == family) & (fb == family), score).otherwise(out)
    return F.when(F.lower(a) == F.lower(b), 1.0).otherwise(out)


def type_bucket(declared: Column) -> Column:
    """Buckets for candidates: numeric (also smallint), string, date, boolean, other."""
    low = F.lower(declared)
    return F.when(low.isin("boolean", "bool"), "boolean").when(low == "smallint", "numeric").otherwise(F.coalesce(type_family(declared), F.lit("other")))


# Source buckets that a target bucket accepts.
COMPATIBLE = {
    "string": ("string", "numeric", "date", "boolean", "other"),
    "numeric": ("numeric", "string", "date"),
    "date": ("date", "string", "numeric"),
    "boolean": ("boolean", "string", "numeric", "date"),
    "other": ("string", "numeric", "date", "boolean", "other"),
}


def compatible(target: Column, source: Column) -> Column:
    accepted = F.lit(False)
    for t, sources in COMPATIBLE.items():
        accepted = accepted | ((target == t) & source.isin(list(sources)))
    return accepted
