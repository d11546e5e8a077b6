"""The 96 transformations as functions of columns: each returns a Column that Catalyst compiles.

Null in, null out, unless a function is about nulls. Bad casts and divisions by zero give null, never an error.
Aggregates are for groupBy().agg(); window functions take their partition and order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _window(partition: list, order: list | None = None):
    w = Window.partitionBy(*partition)
    return w.orderBy(*order) if order else w


# A. Identity and structure
def direct_copy(c):
    return _c(c)


def rename_only(c, new: str):
    return _c(c).alias(new)


def type_cast(c, to: str):
    return _c(c).try_cast(to)


def coalesce(*cs):
    return F.coalesce(*map(_c, cs))


def default_replacement(c, default):
    return F.coalesce(_c(c), F.lit(default))


# B. Strings
def concat(*cs, sep: str = " "):
    return F.concat_ws(sep, *map(_c, cs))


def substring(c, length: int = 4, start: int | None = None):
    """The last characters, or those from a start counted from 1."""
    return F.right(_c(c), F.lit(length)) if start is None else F.substring(_c(c), start, length)


def split(c, delimiter: str, n: int):
    return F.split_part(_c(c), F.lit(delimiter), F.lit(n))


def regex_extract(c, pattern: str, group: int = 1):
    return F.regexp_extract(_c(c), pattern, group)


def regex_replace(c, pattern: str, by: str):
    return F.regexp_replace(_c(c), pattern, by)


def lower(c):
    return F.lower(_c(c))


def upper(c):
    return F.upper(_c(c))


def initcap(c):
    return F.initcap(_c(c))


def trim(c):
    return F.trim(_c(c))


def normalize_whitespace(c):
    return F.trim(F.regexp_replace(_c(c), "[ \n\t\r]+", " "))


def replace_punctuation(c):
    return F.regexp_replace(_c(c), "[^A-Za-z0-9 ]", "")


def lpad(c, n: int, fill: str = "0"):
    return F.lpad(_c(c).cast("string"), n, fill)


def rpad(c, n: int, fill: str = " "):
    return F.rpad(_c(c).cast("string"), n, fill)


def slugify(c):
    return F.btrim(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def email_parse(c, part: str = "user"):
    return F.split_part(_c(c), F.lit("@"), F.lit(1 if part == "user" else 2))


def url_parse(c, part: str = "HOST"):
    return F.try_parse_url(_c(c), F.lit(part.upper()))


def path_parse(c, part: str = "basename"):
    path = F.split_part(_c(c), F.lit("?"), F.lit(1))
    base = F.substring_index(path, "/", -1)
    if part == "basename":
        return base
    if part == "extension":
        return F.when(F.contains(base, F.lit(".")), F.substring_index(base, ".", -1)).otherwise("")
    return F.left(path, F.greatest(F.lit(0), F.char_length(path) - F.char_length(base) - 1))


def anonymization(c, edge: int = 1):
    return F.concat(F.left(_c(c), F.lit(edge)), F.lit("***"), F.right(_c(c), F.lit(edge)))


# C. Numbers
def add(a, b):
    return _c(a) + _c(b)


def subtract(a, b):
    return _c(a) - _c(b)


def multiply(a, b):
    return _c(a) * _c(b)


def divide(a, b):
    return F.try_divide(_c(a), _c(b))


def ratio_percentage(a, b):
    return F.lit(100.0) * F.try_divide(_c(a), _c(b))


def scaling_unit_conversion(c, factor: float, offset: float | None = None):
    out = _c(c) * F.lit(float(factor))
    return out if offset is None else out + F.lit(float(offset))


def round(c, digits: int = 0):
    return F.round(_c(c), digits)


def floor(c):
    return F.floor(_c(c)).cast("long")


def ceil(c):
    return F.ceil(_c(c)).cast("long")


def trunc(c):
    return _c(c).cast("long")


def clipping_winsorization(c, low, high):
    """Bounds are numbers or columns; see bounds_of for quantiles of a frame."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.greatest(F.least(_c(c), high), low)


def bounds_of(df: DataFrame, c: str, low: float = 0.05, high: float = 0.95) -> tuple[Column, Column]:
    """Exact quantiles as scalar subqueries: one aggregate each, no window over all rows."""
    return tuple(df.select(F.percentile(c, F.lit(q))).scalar() for q in (low, high))


def abs(c):
    return F.abs(_c(c))


def sign(c):
    return F.signum(_c(c)).cast("int")


def log(c):
    return F.when(_c(c) > 0, F.ln(_c(c)))


def power(c, p: float):
    return F.pow(_c(c), F.lit(p))


def min_max_normalize(c, low: Column, high: Column):
    """low and high are of the whole frame, as scalar subqueries or joined columns."""
    return F.try_divide(_c(c) - low, high - low)


def z_score_normalize(c, mean: Column, deviation: Column):
    return F.try_divide(_c(c) - mean, deviation)


def bucketing_binning(c, edges: list[tuple[float, str]], other: str):
    out = F.lit(other)
    for edge, label in reversed(edges):
        out = F.when(_c(c) < edge, label).otherwise(out)
    return out


# D. Dates and times
def parse_datetime(c, pattern: str = "yyyy-MM-dd"):
    return F.try_to_date(_c(c), pattern)


def format_datetime(c, pattern: str):
    return F.date_format(_c(c), pattern)


def extract_year(c):
    return F.year(_c(c))


def extract_quarter(c):
    return F.quarter(_c(c))


def extract_month(c):
    return F.month(_c(c))


def extract_week(c):
    return F.weekofyear(_c(c))


def extract_day(c):
    return F.dayofmonth(_c(c))


def extract_hour(c):
    return F.hour(_c(c))


def add_interval(c, days: int):
    return _c(c) + F.make_dt_interval(F.lit(days))


def subtract_interval(c, days: int):
    return _c(c) - F.make_dt_interval(F.lit(days))


def date_difference(a, b):
    return F.datediff(_c(a), _c(b))


def truncate_to_period(c, period: str = "MONTH"):
    return F.date_trunc(period, _c(c)).cast("date")


def timezone_conversion(c, source: str, target: str):
    return F.convert_timezone(F.lit(source), F.lit(target), _c(c))


def fiscal_calendar(c, months: int = 6):
    return F.concat(F.lit("FY"), F.year(F.add_months(_c(c), months)).cast("string"))


# E. Booleans and conditions
def threshold_flag(c, t):
    return _c(c) > F.lit(t)


def equality_check(c, v):
    return _c(c) == F.lit(v)


def range_check(c, low, high):
    return _c(c).between(low, high)


def in_list_check(c, values: list):
    return _c(c).isin(values)


def case_when_multi(rules: list[tuple[Column, object]], other):
    out = F.lit(other)
    for condition, value in reversed(rules):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def null_presence_flag(c, present: bool = True):
    return _c(c).isNotNull() if present else _c(c).isNull()


def regex_match_flag(c, pattern: str):
    return _c(c).rlike(pattern)


# F. Categories
def code_to_label(c, labels: dict, other=None):
    out = F.lit(other)
    for code, label in labels.items():
        out = F.when(_c(c) == code, label).otherwise(out)
    return out


def category_harmonization(c, groups: dict[str, list[str]], other: str):
    out = F.lit(other)
    for name, raw in groups.items():
        out = F.when(F.upper(F.trim(_c(c))).isin(raw), name).otherwise(out)
    return out


def synonym_normalization(df: DataFrame, c: str, synonyms: DataFrame, out: str = "value") -> DataFrame:
    """synonyms has key and canonical. The plan's own size estimate decides on a broadcast."""
    joined = df.join(synonyms, df[c] == synonyms["key"], "left")
    return joined.withColumn(out, F.coalesce("canonical", F.lower(df[c]))).drop("key", "canonical")


def hierarchy_rollup(df: DataFrame, parent: DataFrame, on: Column) -> DataFrame:
    return df.join(parent, on)


# G. Lookups
def fk_dimension_enrichment(df: DataFrame, dimension: DataFrame, on: Column) -> DataFrame:
    return df.join(dimension, on, "left")


def multi_hop_lookup(df: DataFrame, hops: list[tuple[DataFrame, Column]]) -> DataFrame:
    return reduce(lambda left, hop: left.join(hop[0], hop[1], "left"), hops, df)


def fallback_lookup(df: DataFrame, hops: list[tuple[DataFrame, Column]], values: list, default, out: str = "value") -> DataFrame:
    return multi_hop_lookup(df, hops).withColumn(out, F.coalesce(*map(_c, values), F.lit(default)))


# H. Aggregates
def sum_agg(c):
    return F.sum(_c(c))


def avg_agg(c):
    return F.avg(_c(c))


def count_agg(c):
    return F.count(_c(c))


def min_agg(c):
    return F.min(_c(c))


def max_agg(c):
    return F.max(_c(c))


def distinct_count(c):
    return F.count_distinct(_c(c))


def string_agg(c, sep: str = ","):
    return F.array_join(F.array_sort(F.collect_list(_c(c))), sep)


# I. Windows
def row_number(partition, order):
    return F.row_number().over(_window(partition, order)).cast("long")


def rank(partition, order):
    return F.rank().over(_window(partition, order)).cast("long")


def dense_rank(partition, order):
    return F.dense_rank().over(_window(partition, order)).cast("long")


def lag(c, partition, order, n: int = 1):
    return F.lag(_c(c), n).over(_window(partition, order))


def lead(c, partition, order, n: int = 1):
    return F.lead(_c(c), n).over(_window(partition, order))


def cumulative_sum(c, partition, order):
    return F.sum(_c(c)).over(_window(partition, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def cumulative_count(partition, order):
    return F.count("*").over(_window(partition, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def moving_avg(c, partition, order, n: int = 7):
    return F.avg(_c(c)).over(_window(partition, order).rowsBetween(1 - n, Window.currentRow))


def window_stats(c, partition, what: str = "stddev_samp"):
    return getattr(F, what)(_c(c)).over(_window(partition))


# J. Semi-structured values
def json_extract(c, path: str):
    return F.get_json_object(_c(c), path)


def xml_extract(c, path: str):
    return F.xpath_string(_c(c), F.lit(path))


def array_index(c, n: int):
    return F.get(_c(c), F.lit(n))


def explode_flatten_aggregate(df: DataFrame, key: str, array: Column, agg: Column) -> DataFrame:
    return df.select(key, F.explode(array).alias("item")).groupBy(key).agg(agg)


# K. Data quality
def dedup_canonical(df: DataFrame, canonical: Column, order: list) -> DataFrame:
    """One row of each canonical key, the first in order."""
    ranked = df.withColumn("_turn", F.row_number().over(Window.partitionBy(canonical).orderBy(*order)))
    return ranked.where("_turn = 1").drop("_turn")


def missing_imputation(c, value):
    return F.coalesce(_c(c), value if isinstance(value, Column) else F.lit(value))


def invalid_standardization(c, domain: list, default=None):
    return F.when(_c(c).isin(domain), _c(c)).otherwise(F.lit(default))


# L. Privacy
def hash(c):
    return F.sha2(_c(c), 256)


def tokenization(c, salt: str = "salt"):
    return F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat(F.lit(salt + "|"), _c(c)), 256), 1, 16))


def masking(c, keep: int = 4):
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.lit(0), F.char_length(_c(c)) - keep)), F.right(_c(c), F.lit(keep)))


def redaction(c, pattern: str = "[0-9]{3,}", by: str = "[REDACTED]"):
    return F.regexp_replace(_c(c), pattern, by)


def deterministic_encryption(c, key: str):
    """AES in ECB mode: equal values have equal ciphertexts, by design."""
    return F.hex(F.aes_encrypt(_c(c), F.lit(key), F.lit("ECB"), F.lit("PKCS")))
