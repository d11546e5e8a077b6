"""Evaluation of rankings and mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall_at(ranked: DataFrame, ks: list[int]) -> DataFrame:
    """(k, recall): share of queries with a positive among the first k. ranked: query, place, label."""
    first = ranked.groupBy("query").agg(F.min(F.when(F.col("label") == 1, F.col("place"))).alias("first"))
    hits = first.agg(*[F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(str(k)) for k in ks])
    return hits.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{k}`").alias("recall")) for k in ks])))


def hard_negatives(scored: DataFrame, among: int = 20, keep: int = 8) -> DataFrame:
    """Of each query's best non-positives the first few. scored: query, id, score, label."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    top = scored.withColumn("place", place).where((F.col("place") <= among) & (F.col("label") == 0))
    return top.withColumn("turn", F.row_number().over(Window.partitionBy("query").orderBy("place"))).where(F.col("turn") <= keep).drop("turn")


def fuzzy_columns(predicted: Column, expected: Column) -> Column:
    """1 for equal sets of columns, .5 for the right tables, else a quarter of precision and recall together."""
    clean = lambda a: F.array_sort(F.transform(a, lambda c: F.lower(F.trim(c))))
    p, e = clean(predicted), clean(expected)
    tables = lambda a: F.array_sort(F.transform(F.filter(a, lambda c: F.contains(c, F.lit("."))), lambda c: F.split_part(c, F.lit("."), F.lit(1))))
    shared = F.size(F.array_intersect(p, e))
    part = (shared / F.greatest(F.size(F.array_distinct(p)), F.lit(1)) + shared / F.greatest(F.size(F.array_distinct(e)), F.lit(1))) / 4.0
    return F.when(p == e, 1.0).when((F.size(tables(p)) > 0) & (tables(p) == tables(e)), 0.5).otherwise(part)


def accuracy(cases: DataFrame, by: list[str]) -> DataFrame:
    """Column, transform and joint accuracy by groups, with subtotals. cases: columns_ok, transform_ok, and the groups."""
    share = lambda c: F.round(F.avg(c.cast("double")), 4)
    c, t = F.col("columns_ok"), F.col("transform_ok")
    return cases.rollup(*by).agg(F.count("*").alias("cases"), share(c).alias("column_accuracy"), share(t).alias("transform_accuracy"), share(c & t).alias("joint_accuracy"))


def rerank(scored: DataFrame, cross: str = "cross", bi: str = "bi", weight: float = 0.75) -> DataFrame:
    """Two scores brought to 0 to 1 within each query and blended."""
    w = Window.partitionBy("query")
    scaled = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w)), F.lit(0.0))
    blended = scored.withColumn("score", weight * scaled(cross) + (1 - weight) * scaled(bi))
    return blended.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "id")))
