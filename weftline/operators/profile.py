"""Column profiles of whole tables, all columns at once.

Tables are turned into one long frame of cells (table, column, value); a single shuffle counts equal values. All else
is computed from these counts, so a value that fills a third of a column is one row, and percentiles weigh values by
their counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import normalize, parse_number
from ..plans.tables import cut

#: Most common values kept of each column.
MCV = 100
#: Share of values that must be numbers for a column to be numeric.
NUMERIC_SHARE = 0.97
QUANTILES = tuple(round(0.05 * i, 2) for i in range(1, 20))


def cells(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """(table, column, value): each cell as text. Unpivots in one scan of each table, reading the named columns only."""
    parts = []
    for name, df in sorted(tables.items()):
        wanted = (columns or {}).get(name, [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "binary"))])
        pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in wanted]
        parts.append(df.select(F.lit(name).alias("table"), F.inline(F.array(*pairs))))
    return reduce(DataFrame.unionAll, parts)


def value_counts(cells: DataFrame) -> DataFrame:
    """(table, column, value, number, n): normalised values with their counts; a null value counts the nulls."""
    counted = cells.groupBy("table", "column", normalize(F.col("value")).alias("value")).agg(F.count("*").alias("n"))
    return counted.withColumn("number", parse_number(F.col("value")))


#: Types whose text can only be one value's; int types count together. Other types are counted as text.
PLAIN = ("bigint", "double", "boolean", "date", "timestamp", "timestamp_ntz", "decimal")


def counted(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """value_counts(cells(tables, columns)) for large tables: cells are counted as they are stored, all columns of a type
    at once, so that only distinct values become text and are normalised."""
    names: list[tuple[str, str]] = []
    by: dict[str, list[DataFrame]] = {}
    for name, df in sorted(tables.items()):
        wanted = (columns or {}).get(name, [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "binary"))])
        own: dict[str, list[str]] = {}
        for c, (_, kind) in zip(wanted, df.select(*[F.col(f"`{c}`") for c in wanted]).dtypes):
            kind = "bigint" if kind in ("tinyint", "smallint", "int") else kind
            own.setdefault(kind if kind.startswith(PLAIN) else "string", []).append(c)
        for kind, each in own.items():
            values = F.posexplode(F.array(*[F.col(f"`{c}`").cast(kind) for c in each])).alias("at", "raw")
            by.setdefault(kind, []).append(df.select(values).select((F.col("at") + len(names)).alias("at"), "raw"))
            names += [(name, c) for c in each]
    raw, n = F.col("raw"), F.sum("n").alias("n")
    parts = []
    for kind, frames in by.items():
        every = reduce(DataFrame.unionAll, frames)
        if kind == "double":
            # grouping takes -0.0 for 0.0, which are two texts; NaN is a null word
            every = every.select("at", F.when(~F.isnan(raw), raw).alias("raw"), F.coalesce((raw == 0) & (raw.cast("string") == "-0.0"), F.lit(False)).alias("minus"))
            every = every.groupBy("at", "raw", "minus").agg(F.count("*").alias("n")).withColumn("raw", F.when(F.col("minus"), F.lit(-0.0)).otherwise(raw))
            every = every.select("at", F.lower(raw.cast("string")).alias("value"), "n", F.when(F.abs(raw) < float("inf"), raw).alias("number"))
        else:
            every = every.groupBy("at", "raw").agg(F.count("*").alias("n"))
            if kind == "bigint":
                every = every.select("at", raw.cast("string").alias("value"), "n", raw.cast("double").alias("number"))
            else:
                every = every.select("at", normalize(raw.cast("string")).alias("value"), "n")
                every = every.groupBy("at", "value").agg(n) if kind == "string" else every
                every = every.withColumn("number", parse_number(F.col("value")))
        parts.append(every)
    told = [F.get(F.array(*[F.lit(x[i]) for x in names]), F.col("at")).alias(c) for i, c in enumerate(("table", "column"))]
    return reduce(DataFrame.unionByName, parts).select(*told, "value", "n", "number")


def quantiles(numbers: DataFrame, shares: list[float]) -> DataFrame:
    """(table, column, quantiles): exact interpolated quantiles of numbers (table, column, number, n), distinct rows.

    Numbers are range-partitioned, so no task holds a column: ranks are running sums within a part of a column, on top
    of the sums of the parts before, and only the parts that hold a quantile's rank are searched for it.
    """
    key = ["table", "column"]
    parts = cut(numbers.repartitionByRange(*key, "number").withColumn("part", F.spark_partition_id()), "numbers")
    sums = parts.groupBy(*key, "part").agg(F.sum("n").alias("held"))
    ahead = Window.partitionBy(*key).orderBy("part")
    sums = sums.withColumns({"upto": F.sum("held").over(ahead), "of": F.sum("held").over(Window.partitionBy(*key))})
    positions = F.array(*[F.lit(float(q)) for q in shares])
    asked = sums.select(*key, "part", (F.col("upto") - F.col("held")).alias("base"), "upto", "of", F.posexplode(positions).alias("place", "share"))
    at = F.col("share") * (F.col("of") - 1)
    ends = F.explode(F.array(*[F.struct(F.lit(e).alias("end"), f(at).cast("long").alias("rank")) for e, f in (("low", F.floor), ("high", F.ceil))]))
    asked = asked.withColumn("at", at).select("*", ends.alias("e")).select(*key, "part", "base", "upto", "place", "at", "e.*").where("rank >= base and rank < upto")
    asked = cut(asked.drop("upto"), "ranks")
    running = F.sum("n").over(Window.partitionBy(*key, "part").orderBy("number"))
    ranked = parts.withColumn("running", running).join(asked, [*key, "part"])
    found = ranked.where("rank >= base + running - n and rank < base + running")
    value = lambda e: F.max(F.when(F.col("end") == e, F.col("number")))
    found = found.groupBy(*key, "place").agg(value("low").alias("low"), value("high").alias("high"), F.max("at").alias("at"))
    one = F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))
    found = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", one.alias("value")))).alias("each"))
    return found.select(*key, F.col("each.value").alias("quantiles"))


def profiles(counts: DataFrame) -> DataFrame:
    """One row per column. Ratios of a column without valid values are 0; entropy is 0 for numeric columns."""
    valid = F.col("value").isNotNull()
    key = ["table", "column"]
    totals = counts.groupBy(*key).agg(
        F.sum("n").alias("total_rows"), F.coalesce(F.sum(F.when(valid, F.col("n"))), F.lit(0)).alias("valid_count"),
        F.coalesce(F.sum(F.when(F.col("number").isNotNull(), F.col("n"))), F.lit(0)).alias("numbers"),
    )
    # one row a column: as small as the catalog, which the planner sees from its size
    kind = F.when(F.col("valid_count") == 0, "unknown").when(F.col("numbers") >= NUMERIC_SHARE * F.col("valid_count"), "numeric").otherwise("categorical")
    totals = cut(totals.withColumn("kind", kind), "totals")
    joined = counts.where(valid).join(totals.select(*key, "valid_count", "kind"), key)
    share = F.col("n") / F.col("valid_count")
    numeric = F.when(F.col("kind") == "numeric", F.col("number"))
    length = F.when(F.col("kind") == "categorical", F.char_length("value").cast("double"))
    detail = joined.groupBy(*key).agg(
        F.count("*").alias("n_values"), F.when(F.first("kind") == "numeric", 0.0).otherwise(-F.sum(share * F.ln(share + 1e-12))).alias("entropy"),
        F.min(numeric).alias("min"), F.max(numeric).alias("max"),
        (F.sum(length * F.col("n")) / F.sum(F.when(length.isNotNull(), F.col("n")))).alias("avg_len"),
        (F.sum(length * length * F.col("n")) / F.sum(F.when(length.isNotNull(), F.col("n")))).alias("_len2"),
        (F.sum(F.when(numeric == F.floor(numeric), F.col("n"))) / F.sum(F.when(numeric.isNotNull(), F.col("n")))).alias("integer_ratio"),
    )
    numbers = cut(joined.where("kind = 'numeric' and number is not null").groupBy(*key, "number").agg(F.sum("n").alias("n")), "numbers")
    inner = (0.01, 0.25, 0.75, 0.99)
    ranks = cut(quantiles(numbers, [*QUANTILES, *inner]), "quantiles")
    of = lambda q: F.col("quantiles")[len(QUANTILES) + inner.index(q)]
    reach = 1.5 * (of(0.75) - of(0.25))
    beyond = numbers.join(ranks.select(*key, (of(0.25) - reach).alias("_low"), (of(0.75) + reach).alias("_high")), key).groupBy(*key).agg(
        F.count("*").alias("n_numbers"), F.sum(F.when((F.col("number") < F.col("_low")) | (F.col("number") > F.col("_high")), F.col("n")).otherwise(0)).alias("_out")
    )
    out = totals.join(detail, key, "left").join(beyond, key, "left").join(ranks, key, "left")
    many = F.col("numbers") >= 10
    distinct = F.when(F.col("kind") == "numeric", F.col("n_numbers")).otherwise(F.col("n_values"))
    out = out.withColumns({"n_distinct": F.coalesce(distinct, F.lit(0)), "inner": F.slice("quantiles", len(QUANTILES) + 1, len(inner)), "quantiles": F.slice("quantiles", 1, len(QUANTILES))})
    return out.select(
        *key, "total_rows", "valid_count", F.try_divide(F.col("total_rows") - F.col("valid_count"), "total_rows").alias("null_frac"), "kind",
        "n_distinct", F.coalesce(F.try_divide("n_distinct", "valid_count"), F.lit(0.0)).alias("distinct_ratio"),
        F.coalesce("entropy", F.lit(0.0)).alias("entropy"), "min", "max", F.coalesce("avg_len", F.lit(0.0)).alias("avg_len"),
        F.coalesce(F.sqrt(F.greatest(F.col("_len2") - F.col("avg_len") * F.col("avg_len"), F.lit(0.0))), F.lit(0.0)).alias("std_len"),
        F.coalesce("integer_ratio", F.lit(0.0)).alias("integer_ratio"), F.when(many, F.coalesce(F.try_divide("_out", "valid_count"), F.lit(0.0))).otherwise(0.0).alias("outlier_ratio"),
        F.get("quantiles", F.lit(0)).alias("q05"), F.get("quantiles", F.lit(9)).alias("q50"), F.get("quantiles", F.lit(18)).alias("q95"),
        "quantiles", F.get("inner", F.lit(0)).alias("q01"), F.get("inner", F.lit(3)).alias("q99"),
    )


def monotonic(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Share of steps that go up or down, whichever is more, in the order of columns; 0 below five values.

    Rows are partitioned by ranges of the order, so no task holds the frame: steps are taken within a part, and from the
    last value of each part to the first of the next.
    """
    x = df.select(parse_number(F.col(column).cast("string")).alias("x"), *order).where("x is not null")
    parts = cut(x.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ordered")
    inner = parts.select((F.col("x") - F.lag("x").over(Window.partitionBy("part").orderBy(*order))).alias("step"))
    ends = parts.groupBy("part").agg(F.min_by("x", F.struct(*order)).alias("first"), F.max_by("x", F.struct(*order)).alias("last"))
    # one row a part
    outer = ends.select((F.col("first") - F.lag("last").over(Window.orderBy("part"))).alias("step"))
    up, down = (F.sum(F.when(c, 1).otherwise(0)) for c in (F.col("step") >= 0, F.col("step") <= 0))
    told = inner.union(outer.where("step is not null")).agg(F.count("step").alias("steps"), F.greatest(up, down).alias("one_way"))
    return told.select(F.when(F.col("steps") >= 4, F.col("one_way") / F.col("steps")).otherwise(0.0).alias("monotonic"))


def most_common(counts: DataFrame, k: int = MCV) -> DataFrame:
    """(table, column, value, n, frequency, place): the k most common values of each column, ties by value.

    The window is limited by rank, which Spark also applies before the shuffle, so a task gets few rows of a column.
    """
    valid = counts.where("value is not null")
    totals = valid.groupBy("table", "column").agg(F.sum("n").alias("of"))
    place = F.row_number().over(Window.partitionBy("table", "column").orderBy(F.desc("n"), "value"))
    top = valid.withColumn("place", place).where(F.col("place") <= k)
    return top.join(totals, ["table", "column"]).select("table", "column", "value", "n", (F.col("n") / F.col("of")).alias("frequency"), "place")


def histogram(counts: DataFrame, bins: int = 20) -> DataFrame:
    """(table, column, bin, n): equal bins between each numeric column's ends, the last closed."""
    numbers = counts.where("number is not null")
    ends = numbers.groupBy("table", "column").agg(F.min("number").alias("low"), F.max("number").alias("high"))
    place = F.least(F.floor(F.try_divide((F.col("number") - F.col("low")) * bins, F.col("high") - F.col("low"))), F.lit(bins - 1))
    return numbers.join(ends, ["table", "column"]).groupBy("table", "column", F.coalesce(place, F.lit(0)).cast("int").alias("bin")).agg(F.sum("n").alias("n"))
