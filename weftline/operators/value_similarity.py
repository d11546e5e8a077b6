"""Value similarity of column pairs: eight categorical and eleven numeric signals and their weighted score.

Values meet as sets of the columns that have them, never by a product of values; numeric columns meet in bins of the
pair's shared range. All pairs of a batch are scored in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut
from .profile import most_common

KEY = ["lt", "lc", "rt", "rc"]
BINS = 40
#: Cells in which a column's numbers are counted before they are binned for each pair; it bears on cost alone.
CELLS = 1 << 14
FLOOR = 0.03


def column_pairs(profiles: DataFrame) -> DataFrame:
    """Pairs of columns of different tables, in order of table names, of the same kind: an equi-join on the kind."""
    side = profiles.where("kind != 'unknown'").select("table", "column", "kind")
    left = side.select(F.col("table").alias("lt"), F.col("column").alias("lc"), "kind")
    right = side.select(F.col("table").alias("rt"), F.col("column").alias("rc"), "kind")
    return left.join(right, "kind").where("lt < rt").select(*KEY)


def _of(counts: DataFrame, side: str, **renamed: str) -> DataFrame:
    return counts.select(F.col("table").alias(side + "t"), F.col("column").alias(side + "c"), *[F.col(v).alias(k) for k, v in renamed.items()])


def shared_values(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, shared): how many distinct values, or numbers to six decimals, both columns have.

    Each value is one row with the set of the columns that have it, as bits; equal sets are counted, and only these few
    sets are turned into pairs of columns.
    """
    sides = [pairs.select(F.col(s + "t").alias("table"), F.col(s + "c").alias("column")) for s in "lr"]
    names = sorted(tuple(r) for r in sides[0].union(sides[1]).distinct().collect())
    if not names:
        return pairs.select(*KEY, F.lit(0).cast("long").alias("shared")).limit(0)
    spark = counts.sparkSession
    frame = spark.createDataFrame([(*x, i, i // 63, 1 << i % 63) for i, x in enumerate(names)], "table string, column string, at int, word int, bit long")
    values = counts.where("value is not null").join(F.broadcast(frame), ["table", "column"])
    whole = F.col("number") == F.floor("number")
    number = F.when(F.col("number").isNotNull(), F.when(whole, F.col("number")).otherwise(F.round("number", 6)))
    values = values.select("word", "bit", number.alias("x"), F.when(F.col("number").isNull(), F.col("value")).alias("v"))
    words = [f"w{i}" for i in range(len(names) // 63 + 1)]
    sets = values.groupBy("x", "v").agg(*[F.bit_or(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0))).alias(w) for i, w in enumerate(words)])
    sets = sets.groupBy(*words).agg(F.count("*").alias("n"))
    have = F.array_compact(F.array(*[F.when(F.col(words[i // 63]).bitwiseAND(F.lit(1 << i % 63)) != 0, F.lit(i)) for i in range(len(names))]))
    met = sets.select("n", have.alias("have")).select("n", "have", F.explode("have").alias("l")).select("n", "l", F.explode("have").alias("r"))
    met = met.groupBy("l", "r").agg(F.sum("n").alias("shared"))
    for s in "lr":
        met = met.join(F.broadcast(frame.select(F.col("at").alias(s), F.col("table").alias(s + "t"), F.col("column").alias(s + "c"))), s)
    return met.join(pairs.select(*KEY), KEY).select(*KEY, "shared")


def _frequencies(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, dot, low, high): sums over most common values of products, minima and maxima of frequencies."""
    columns = [pairs.select(F.col(s + "t").alias("table"), F.col(s + "c").alias("column")) for s in "lr"]
    top = most_common(counts.join(columns[0].union(columns[1]).distinct(), ["table", "column"], "left_semi"))
    norms = top.groupBy("table", "column").agg(F.sqrt(F.sum(F.col("frequency") ** 2)).alias("norm"), F.sum("frequency").alias("mass"))
    met = _of(top, "l", v="value", lf="frequency").join(_of(top, "r", v="value", rf="frequency"), "v").join(pairs, KEY)
    met = met.groupBy(*KEY).agg(F.sum(F.col("lf") * F.col("rf")).alias("dot"), F.sum(F.least("lf", "rf")).alias("low"))
    both = met.join(_of(norms, "l", ln="norm", lm="mass"), ["lt", "lc"]).join(_of(norms, "r", rn="norm", rm="mass"), ["rt", "rc"])
    # the larger of two frequencies sums to both masses less the smaller
    return both.select(*KEY, F.try_divide("dot", F.col("ln") * F.col("rn")).alias("mcv_cos"), F.try_divide("low", F.col("lm") + F.col("rm") - F.col("low")).alias("weighted_jacc"))


def _histograms(counts: DataFrame, numeric: DataFrame) -> DataFrame:
    """(pair, hist): intersection of 40-bin histograms over the range of both columns' inner quantiles.

    Each column's numbers are counted once, in CELLS narrow cells with their least and greatest number. A cell whose ends
    fall into one bin of a pair lies in that bin, as bins are in order of numbers; the numbers of other cells, which hold
    a bin's border, are binned one by one.
    """
    low, high = F.least("l_q01", "r_q01"), F.greatest("l_q99", "r_q99")
    ranged = numeric.select(*KEY, low.alias("low"), high.alias("high"))
    spans = [numeric.select(F.col(s + "t").alias("table"), F.col(s + "c").alias("column"), F.col(s + "_min").alias("least"), F.col(s + "_max").alias("most")) for s in "lr"]
    numbers = counts.where("number is not null").join(F.broadcast(spans[0].union(spans[1]).distinct()), ["table", "column"])
    cell = F.coalesce(F.floor(F.try_divide((F.col("number") - F.col("least")) * CELLS, F.col("most") - F.col("least"))), F.lit(0))
    numbers = numbers.select("table", "column", "number", "n", cell.alias("cell"))
    cells = cut(numbers.groupBy("table", "column", "cell").agg(F.min("number").alias("first"), F.max("number").alias("last"), F.sum("n").alias("n")), "cells")

    def place(x: str) -> Column:
        inside = F.greatest(F.least(x, "high"), F.col("low"))
        return F.coalesce(F.least(F.floor(F.try_divide((inside - F.col("low")) * BINS, F.col("high") - F.col("low"))), F.lit(BINS - 1)), F.lit(0))

    sides = []
    for side in ("l", "r"):
        own = [side + "t", side + "c"]
        met = ranged.join(_of(cells, side, cell="cell", first="first", last="last", n="n"), own).select(*KEY, "low", "high", "cell", "n", place("first").alias("bin"), place("last").alias("other"))
        inner = met.where("bin = other").select(*KEY, "bin", "n")
        border = met.where("bin != other").select(*KEY, "low", "high", "cell").join(_of(numbers, side, x="number", n="n", cell="cell"), [*own, "cell"])
        sides.append(inner.union(border.select(*KEY, place("x").alias("bin"), "n")).groupBy(*KEY, "bin").agg(F.sum("n").alias(side + "_n")))
    totals = [s.groupBy(*KEY).agg(F.sum(side + "_n").alias(side + "_all")) for s, side in zip(sides, "lr")]
    met = sides[0].join(sides[1], [*KEY, "bin"]).join(totals[0], KEY).join(totals[1], KEY)
    return met.groupBy(*KEY).agg(F.sum(F.least(F.col("l_n") / F.col("l_all"), F.col("r_n") / F.col("r_all"))).alias("hist"))


def _close(a: Column, b: Column) -> Column:
    return 1 - F.abs(a - b)


def similarity(counts: DataFrame, profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with every signal and value_score, 0 to 1 in four decimals; pairs of different kinds score 0."""
    fields = ("kind", "valid_count", "null_frac", "n_distinct", "entropy", "min", "max", "avg_len", "std_len", "integer_ratio", "outlier_ratio", "quantiles", "q05", "q50", "q95", "q01", "q99")
    joined = pairs
    for side in ("l", "r"):
        joined = joined.join(_of(profiles, side, **{f"{side}_{f}": f for f in fields}), [side + "t", side + "c"])
    joined = cut(joined, "sides")
    same = joined.where("l_kind = r_kind and l_kind != 'unknown'")
    met = shared_values(counts, same.select(*KEY))
    met = cut(met, "shared")
    freq = _frequencies(counts, same.where("l_kind = 'categorical'").select(*KEY))
    hist = _histograms(counts, same.where("l_kind = 'numeric'"))
    freq, hist = cut(freq, "frequencies"), cut(hist, "histograms")
    joined = joined.join(met, KEY, "left").join(freq, KEY, "left").join(hist, KEY, "left")
    zero = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))
    l, r = (lambda f: F.col("l_" + f)), (lambda f: F.col("r_" + f))
    joined = joined.withColumns({
        "contain": zero(F.try_divide("shared", F.least(l("n_distinct"), r("n_distinct")))),
        "jacc": zero(F.try_divide("shared", l("n_distinct") + r("n_distinct") - zero("shared"))),
        "mcv_cos": zero("mcv_cos"), "weighted_jacc": zero("weighted_jacc"),
    })
    logs = [F.ln(F.greatest(F.lit(2), x("n_distinct"))) for x in (l, r)]
    distinct = 1 - F.abs(logs[0] - logs[1]) / F.greatest(*logs)
    entropy = F.greatest(F.lit(0.0), 1 - F.abs(l("entropy") - r("entropy")) / F.greatest(l("entropy"), r("entropy"), F.lit(1e-9)))
    gap = lambda f: F.abs(l(f) - r(f)) / F.greatest(l(f), r(f), F.lit(1e-9))
    lengths = F.when((l("avg_len") == 0) & (r("avg_len") == 0), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - 0.7 * gap("avg_len") - 0.3 * gap("std_len")))
    spans = [x("max") - x("min") for x in (l, r)]
    overlap = F.least(l("max"), r("max")) - F.greatest(l("min"), r("min"))
    narrow = F.least(*spans)
    ranges = F.when(overlap < 0, 0.0).when(narrow == 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(overlap, narrow)))
    spread = F.greatest(l("q95") - l("q05"), r("q95") - r("q05"), F.abs(l("q50") - r("q50")), F.lit(1e-9))
    away = F.aggregate(F.zip_with(l("quantiles"), r("quantiles"), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 19
    cdf = F.when(F.least(l("valid_count"), r("valid_count")) < 5, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - away / spread))
    ratio = F.greatest(*spans) / narrow
    scale = F.when(narrow <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.log10(ratio) / 3))
    enough = F.least(l("valid_count"), r("valid_count")) >= 2
    degenerate = F.greatest(l("q99"), r("q99")) <= F.least(l("q01"), r("q01"))
    signals = {
        "n_distinct_sim": distinct, "null_sim": _close(l("null_frac"), r("null_frac")), "entropy_sim": entropy, "len_profile": lengths,
        "hist": F.when(~enough, 0.0).when(degenerate, 1.0).otherwise(zero("hist")), "cdf": zero(cdf), "range_sim": zero(ranges),
        "int_sim": _close(l("integer_ratio"), r("integer_ratio")), "outlier_sim": _close(l("outlier_ratio"), r("outlier_ratio")), "scale_sim": zero(scale),
    }
    joined = joined.withColumns(signals)
    c = F.col
    weak = 0.08 * (0.5 * c("n_distinct_sim") + 0.5 * c("null_sim"))
    ev = F.greatest("mcv_cos", "weighted_jacc", "contain", "jacc")
    words = F.when(ev < FLOOR, weak).otherwise(
        0.36 * ev + 0.16 * c("mcv_cos") + 0.14 * c("weighted_jacc") + 0.10 * c("contain") + 0.08 * c("jacc") + 0.07 * c("n_distinct_sim")
        + 0.04 * c("null_sim") + 0.03 * c("entropy_sim") + 0.02 * c("len_profile"))
    ev = F.greatest("hist", "cdf", "contain", 0.6 * c("hist") + 0.4 * c("cdf"))
    # order within a column has no meaning in a distributed table, so both columns count as equally monotonic
    numbers = F.when(ev < FLOOR, weak).otherwise(
        0.32 * ev + 0.16 * c("hist") + 0.12 * c("cdf") + 0.10 * c("contain") + 0.08 * c("range_sim") + 0.08 * c("n_distinct_sim")
        + 0.05 * c("null_sim") + 0.03 * c("int_sim") + 0.02 + 0.02 * c("outlier_sim") + 0.02 * c("scale_sim"))
    raw = F.when((l("valid_count") == 0) | (r("valid_count") == 0) | (l("kind") != r("kind")) | (l("kind") == "unknown"), 0.0).when(l("kind") == "numeric", numbers).otherwise(words)
    reason = F.when((l("valid_count") == 0) | (r("valid_count") == 0), "empty").when((l("kind") == "unknown") | (r("kind") == "unknown"), "unknown_type").when(l("kind") != r("kind"), "type_mismatch")
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)
    return joined.select(*KEY, score.alias("value_score"), reason.alias("reason"), "contain", "jacc", "mcv_cos", "weighted_jacc", *signals)
