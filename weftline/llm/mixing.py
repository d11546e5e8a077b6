"""Operator 2, mixing sources to target weights along a time-varying curriculum.

Targets: each source has a weight; together they share a multiple of all words, no source over max_repeats times its
own words, the excess reshared by weight. Since the shares rise together until a source is full, that is filling to a
level, found by one running sum over the sources in order of how soon they are full.

Curriculum: a source's weight over training time is piecewise linear. Its integral, scaled to the source's target, is
the cumulative demand for its words; a copy of a document that begins after so many words of its source is given the
time at which the demand reaches them, and documents are range-sorted by it.

Only DataFrame functions. A source may hold any share of the rows: running sums are taken inside short runs of the
order's hash, and the runs' totals are summed separately. Null texts have no words; null sources are one source, last
in order; repeated rows and ties are ordered alike each time; documents without words are never taken, and sources
without any words have target 0; an empty table gives an empty result. Columns of docs pass through; names beginning with _mix are the operator's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, held

#: Times of training and a source's weight there; more at the start, level, more at the end.
EARLY, LEVEL, LATE = ((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0))


@dataclass(frozen=True)
class Mix:
    """Weights and schedules repeat over the sources in order of code points, null last."""

    weights: tuple[int, ...] = (5, 2, 1)
    schedules: tuple[tuple[tuple[float, float], ...], ...] = (EARLY, LEVEL, LATE)
    #: Words taken in all, as numerator and denominator of a share of all words.
    total: tuple[int, int] = (3, 2)
    max_repeats: int = 2
    seed: str = "mix"
    #: Hexadecimal digits of the order's hash that name a run.
    run_digits: int = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """From (_mix_source, _mix_size): per source its order, weight, words and target in words."""
    by = sizes.groupBy("_mix_source").agg(F.sum("_mix_size").alias("source_size"))
    # one row a source from here on
    place = F.row_number().over(Window.orderBy(F.col("_mix_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("place") % len(mix.weights) + 1).cast("int")).cast("long")
    by = by.withColumn("place", place).withColumn("weight", weight)
    by = by.withColumn("cap", F.col("source_size") * mix.max_repeats)
    whole = Window.partitionBy()
    soon = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("place").asc())
    before = soon.rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.sum("source_size").over(whole) * F.lit(mix.total[0]) / F.lit(mix.total[1])
    filled = F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    by = by.withColumn("level", (wanted - filled) / left)
    by = by.withColumn("open", F.col("cap") / F.col("weight") > F.col("level"))
    level = F.max(F.when(F.col("open"), F.col("level"))).over(whole)
    target = F.when(F.col("open"), level * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return by.withColumn("target", target).select("_mix_source", "place", "weight", "source_size", "target")


def _time_of(schedule: tuple[tuple[float, float], ...], share: Column) -> Column:
    """The time at which a schedule's integral reaches a share of its whole: per piece, the root of a quadratic."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area = (w0 + w1) / 2 * (t1 - t0)
        pieces.append((t0, t1, w0, w1, total, total + area))
        total += area
    out = F.lit(schedule[-1][0])
    for t0, t1, w0, w1, low, high in reversed(pieces):
        need = share * total - low
        root = F.sqrt(F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / (t1 - t0)) * F.greatest(need, F.lit(0.0)))
        out = F.when(share * total < high, F.lit(t0) + F.lit(2.0) * need / (F.lit(w0) + root)).otherwise(out)
    return out


def planned(docs: DataFrame, mix: Mix = Mix(), size: Column | None = None, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with _mix: size, source_size, target, taken, position (of the first copy), copies (epoch, words, position).

    docs is read twice, so it should be stored or cheap.
    """
    size = n_words(F.col(f"`{text}`")) if size is None else size
    order = F.md5(F.concat(F.lit(mix.seed + ":"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null"))))
    rows = docs.withColumns({"_mix_size": size, "_mix_source": F.col(f"`{source}`"), "_mix_order": order})
    rows = rows.withColumn("_mix_run", F.substring("_mix_order", 1, mix.run_digits))
    # a key that is never null, for joins
    key = F.coalesce(F.concat(F.lit("="), F.col("_mix_source")), F.lit("null"))
    runs = held(rows.groupBy("_mix_source", "_mix_run").agg(F.sum("_mix_size").alias("_mix_size")))
    targets = source_targets(runs, mix)
    ahead = Window.partitionBy("_mix_source").orderBy("_mix_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_mix_base", F.coalesce(F.sum("_mix_size").over(ahead), F.lit(0)))
    runs = runs.withColumn("_mix_key", key).join(targets.withColumn("_mix_key", key).drop("_mix_source"), "_mix_key")
    runs = runs.select("_mix_key", "_mix_run", "_mix_base", "place", "source_size", "target")
    runs = runs.withColumnsRenamed({c: f"_mix_{c}" for c in ("place", "source_size", "target")})
    within = Window.partitionBy("_mix_key", "_mix_run").orderBy("_mix_order", F.col(f"`{doc_id}`"), "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_mix_key", key).join(runs, ["_mix_key", "_mix_run"])
    begin = F.col("_mix_base") + F.coalesce(F.sum("_mix_size").over(within), F.lit(0))
    rows = rows.withColumn("_mix_begin", begin)
    places = len(mix.schedules)

    def when(words: Column) -> Column:
        share, out = F.try_divide(words, F.col("_mix_target")), F.lit(None).cast("double")
        for i, schedule in enumerate(mix.schedules):
            out = F.when(F.col("_mix_place") % places == i, _time_of(schedule, share)).otherwise(out)
        return out

    copies = []
    for epoch in range(mix.max_repeats):
        at = F.col("_mix_begin") + F.col("_mix_source_size") * epoch
        words = F.greatest(F.lit(0), F.least(F.col("_mix_size"), F.floor("_mix_target") - at)).cast("long")
        copies.append(F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), when(at).alias("position")))
    rows = rows.withColumn("_mix_copies", F.filter(F.array(*copies), lambda c: c["words"] > 0))
    taken = F.aggregate("_mix_copies", F.lit(0).cast("long"), lambda total, c: total + c["words"])
    first = F.get("_mix_copies", F.lit(0))["position"]
    result = F.struct(
        F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"),
        taken.alias("taken"), first.alias("position"), F.col("_mix_copies").alias("copies"),
    )
    return rows.withColumn("_mix", result).select(*[F.col(f"`{c}`") for c in docs.columns], "_mix")


def mixed(docs: DataFrame, mix: Mix = Mix(), text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: a row for each copy taken, range-sorted by position, with docs' columns.

    A source's last copy is cut to the words that its target leaves.
    """
    copies = planned(docs, mix, None, text, doc_id, source).withColumn("_mix_copy", F.explode("_mix.copies"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("_mix_copy.words").cast("int")), "")
    cut = F.when(F.col("_mix_copy.words") < F.col("_mix.size"), head).otherwise(F.col(f"`{text}`"))
    copies = copies.withColumn(text, cut).orderBy("_mix_copy.position", F.col(f"`{doc_id}`"), "_mix_copy.epoch")
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])
