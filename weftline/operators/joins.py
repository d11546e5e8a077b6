"""Join discovery: single and composite edges between tables, with confidence, cardinality and direction.

Cheap gates come before dear scores: joinable columns, types, values, constraints, names. The frames of pairs are as
small as the catalog; only value counts and tuple counts grow with the data, and they are joined by value.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import normalize_join, type_score
from ..plans.tables import cut
from .constraints import constraint_score
from .names import join_name_score
from .profile import counted, profiles
from .value_similarity import KEY, similarity

#: Rows (a combination and a hash) of all sketches that may be broadcast, some 10 MB; more are joined by a shuffle.
SAMPLE_ROWS = 500_000

EDGE = "left_table string, left_cols array<string>, right_table string, right_cols array<string>, cardinality string, direction string, confidence double, reasons array<string>, kind string"


@dataclass(frozen=True)
class Limits:
    min_single: float = 0.58
    min_composite: float = 0.72
    top_singles: int = 5
    top_composites: int = 3
    singles_per_pair: int = 80
    pairs_for_composites: int = 24
    composites_per_pair: int = 9
    unique: float = 0.98
    #: Distinct tuples that a sketch of a combination draws.
    sketch: int = 1024
    #: Accept columns without values and score them by names, types and constraints alone.
    metadata_only: bool = False


def joinable(p: DataFrame, limits: Limits = Limits()) -> DataFrame:
    keep = (F.col("valid_count") > 0) & (F.col("null_frac") <= 0.95) & ~((F.col("n_distinct") <= 1) & (F.col("valid_count") > 20))
    return p.where(keep | F.lit(limits.metadata_only))


def cardinality(left: Column, right: Column, unique: float = 0.98) -> Column:
    l, r = left >= unique, right >= unique
    return F.when(l & r, "1:1").when(l, "1:N").when(r, "N:1").otherwise("N:M")


def direction(left_parent: Column, right_parent: Column, left: Column, right: Column, unique: float = 0.98) -> Column:
    l, r = left >= unique, right >= unique
    return F.when(left_parent & ~right_parent, "left_parent").when(right_parent & ~left_parent, "right_parent").when(l & ~r, "left_parent").when(r & ~l, "right_parent").otherwise("undirected")


def scored_pairs(columns: DataFrame, counts: DataFrame, profile: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Single-column pairs above the threshold, at most singles_per_pair of each pair of tables."""
    usable = joinable(profile, limits).select("table", "column", "total_rows", "distinct_ratio")
    every = columns.join(usable, ["table", "column"]).select("table", "column", "type", "total_rows", "distinct_ratio", F.struct(*columns.columns).alias("meta"))
    side = lambda s: every.select(*[F.col(c).alias(s + c) for c in every.columns])
    # the catalog's own product: columns of a few tables, not rows
    pairs = side("l_").join(side("r_"), F.col("l_table") < F.col("r_table"))
    pairs = pairs.withColumn("type_score", type_score(F.col("l_type"), F.col("r_type"))).where("type_score >= 0.20")
    pairs = pairs.withColumnsRenamed({"l_table": "lt", "l_column": "lc", "r_table": "rt", "r_column": "rc"})
    pairs = cut(pairs, "typed-pairs")
    valued = cut(similarity(counts, profile, pairs.select(*KEY)).select(*KEY, "value_score"), "values")
    pairs = pairs.join(valued, KEY, "left").withColumn("value_score", F.coalesce("value_score", F.lit(0.0)))
    keyed = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"{s}.{f}"), F.lit(False)) for s in ("l_meta", "r_meta") for f in ("is_pk", "is_fk")])
    pairs = pairs.where((F.col("value_score") >= 0.08) | keyed)
    score, reasons = constraint_score("l_meta", "r_meta")
    pairs = cut(pairs.withColumn("constraint_score", score).withColumn("reasons", reasons), "constraints").where("constraint_score > 0")
    pairs = pairs.withColumn("name_score", join_name_score(F.col("lc"), F.col("rc")))
    raw = 0.30 * F.col("name_score") + 0.36 * F.col("value_score") + 0.14 * F.col("type_score") + 0.20 * F.col("constraint_score")
    related = F.array_contains("reasons", "pk_fk_relation")
    raw = F.when(related & (F.col("value_score") > 0.20), F.greatest(raw, F.lit(0.90))).otherwise(raw)
    logs = F.least(*[F.ln(F.greatest(F.lit(2), F.col(s + "_total_rows"))) for s in "lr"])
    damped = raw * F.least(F.lit(1.0), 0.72 + logs / 10)
    pairs = pairs.withColumn("confidence", F.round(damped, 4)).where(F.col("confidence") >= limits.min_single)
    place = F.row_number().over(Window.partitionBy("lt", "rt").orderBy(F.desc("confidence"), "lc", "rc"))
    return pairs.withColumn("place", place).where(F.col("place") <= limits.singles_per_pair)


def single_edges(pairs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    flag = lambda s, f: F.coalesce(F.col(f"{s}_meta.{f}"), F.lit(False))
    lu, ru = F.col("l_distinct_ratio"), F.col("r_distinct_ratio")
    turned = direction(flag("l", "is_pk") & flag("r", "is_fk"), flag("r", "is_pk") & flag("l", "is_fk"), lu, ru, limits.unique)
    edges = pairs.select(
        F.col("lt").alias("left_table"), F.array("lc").alias("left_cols"), F.col("rt").alias("right_table"), F.array("rc").alias("right_cols"),
        cardinality(lu, ru, limits.unique).alias("cardinality"), turned.alias("direction"), "confidence", "reasons", F.lit("single").alias("kind"),
        flag("l", "is_pk").alias("l_pk"), flag("r", "is_pk").alias("r_pk"))
    return sibling_penalty(cut(edges, "singles")).drop("l_pk", "r_pk")


def sibling_penalty(edges: DataFrame) -> DataFrame:
    """Two columns that both point to one primary key are weak as a join of each other: times .80, unless declared."""
    ends = edges.where("r_pk").select(F.struct("left_table", F.col("left_cols")[0].alias("c")).alias("own"), F.struct("right_table", F.col("right_cols")[0].alias("c")).alias("pk"))
    other = edges.where("l_pk").select(F.struct(F.col("right_table").alias("left_table"), F.col("right_cols")[0].alias("c")).alias("own"), F.struct(F.col("left_table").alias("right_table"), F.col("left_cols")[0].alias("c")).alias("pk"))
    points = ends.union(other).groupBy("own").agg(F.collect_set("pk").alias("targets"))
    left, right = points.select(F.col("own").alias("lo"), F.col("targets").alias("lp")), points.select(F.col("own").alias("ro"), F.col("targets").alias("rp"))
    both = edges.withColumn("lo", F.struct("left_table", F.col("left_cols")[0].alias("c"))).withColumn("ro", F.struct(F.col("right_table").alias("left_table"), F.col("right_cols")[0].alias("c")))
    both = both.join(left, "lo", "left").join(right, "ro", "left")
    clash = F.coalesce(F.arrays_overlap("lp", "rp"), F.lit(False)) & ~F.array_contains("reasons", "pk_fk_relation")
    both = both.withColumn("confidence", F.when(clash, F.round(F.col("confidence") * 0.80, 4)).otherwise(F.col("confidence")))
    return both.withColumn("reasons", F.when(clash, F.array_append("reasons", F.lit("sibling_fk_collision"))).otherwise(F.col("reasons"))).drop("lo", "ro", "lp", "rp")


def _each(df: DataFrame, lists: list[dict], cell: Callable[[Column], Column]) -> tuple[DataFrame, list[Column], list[Column]]:
    """df's rows once for each list of columns: the list's own fields, without cells; its cells, null where a cell is or
    beyond the list's end; and whether the list ends before each of these. One scan.

    lists: number, columns, other fields. The lists are a table of places that each row meets, so that what follows is
    compiled once, however many there are.
    """
    names = sorted({c for each in lists for c in each["columns"]})
    place = {c: i for i, c in enumerate(names)}
    width = max(len(each["columns"]) for each in lists)
    told = [{**each, "columns": None} | {f"at{i}": place[c] for i, c in enumerate(each["columns"])} for each in lists]
    fields = ", ".join(["number int", "limit bigint", *[f"at{i} int" for i in range(width)]])
    every = F.from_json(F.lit(json.dumps(told)), f"array<struct<{fields}>>")
    rows = df.select(F.array(*[cell(normalize_join(F.col(f"`{c}`").cast("string"))) for c in names]).alias("cells")).select("cells", F.inline(every))
    return rows, [F.get("cells", F.col(f"at{i}")) for i in range(width)], [F.col(f"at{i}").isNull() for i in range(width)]


def tuples(df: DataFrame, combos: list[tuple[int, list[str]]]) -> DataFrame:
    """(combo, key, n): a row, n being 1, for each row of df and combination of columns of which no part is null."""
    rows, cells, ends = _each(df, [{"number": number, "columns": each} for number, each in combos], lambda v: v)
    # each part with its length before it: unlike tuples are unlike keys
    parts = [F.when(end, "").otherwise(F.concat(F.char_length(v), F.lit(":"), v)) for v, end in zip(cells, ends)]
    return rows.select(F.col("number").alias("combo"), F.concat(*parts).alias("key"), F.lit(1).cast("long").alias("n")).where("key is not null")


def tuple_counts(df: DataFrame, combos: list[tuple[int, list[str]]]) -> DataFrame:
    """(combo, key, n): equal tuples of each combination of columns, in one scan and one shuffle; no part may be null."""
    return tuples(df, combos).groupBy("combo", "key").agg(F.sum("n").alias("n"))


def tuple_metrics(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per combination that shares a tuple: containment, Jaccard, Jaccard of bags and both sides' uniqueness.

    A key may have several rows, which add up. Both sides are counted in one shuffle.
    """
    side = lambda d, l, r: d.select("combo", "key", (F.col("n") * l).alias("ln"), (F.col("n") * r).alias("rn"))
    both = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy("combo", "key").agg(F.sum("ln").alias("ln"), F.sum("rn").alias("rn"))
    every = both.groupBy("combo").agg(
        F.count_if(F.expr("ln > 0 and rn > 0")).alias("shared"), F.sum(F.least("ln", "rn")).alias("low"),
        F.count_if(F.col("ln") > 0).alias("ld"), F.count_if(F.col("rn") > 0).alias("rd"), F.sum("ln").alias("lall"), F.sum("rn").alias("rall")).where("shared > 0")
    return every.select(
        "combo", (F.col("shared") / F.least("ld", "rd")).alias("contain"), (F.col("shared") / (F.col("ld") + F.col("rd") - F.col("shared"))).alias("jacc"),
        (F.col("low") / (F.col("lall") + F.col("rall") - F.col("low"))).alias("freq"), (F.col("ld") / F.col("lall")).alias("lu"), (F.col("rd") / F.col("rall")).alias("ru"))


@dataclass(frozen=True)
class Combination:
    """Two or three column pairs of two tables, tried together as one join key."""

    number: int
    left: tuple[str, tuple[str, ...]]
    right: tuple[str, tuple[str, ...]]
    #: Means of the pairs' confidence, type and constraint scores.
    pair: float
    kind: float
    constraint: float
    left_parent: bool
    right_parent: bool


def combinations_of(found: list, size: int, first: int, alive: set[frozenset] | None = None) -> list[Combination]:
    """All sets of size pairs of one pair of tables that repeat no column; of three, those whose parts of two are alive."""
    out = []
    for c in combinations(found, size):
        if len({x.lc for x in c}) < size or len({x.rc for x in c}) < size:
            continue
        if alive is not None and not all(frozenset((x.lc, x.rc) for x in part) in alive for part in combinations(c, size - 1)):
            continue
        mean = lambda f: sum(getattr(x, f) for x in c) / size
        out.append(Combination(
            first + len(out), (c[0].lt, tuple(x.lc for x in c)), (c[0].rt, tuple(x.rc for x in c)), mean("confidence"), mean("type_score"), mean("constraint_score"),
            all(x.lis_pk or x.lis_unique for x in c) and any(x.ris_fk for x in c), all(x.ris_pk or x.ris_unique for x in c) and any(x.lis_fk for x in c)))
    return out


def tuple_hashes(df: DataFrame, lists: list[tuple[int, tuple[str, ...], float]]) -> DataFrame:
    """(list, hash) of each row's tuple of each list of columns, of those hashes that fall below the list's share of all.

    lists: number, columns, share. One scan: a row's cells are hashed once, and tuples are mixed from the cells' hashes.
    A share below 1 keeps the same tuples in every table, so that samples can be compared.
    """
    told = [{"number": n, "columns": columns, "limit": min(2**53, int(share * 2**53))} for n, columns, share in lists]
    rows, cells, ends = _each(df, told, lambda v: F.when(v.isNotNull(), F.xxhash64(v)))
    mixed, whole = F.lit(42).cast("long"), F.lit(True)
    steps = []
    for v, end in zip(cells, ends):
        mixed, whole = F.xxhash64(mixed, v), whole & (end | v.isNotNull())
        steps.append(mixed)
    for step, end in zip(reversed(steps[:-1]), reversed(ends[1:])):
        mixed = F.when(end, step).otherwise(mixed)
    low = rows.select(F.col("number").alias("list"), F.when(whole, mixed).alias("hash"), "limit")
    return low.where(F.col("hash").isNotNull() & (F.shiftrightunsigned("hash", 11) < F.col("limit"))).select("list", "hash")


def sketched(tables: dict[str, DataFrame], combos: list[Combination], size: int) -> dict[int, Sketch]:
    """What a sample says of each combination.

    Of the side with fewer distinct tuples, by approximate counts, those of the smallest hashes are drawn, some size of
    them or all. Each table is scanned once for the counts, once for all samples drawn from it and once for all that are
    sought in it; a row of the other side leaves its task only if its tuple is in a sample.
    """
    spark = next(iter(tables.values())).sparkSession
    lists: dict[tuple[str, tuple[str, ...]], int] = {}
    for c in combos:
        for side in (c.left, c.right):
            lists.setdefault(side, len(lists))

    def hashes(wanted: dict[int, float]) -> list[DataFrame]:
        by: dict[str, list] = {}
        for (table, columns), n in lists.items():
            if n in wanted:
                by.setdefault(table, []).append((n, columns, wanted[n]))
        return [tuple_hashes(tables[t], each) for t, each in sorted(by.items())]

    everything = reduce(DataFrame.unionByName, hashes(dict.fromkeys(lists.values(), 1.0)))
    distinct = {r["list"]: r.n for r in everything.groupBy("list").agg(F.approx_count_distinct("hash").alias("n")).collect()}
    known, draw, seek = [], {}, {}
    for c in combos:
        few, many = sorted((lists[c.left], lists[c.right]), key=lambda n: distinct.get(n, 0))
        share = min(1.0, size / max(1, distinct.get(few, 0)))
        known.append((c.number, few, many, min(2**53, int(share * 2**53)), share))
        draw[few] = max(share, draw.get(few, 0.0))
        seek[many] = max(share, seek.get(many, 0.0))
    frame = spark.createDataFrame([k[:4] for k in known], "combo int, few int, many int, limit bigint")
    drawn = cut(reduce(DataFrame.unionByName, hashes(draw)).distinct(), "drawn")
    sample = drawn.withColumnRenamed("list", "few").join(F.broadcast(frame), "few").where(F.shiftrightunsigned("hash", 11) < F.col("limit"))
    sample = cut(sample.select("combo", F.col("many").alias("list"), "hash"), "sample")
    n = sample.count()
    sought = sample.select("list", "hash").distinct()
    sought = F.broadcast(sought) if n <= SAMPLE_ROWS else sought
    met = reduce(DataFrame.unionByName, [h.join(sought, ["list", "hash"], "left_semi") for h in hashes(seek)]).distinct()
    hits = sample.join(met.withColumn("met", F.lit(1)), ["list", "hash"], "left").groupBy("combo").agg(F.count("*").alias("n"), F.count("met").alias("hits"))
    found = {r.combo: (r.n, r.hits) for r in hits.collect()}
    return {number: Sketch(*found.get(number, (0, 0)), share >= 1.0) for number, _, _, _, share in known}


@dataclass(frozen=True)
class Sketch:
    """Distinct tuples drawn from the side with fewer, those of them that the other side has, and whether all were drawn."""

    drawn: int
    hits: int
    whole: bool

    @property
    def apart(self) -> bool:
        """No tuple is shared, and so none of a longer combination."""
        return self.whole and not self.hits

    @property
    def contain(self) -> float:
        """Containment in the smaller side, bounded from above.

        A sample of n strays by more than sqrt(ln(10^9) / 2n) once in 10^9 times. Where the sides' counts are too close
        to tell apart, the smaller side may be the other one, smaller by up to a quarter.
        """
        if not self.drawn:
            return 0.0 if self.whole else 1.0
        return min(1.0, 1.25 * (self.hits / self.drawn + (0.0 if self.whole else math.sqrt(math.log(1e9) / (2 * self.drawn)))))


def _open(c: Combination, sketch: Sketch, limits: Limits) -> bool:
    """Whether a combination can still be an edge. Jaccard of sets is at most the containment, that of bags at most 1."""
    score = 0.42 * c.pair + (0.26 + 0.10) * sketch.contain + 0.10 + 0.06 * c.kind + 0.06 * c.constraint + 0.02
    return sketch.contain >= 0.15 and score >= limits.min_composite - 1e-4


def composite_edges(tables: dict[str, DataFrame], pairs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Edges of two or three column pairs, sought level by level over all pairs of tables at once.

    Combinations are formed from the scored pairs, a list as small as the catalog. Sketches reject those whose tuples
    hardly meet; three pairs are tried only where no two of them were found, over all tuples, to share none. The tuples
    of the combinations left are counted exactly, in one scan of each table.
    """
    spark = pairs.sparkSession
    flag = lambda s, f: F.coalesce(F.col(f"{s}_meta.{f}"), F.lit(False)).alias(s + f)
    columns = [*KEY, "confidence", "type_score", "constraint_score", *[flag(s, f) for s in "lr" for f in ("is_pk", "is_fk", "is_unique")]]
    by: dict[tuple[str, str], list] = {}
    for r in sorted(pairs.where(F.col("place") <= limits.pairs_for_composites).select(*columns).collect(), key=lambda r: (r.lt, r.rt, -r.confidence, r.lc, r.rc)):
        by.setdefault((r.lt, r.rt), []).append(r)
    chosen: list[Combination] = []
    alive: dict[tuple[str, str], set[frozenset]] = {}
    total = 0
    for level in (2, 3):
        combos = []
        for key, found in by.items():
            combos += combinations_of(found, level, total + len(combos), alive.get(key, set()) if level > 2 else None)
        if not combos:
            break
        total += len(combos)
        told = sketched(tables, combos, limits.sketch)
        alive = {}
        for c in combos:
            if not told[c.number].apart:
                alive.setdefault((c.left[0], c.right[0]), set()).add(frozenset(zip(c.left[1], c.right[1])))
            if _open(c, told[c.number], limits):
                chosen.append(c)
    if not chosen:
        return spark.createDataFrame([], EDGE)
    rows = [(c.number, c.left[0], list(c.left[1]), c.right[0], list(c.right[1]), c.pair, c.kind, c.constraint, c.left_parent, c.right_parent) for c in chosen]
    frame = spark.createDataFrame(rows, "combo int, left_table string, left_cols array<string>, right_table string, right_cols array<string>, pair_mean double, type_mean double, cons_mean double, lp boolean, rp boolean")

    def side_tuples(side: str) -> DataFrame:
        wanted: dict[str, list] = {}
        for c in chosen:
            table, names = getattr(c, side)
            wanted.setdefault(table, []).append((c.number, list(names)))
        return reduce(DataFrame.unionByName, [tuples(tables[t], each) for t, each in sorted(wanted.items())])

    c = F.col
    metrics = cut(tuple_metrics(side_tuples("left"), side_tuples("right")), "metrics")
    scored = frame.join(metrics, "combo").where("contain >= 0.25 or jacc >= 0.15")
    one = (c("lu") > limits.unique) != (c("ru") > limits.unique)
    score = 0.42 * c("pair_mean") + 0.26 * c("contain") + 0.10 * c("jacc") + 0.10 * c("freq") + 0.06 * c("type_mean") + 0.06 * c("cons_mean") + F.when(one, 0.02).otherwise(0.0)
    scored = scored.withColumn("confidence", F.round(F.least(F.lit(1.0), score), 4)).where(c("confidence") >= limits.min_composite)
    place = F.row_number().over(Window.partitionBy("left_table", "right_table").orderBy(F.desc("confidence"), "left_cols", "right_cols"))
    return scored.withColumn("place", place).where(c("place") <= limits.composites_per_pair).select(
        "left_table", "left_cols", "right_table", "right_cols", cardinality(c("lu"), c("ru"), limits.unique).alias("cardinality"),
        direction(c("lp"), c("rp"), c("lu"), c("ru"), limits.unique).alias("direction"), "confidence", F.array(F.lit("composite")).alias("reasons"), F.lit("composite").alias("kind"))


def best_edges(edges: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The best of each set of column pairs; the best singles and composites of each pair of tables."""
    same = F.array_sort(F.arrays_zip("left_cols", "right_cols"))
    first = F.row_number().over(Window.partitionBy("left_table", "right_table", same).orderBy(F.desc("confidence"), "left_cols"))
    one = edges.withColumn("turn", first).where("turn = 1").drop("turn")
    place = F.row_number().over(Window.partitionBy("left_table", "right_table", "kind").orderBy(F.desc("confidence"), "left_cols", "right_cols"))
    return one.withColumn("place", place).where(((F.col("kind") == "single") & (F.col("place") <= limits.top_singles)) | ((F.col("kind") == "composite") & (F.col("place") <= limits.top_composites))).drop("place")


def discover(tables: dict[str, DataFrame], columns: DataFrame, limits: Limits = Limits(), composites: bool = True) -> DataFrame:
    """All edges between the tables of the catalog, best first."""
    wanted: dict[str, list[str]] = {}
    for r in columns.select("table", "column").collect():
        wanted.setdefault(r.table, []).append(r.column)
    columns = cut(columns, "columns")
    counts = cut(counted({k: tables[k] for k in wanted}, wanted), "counts")
    profile = cut(profiles(counts), "profiles")
    pairs = cut(scored_pairs(columns, counts, profile, limits), "pairs")
    edges = single_edges(pairs, limits)
    if composites:
        edges = edges.unionByName(composite_edges(tables, pairs, limits))
    return best_edges(cut(edges, "edges"), limits).orderBy(F.desc("confidence"), "left_table", "right_table", "left_cols", "right_cols")
