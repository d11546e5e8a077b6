"""Execution-guided scores: run every executable template of every candidate on one sample and compare it with the target.

A deterministic sample of the anchor table (the rows whose keys have the smallest digests) is joined along the
candidates' edges once. One projection evaluates all templates of all candidates on it, and one explode turns them into
rows (refs, family, pos, value). Bags of values are then compared by joins: by rank for numbers, by value
and by word for text. The sample's size is a parameter and bounds every group here; the tables are only scanned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import normalize_match, parse_date, parse_number
from ..plans.tables import cut
from .paths import Step

# Priors of families of transformations, and of all others.
PRIORS = {
    "identity": 0.78, "lookup_join": 0.60, "currency_convert": 0.78, "email_username_extract": 0.76, "concat": 0.74, "format": 0.70, "format_date": 0.68, "substring": 0.64,
    "split": 0.64, "regex_extract": 0.62, "lower": 0.60, "upper": 0.60, "trim": 0.60, "arithmetic": 0.70, "ratio": 0.66, "round": 0.62, "scale": 0.60, "bucket": 0.58, "parse_date": 0.66,
    "parse_numeric": 0.60, "date_part": 0.72, "date_shift": 0.62, "date_trunc": 0.62, "date_diff": 0.68, "date_construct": 0.60, "date_range_check": 0.58, "epoch_to_date": 0.56,
    "conditional": 0.58, "threshold_flag": 0.60, "regex_match": 0.56, "in_list": 0.56, "cast_to_string": 0.55,
}
OTHER_PRIOR = 0.52
# Words of a cell that count as true.
TRUE_WORDS = ("active", "open", "yes", "true", "1")
SINGLE = ("identity", "cast_to_string", "parse_numeric", "parse_date", "lower", "upper", "trim", "substring", "email_username_extract", "split", "regex_extract", "round", "scale", "date_part", "conditional")
SEVERAL = ("format", "concat", "arithmetic", "ratio", "currency_convert", "date_diff", "conditional")


@dataclass(frozen=True)
class Candidate:
    """Source columns, each "table.column", that may make a target, and the families of transformations to try."""

    target: str
    refs: tuple[str, ...]
    families: tuple[str, ...]


def template(family: str, cells: Sequence[Column], middle: Column | None = None) -> Column:
    """A family's template over trimmed text cells, as text; null where it makes nothing.

    middle: the median of the first cell's numbers, if most of them are numbers; conditional compares with it.
    """
    a = cells[0]
    b = cells[1] if len(cells) > 1 else a
    numbers = [parse_number(c) for c in cells]
    day = lambda c: F.try_to_date(parse_date(c))
    mail = F.regexp_extract(a, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0)
    ending = F.lower(F.regexp_extract(a, r"\.([A-Za-z0-9]{1,8})$", 1))
    before = F.split_part(a, F.lit("@"), F.lit(1))
    positive = F.lower(a).isin(*TRUE_WORDS)
    if len(cells) > 1:
        flag = F.when(numbers[0].isNotNull() & numbers[1].isNotNull(), numbers[0] > numbers[1])
    else:
        flag = positive if middle is None else F.when(middle.isNotNull(), F.when(numbers[0].isNotNull(), numbers[0] >= middle)).otherwise(positive)
    made = {
        "identity": a, "cast_to_string": a, "parse_numeric": numbers[0], "parse_date": parse_date(a), "lower": F.lower(a), "upper": F.upper(a), "trim": F.trim(a),
        "substring": F.when(F.char_length(a) >= 4, F.right(a, F.lit(4))), "email_username_extract": F.when(F.contains(a, F.lit("@")), before),
        "split": F.when(F.contains(a, F.lit("@")) & (before != ""), before).otherwise(F.nullif(F.btrim(F.get(F.split(a, r"[_\-\s/]+"), F.lit(0)), F.lit(".")), F.lit(""))),
        "regex_extract": F.coalesce(F.nullif(mail, F.lit("")), F.nullif(ending, F.lit(""))), "format": F.concat_ws("-", *cells), "concat": F.concat_ws(" ", *cells),
        "round": F.round(numbers[0], 2), "scale": numbers[0] / 100, "arithmetic": reduce(lambda x, y: x + y, numbers), "ratio": F.try_divide(numbers[0], parse_number(b)),
        "currency_convert": numbers[0] * parse_number(b), "date_part": F.year(day(a)), "date_diff": F.abs(F.datediff(day(a), day(b))), "conditional": flag,
    }
    return made[family].cast("string")


def sample_rows(df: DataFrame, key: Sequence[str], rows: int, salt: str = "") -> DataFrame:
    """The rows of the smallest digests of salt and key, with their order as pos: the same rows in every run."""
    digest = F.md5(F.concat_ws("|", F.lit(salt), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in key]))
    few = df.withColumn("_digest", digest).orderBy("_digest", *[F.col(f"`{c}`") for c in key]).limit(rows)
    # one window task, over at most as many rows as the sample has
    return few.withColumn("pos", F.row_number().over(Window.orderBy("_digest", *[F.col(f"`{c}`") for c in key]))).drop("_digest")


def _named(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{table}__{c}") for c in df.columns])


def _key(df: DataFrame, name: str) -> Column:
    """A cell as a join key: numbers by value, all else as trimmed text, case kept; empty text matches nothing."""
    kind, c = df.schema[name].dataType.typeName(), F.col(f"`{name}`")
    if kind in ("float", "double", "decimal"):
        return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("double").cast("string"))
    return normalize_match(c.cast("string"))


def partial_joined(tables: dict[str, DataFrame], anchor: str, rows: DataFrame, edges: Sequence[Step], needed: set[str]) -> DataFrame:
    """rows of the anchor table joined along edges in either direction; at the end, those that reached all needed tables.

    rows keep the anchor's columns and may have others. Edges may be composite, and parallel: a table is then reached by
    any of the edges that lead to it from tables already joined, and a pair of rows counts once. Until the end a row
    without a match stays as it is, so a table that nobody needs drops nothing.
    """
    extra = [c for c in rows.columns if c not in tables[anchor].columns]
    out = rows.select(*[F.col(f"`{c}`").alias(f"{anchor}__{c}") for c in tables[anchor].columns], *extra)
    reached = [anchor]
    both = [*edges, *[Step(e.target, e.source, e.right, e.left, e.confidence, e.cardinality) for e in edges]]
    while True:
        ready = [e for e in both if e.source in reached and e.target not in reached]
        if not ready:
            break
        table = ready[0].target
        ways = list(dict.fromkeys((e.source, e.left, e.right) for e in ready if e.target == table))
        right = _named(tables[table], table).withColumn(f"{table}__", F.lit(True))
        on = [reduce(lambda a, b: a & b, [_key(out, f"{s}__{x}") == _key(right, f"{table}__{y}") for x, y in zip(left, rights)]) for s, left, rights in ways]
        if len(on) == 1:
            out = out.join(right, on[0], "left")
        else:
            met, alone = [], out
            for i, condition in enumerate(on):
                earlier = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in on[:i]], F.lit(False))
                met.append(out.join(right, condition).where(~earlier))
                alone = alone.join(right, condition, "left_anti")
            out = reduce(DataFrame.unionByName, met).unionByName(alone, allowMissingColumns=True)
        reached.append(table)
    for table in sorted(needed - {anchor}):
        if table not in reached:
            raise ValueError(f"no edge leads to {table}")
        out = out.where(F.col(f"{table}__").isNotNull())
    return out.drop(*[f"{t}__" for t in reached])


def made_values(rows: DataFrame, candidates: Sequence[Candidate], at_once: int = 32) -> DataFrame:
    """(refs, family, pos, value) of all templates on all rows, at_once templates in a projection.

    rows: table__column and pos. A row counts for a candidate only if none of its cells is null or empty. Templates that
    several targets try are evaluated once.
    """
    refs = sorted({r for c in candidates for r in c.refs})
    column = lambda r: F.col("`" + r.replace(".", "__", 1) + "`")
    cells = cut(rows.select("pos", *[normalize_match(column(r).cast("string")).alias(r) for r in refs]), "sample")
    asked = sorted({c.refs[0] for c in candidates if "conditional" in c.families and len(c.refs) == 1})
    medians = {}
    if asked:
        numbers = {r: parse_number(F.col(f"`{r}`")) for r in asked}
        parts = [x for r in asked for x in (F.percentile(numbers[r], 0.5).alias(f"m{r}"), F.count(numbers[r]).alias(f"n{r}"), F.count(f"`{r}`").alias(f"a{r}"))]
        row = cells.agg(*parts).first()
        medians = {r: row[f"m{r}"] if row[f"n{r}"] >= max(3, int(0.6 * row[f"a{r}"])) else None for r in asked}
    each = list(dict.fromkeys((c.refs, f) for c in candidates for f in c.families))
    parts = []
    for start in range(0, len(each), at_once):
        structs = []
        for names, family in each[start : start + at_once]:
            texts = [F.col(f"`{r}`") for r in names]
            full = reduce(lambda a, b: a & b, [t.isNotNull() for t in texts])
            middle = medians.get(names[0]) if family == "conditional" and len(names) == 1 else None
            value = F.when(full, template(family, texts, None if middle is None else F.lit(middle)))
            structs.append(F.struct(F.lit("+".join(names)).alias("refs"), F.lit(family).alias("family"), value.alias("value")))
        parts.append(cells.select("pos", F.inline(F.array(*structs))).where("value is not null"))
    return reduce(DataFrame.unionByName, parts).select("refs", "family", "pos", "value")


def match_scores(made: DataFrame, expected: DataFrame, pairs: DataFrame) -> DataFrame:
    """(target, refs, family, n, score): how well the bags that candidates make match the target's bag.

    made: refs, family, pos, value; expected: target, pos, value; pairs: the target, refs and family to compare. Where at least .8 of both bags are
    numbers, the first values of both, as many as the smaller bag has, are sorted and met by rank: .75 of one less
    their mean distance over the span, and .25 of the bags' overlap. Else .6 of the overlap of texts, case aside, and .4
    of that of their words. Overlap is shared occurrences over the smaller bag.
    """
    bag = ["target", "refs", "family"]
    text = lambda d: d.withColumn("value", F.lower(normalize_match(F.col("value").cast("string")))).where("value is not null")
    p = pairs.join(text(made), ["refs", "family"]).select(*bag, "pos", "value", F.lit(0).alias("side"))
    t = pairs.join(text(expected), "target").select(*bag, "pos", "value", F.lit(1).alias("side"))
    both = cut(p.union(t).withColumn("x", parse_number(F.col("value"))), "bags")
    sides = both.groupBy(*bag).agg(*[F.count(F.when(F.col("side") == s, c)).alias(n) for s, ns in ((0, ("pn", "px")), (1, ("tn", "tx"))) for n, c in zip(ns, (F.lit(1), F.col("x")))])
    sides = sides.where("pn > 0 and tn > 0").withColumn("numeric", (F.col("px") >= 0.8 * F.col("pn")) & (F.col("tx") >= 0.8 * F.col("tn"))).withColumn("n", F.least("px", "tx"))
    # a bag is at most a sample, so are these windows' groups
    early = F.row_number().over(Window.partitionBy(*bag, "side").orderBy("pos", "x"))
    numbers = both.where("x is not null").withColumn("early", early).join(sides.where("numeric").select(*bag, "n"), bag).where("early <= n")
    ranked = numbers.withColumn("rank", F.row_number().over(Window.partitionBy(*bag, "side").orderBy("x")))
    met = ranked.groupBy(*bag, "rank").agg(F.max(F.when(F.col("side") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("x"))).alias("b"))
    span = F.greatest(F.max("b") - F.min("b"), F.max("a") - F.min("a"), F.lit(1e-9))
    near = met.groupBy(*bag).agg(F.greatest(F.lit(0.0), 1 - F.avg(F.abs(F.col("a") - F.col("b"))) / span).alias("near"))
    exact = _overlap(numbers.withColumn("v", F.round("x", 6).cast("string")), bag, "exact")
    words = both.withColumn("v", F.explode(F.split("value", "[^a-z0-9]+"))).where("v != ''")
    scored = sides.join(near, bag, "left").join(exact, bag, "left").join(_overlap(both.withColumn("v", F.col("value")), bag, "texts"), bag, "left").join(_overlap(words, bag, "words"), bag, "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = F.when(F.col("numeric"), 0.75 * some("near") + 0.25 * some("exact")).otherwise(0.6 * some("texts") + 0.4 * some("words"))
    return scored.select(*bag, F.col("pn").alias("n"), score.alias("score"))


def _overlap(rows: DataFrame, bag: list[str], name: str) -> DataFrame:
    """Shared occurrences of v over the smaller of the bag's two sides."""
    each = rows.groupBy(*bag, "v").agg(F.count(F.when(F.col("side") == 0, 1)).alias("p"), F.count(F.when(F.col("side") == 1, 1)).alias("t"))
    return each.groupBy(*bag).agg(F.coalesce(F.try_divide(F.sum(F.least("p", "t")), F.least(F.sum("p"), F.sum("t"))), F.lit(0.0)).alias(name))


def quick_score(match: Column, family: Column, path_confidence: Column, semantic: Column) -> Column:
    """A family's evidence from execution; a lookup has only that of its path and of its meaning."""
    lookup = F.least(F.lit(0.82), 0.22 + 0.38 * path_confidence + 0.20 * semantic)
    return F.when(family == "lookup_join", lookup).when(match.isNull(), F.when(semantic > 0.75, 0.22 + 0.25 * semantic).otherwise(0.0)).otherwise(0.86 * match + 0.14 * semantic)


def prior(family: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PRIORS.items() for x in pair]), family), F.lit(OTHER_PRIOR))


def final_score(base: Column, quick: Column, family: Column, semantic: Column, refs: Column, edges: Column, mismatch: Column | float = 0.0) -> Column:
    """The candidate's score: base and execution evidence, the latter weighing more where it is strong, prior and meaning, less what it costs."""
    less = 0.025 * F.greatest(F.lit(0), refs - 1) + 0.015 * edges + (mismatch if isinstance(mismatch, Column) else F.lit(mismatch))
    strong = 0.35 * base + 0.42 * quick + 0.12 * prior(family) + 0.11 * semantic
    weak = 0.48 * base + 0.28 * quick + 0.13 * prior(family) + 0.11 * semantic
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(quick > 0.5, strong).otherwise(weak) - less))


def final_confidence(score: Column) -> Column:
    return 1 / (1 + F.exp(-(score - 0.42) / 0.20))


def fine_score(coarse: Column, name: Column, value: Column, constraint: Column, kind: Column, null_distinct: Column, semantic: Column, cross_type: Column) -> Column:
    """A source column's score for a target from all the evidence of names, values and declarations."""
    parts = ((0.12, coarse), (0.26, name), (0.18, value), (0.08, constraint), (0.06, kind), (0.06, null_distinct), (0.12, semantic), (0.12, cross_type))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), reduce(lambda a, b: a + b, [w * c for w, c in parts])))


def null_distinct_score(nulls_a: Column, distinct_a: Column, nulls_b: Column, distinct_b: Column) -> Column:
    """How alike two columns are in their shares of nulls and of distinct values."""
    return 0.55 * F.greatest(F.lit(0.0), 1 - F.abs(nulls_a - nulls_b)) + 0.45 * F.greatest(F.lit(0.0), 1 - F.abs(distinct_a - distinct_b))


def execution_scores(tables: dict[str, DataFrame], anchor: str, key: Sequence[str], edges: Sequence[Step], candidates: Sequence[Candidate], expected: DataFrame, rows: int = 300) -> DataFrame:
    """match_scores of all candidates over one sample of the anchor table joined along edges, best family first (place).

    expected: target, pos, value. Candidates of different sets of tables share the joins; each counts the sample's rows
    that have all its cells.
    """
    needed = {r.split(".")[0] for c in candidates for r in c.refs}
    reach = {anchor, *(s.target for s in edges), *(s.source for s in edges)}
    if not needed <= reach:
        raise ValueError(f"no edge leads to {sorted(needed - reach)}")
    joined = partial_joined(tables, anchor, sample_rows(tables[anchor], key, rows), edges, set())
    pairs = joined.sparkSession.createDataFrame([(c.target, "+".join(c.refs), f) for c in candidates for f in c.families], "target string, refs string, family string").distinct()
    scored = match_scores(made_values(joined, candidates), expected, pairs)
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc(F.round("score", 9)), "refs", "family"))
    return scored.withColumn("place", place)
