"""Candidates for target columns: retrieval, scores, composites, transform inference and selection, for all targets at once.

targets: table, column, type, description. Frames of targets by source columns are as large as the two schemas.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import TYPES, compatible, type_bucket, type_family
from ..plans.tables import cut
from .names import _map, _synonymous, bridge_similarity, simple_tokens
from .paths import JoinGraph, branch

# Words of target names by what they ask for.
KEY_WORDS = ("key", "id", "pk", "identifier")
NAME_WORDS = ("name", "full", "fullname")
DURATION_WORDS = ("diff", "days", "duration", "tenure", "age", "elapsed")
TEMPLATE_WORDS = ("formatted", "combined", "template")
# Phrases of descriptions that ask for several columns, and words before "name" that tell people or things.
COMBINING = ("combining", "combined", "concatenat", "merge", "full name", "first and last", "formatted as", "template")
PERSON_ROLES = (
    "lead", "manager", "mgr", "employee", "emp", "customer", "cust", "user", "contact", "owner", "author", "creator", "approver", "reviewer", "assignee", "supervisor",
)
ENTITY_WORDS = (
    "department", "dept", "project", "proj", "product", "prod", "account", "acct", "order", "table", "category", "org", "organization", "company", "team", "group", "region", "store",
)
# Target names that stand for parts, and the words that the sources of one alternative must have.
COMPOSITE_NAMES = {
    "full_name": [["first", "last"], ["fname", "lname"]], "lead_name": [["first", "last"]], "display_name": [["first", "last"]], "name_email": [["first", "last", "email"], ["name", "email"]],
    "address": [["street", "city"], ["line1", "city"], ["addr1", "city"]],
}
DATE_PARTS = ("year", "month", "quarter", "week", "day", "hour")
# Words of names that say what a column is like rather than what it is about.
DATE_WORDS = ("date", "dt", "time", "timestamp", "ts", "at", "on", "day", "of")
BIRTH_WORDS = ("dob", "birth", "birthdate", "birthday", "born")
STATUS_WORDS = ("status", "state", "flag", "active", "enabled", "stage", "indicator")
LABEL_WORDS = ("label", "name", "title", "description", "desc")
CODE_WORDS = ("code", "cd")
END_WORDS = ("start", "end", "begin", "finish", "from", "to", "open", "close")
BRACKET_WORDS = ("bracket", "band", "bucket", "tier", "range", "segment")


def _tokens(c: Column) -> Column:
    return F.array_distinct(simple_tokens(F.coalesce(c, F.lit(""))))


def _share(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(b), F.lit(1))


def _name_score(table: Column, column: Column, target: Column) -> Column:
    """bridge_similarity of the column's name, or of the table's name in place of a prefix that abbreviates it."""
    prefix = F.regexp_extract(F.lower(column), r"^([a-z]{1,2})_.", 1)
    whole = F.concat(table, F.lit("_"), F.regexp_replace(column, r"^[A-Za-z]{1,2}_", ""))
    return F.greatest(bridge_similarity(column, target), F.when((prefix != "") & F.lower(table).startswith(prefix), bridge_similarity(whole, target)))


def _fit() -> Column:
    """How a source's type serves a target: of one family, or of those from which a kind of transformation leads there.

    A date serves a target that asks for one of its parts, or for a span, the better if the rest of its name is among
    the target's words; a status serves a flag; a name serves a label better than a code does.
    """
    has = lambda c, ws: F.arrays_overlap(c, F.array(*map(F.lit, ws)))
    source, target = type_family(F.col("s_type")), type_family(F.col("t_type"))
    same = F.coalesce((source == target) | (F.lower("s_type") == F.lower("t_type")), F.lit(False))
    own = _tokens(F.col("tc"))
    about = F.array_except(_synonymous(F.col("s_words")), F.array(*map(F.lit, DATE_WORDS)))
    shared = F.arrays_overlap(about, F.col("t_words"))
    is_date, number = F.coalesce(source == "date", F.lit(False)), F.coalesce(target == "numeric", F.lit(False))
    part = number & has(own, DATE_PARTS)
    span = number & has(own, DURATION_WORDS)
    birth = has(F.col("s_words"), BIRTH_WORDS) & has(own, ("age",))
    flag = F.lower("t_type").isin("boolean", "bool")
    named = F.arrays_overlap(F.array_except(F.col("s_words"), F.array(F.lit("is"), F.lit("has"))), F.col("t_words"))
    label = has(own, LABEL_WORDS) & F.coalesce(source == "string", F.lit(False)) & shared
    fit = F.when(part & is_date, F.when(shared, 0.50).otherwise(0.15)).when(span & is_date, F.when(birth | shared | has(about, END_WORDS), 0.45).otherwise(0.10))
    fit = fit.when(part & ~has(F.col("s_words"), DATE_PARTS), -0.35).when(flag & ~same, F.when(has(F.col("s_words"), STATUS_WORDS), 0.40).when(named, 0.15).otherwise(-0.15))
    fit = fit.when(flag & ~named, -0.10).when(same, 0.15).otherwise(-0.15)
    return fit + F.when(label & has(F.col("s_words"), LABEL_WORDS), 0.15).when(label & has(F.col("s_words"), CODE_WORDS), 0.05).otherwise(0.0)


def scored_sources(targets: DataFrame, columns: DataFrame, min_score: float = 0.15) -> DataFrame:
    """Each target with each source column: name, description, type, key and table evidence, best first."""
    t = targets.select(F.col("table").alias("tt"), F.col("column").alias("tc"), F.col("type").alias("t_type"), "description")
    s = columns.select(F.col("table").alias("st"), F.col("column").alias("sc"), F.col("type").alias("s_type"), "is_pk", "is_fk")
    t = t.withColumns({"t_words": F.array_union(_synonymous(_tokens(F.col("tc"))), _tokens(F.col("description"))), "d_words": _tokens(F.col("description")), "tt_words": _synonymous(_tokens(F.col("tt")))})
    s = s.withColumns({"s_words": _tokens(F.col("sc")), "st_words": _synonymous(_tokens(F.col("st")))})
    # schemas meet, not rows
    met = t.join(s, F.lit(True))
    asked = F.arrays_overlap("t_words", F.array(*map(F.lit, KEY_WORDS)))
    key = F.when(F.col("is_pk") | F.col("is_fk"), F.when(asked, 0.15).otherwise(-0.10)).otherwise(0.0)
    score = _name_score(F.col("st"), F.col("sc"), F.col("tc")) + 0.3 * F.when(F.size("d_words") > 0, _share(F.col("s_words"), F.col("d_words"))).otherwise(0.0) + _fit() + key + 0.2 * _share(F.col("st_words"), F.col("t_words"))
    # of tables that share as many words with the target the one that is about nothing else; of keys the table's own
    score = score + 0.05 * _share(F.col("t_words"), _tokens(F.col("st"))) + F.when(F.col("is_pk") & asked, 0.05).otherwise(0.0)
    primary = F.arrays_overlap("st_words", "tt_words")
    found = met.select("tt", "tc", "t_type", "st", "sc", "s_type", "is_pk", "is_fk", "t_words", "s_words", _fit().alias("fit"), primary.alias("is_primary"), F.round(score, 6).alias("score")).where(F.col("score") > min_score)
    place = F.row_number().over(Window.partitionBy("tt", "tc").orderBy(F.desc("score"), F.desc("is_primary"), "st", "sc"))
    return found.withColumn("place", place)


def infer_transform(target: Column, target_type: Column, sources: Column, joined: Column) -> Column:
    """The kind of transformation for an array of structs (table, column, type), by rules in order."""
    family = {k: F.array(*map(F.lit, v)) for k, v in TYPES.items()}
    of = lambda c, k: F.array_contains(family[k], F.lower(c))
    words = _tokens(target)
    has = lambda ws: F.arrays_overlap(words, F.array(*map(F.lit, ws)))
    one, n = sources[0], F.size(sources)
    kinds = F.transform(sources, lambda s: F.lower(s["type"]))
    every = lambda k: F.forall(kinds, lambda x: F.array_contains(family[k], x))
    num, text, date = of(target_type, "numeric"), of(target_type, "string"), of(target_type, "date")
    same = (F.lower(one["type"]) == F.lower(target_type)) | (of(one["type"], "numeric") & num)
    last = F.element_at(_tokens(one["column"]), -1)
    coded = text & last.isin(*CODE_WORDS) & has(LABEL_WORDS)
    flag = F.lower(target_type).isin("boolean", "bool") & ~F.lower(one["type"]).isin("boolean", "bool")
    single = (
        F.when(F.lower(one["column"]) == F.lower(target), "direct_copy").when(coded, "code_to_label").when(flag, "conditional").when(text & of(one["type"], "numeric") & has(BRACKET_WORDS), "bucketing").when(of(one["type"], "date") & num & has(DATE_PARTS), "date_part").when(of(one["type"], "date") & num, "date_diff")
        .when(of(one["type"], "date") & text, "date_format").when(of(one["type"], "string") & date, "date_parse").when(joined, "fk_lookup").when(same, "rename").otherwise("type_cast"))
    names = F.exists(sources, lambda s: F.arrays_overlap(_tokens(s["column"]), F.array(*map(F.lit, NAME_WORDS))))
    several = (
        F.when(text & (every("string") | names), "concat").when(text & has(TEMPLATE_WORDS), "template").when(num & every("numeric"), "arithmetic")
        .when(num & F.exists(kinds, lambda k: F.array_contains(family["date"], k)), F.when(has(DURATION_WORDS), "date_diff").otherwise("date_part"))
        .when(F.size(F.array_distinct(F.transform(sources, lambda s: s["table"]))) > 1, "lookup_join").otherwise("conditional"))
    return F.when(n == 0, "unmapped").when(n == 1, single).otherwise(several)


def candidates(scored: DataFrame, per_target: int = 10, pairs_of: int = 6) -> DataFrame:
    """Single columns, and pairs of one table: (tt, tc, t_type, sources, score, is_primary, transform)."""
    source = F.struct(F.col("st").alias("table"), F.col("sc").alias("column"), F.col("s_type").alias("type"))
    top = scored.where(F.col("place") <= per_target).withColumn("source", source)
    singles = top.select("tt", "tc", "t_type", F.array("source").alias("sources"), "score", "is_primary")
    few = top.where((F.col("place") <= pairs_of) & ~F.col("is_pk") & ~F.col("is_fk"))
    a, b = few.alias("a"), few.alias("b")
    met = a.join(b, (F.col("a.tt") == F.col("b.tt")) & (F.col("a.tc") == F.col("b.tc")) & (F.col("a.st") == F.col("b.st")) & (F.col("a.sc") < F.col("b.sc")))
    mean = (F.col("a.score") + F.col("b.score")) / 2
    both = F.array("a.source", "b.source")
    within = lambda side: F.size(F.array_except(F.col(f"{side}.s_words"), F.col("a.t_words"))) == 0
    numbers = (type_family(F.col("a.t_type")) == "numeric") & (type_family(F.col("a.s_type")) == "numeric") & (type_family(F.col("b.s_type")) == "numeric")
    told = F.coalesce(numbers & within("a") & within("b"), F.lit(False))
    asked = F.arrays_overlap(F.col("a.t_words"), F.array(*map(F.lit, ("total", *DURATION_WORDS))))
    # a pair must be asked for: as the parts of a name, by a description that names both, or by a word for a sum or span
    bonus = F.when(concat_asked(F.col("a.tc"), F.array_join("a.t_words", " "), both), 0.10).when(told, 0.45).when(asked, 0.10).otherwise(-0.30)
    pairs = met.select("a.tt", "a.tc", "a.t_type", both.alias("sources"), (mean + bonus).alias("score"), "a.is_primary")
    # a span lies between two dates, of any tables
    is_date = F.coalesce((type_family(F.col("s_type")) == "date") & (type_family(F.col("t_type")) == "numeric"), F.lit(False))
    spans = scored.withColumn("source", source).where(is_date & (F.col("fit") >= 0.45) & F.arrays_overlap(_tokens(F.col("tc")), F.array(*map(F.lit, DURATION_WORDS))))
    turn = F.row_number().over(Window.partitionBy("tt", "tc").orderBy(F.desc("score"), "st", "sc"))
    ends = spans.withColumn("turn", turn).where("turn <= 2").groupBy("tt", "tc", "t_type").agg(F.array_sort(F.collect_list("source")).alias("sources"), F.avg("score").alias("score"), F.max("is_primary").alias("is_primary"))
    ends = ends.where(F.size("sources") == 2).select("tt", "tc", "t_type", "sources", (F.col("score") + 0.30).alias("score"), "is_primary")
    pairs = pairs.unionByName(ends).groupBy("tt", "tc", "t_type", "sources").agg(F.max("score").alias("score"), F.max("is_primary").alias("is_primary"))
    every = singles.unionByName(pairs)
    return every.withColumn("transform", infer_transform(F.col("tc"), F.col("t_type"), F.col("sources"), ~F.col("is_primary")))


def composites(scored: DataFrame, paths: DataFrame, seeds: int = 8, per_table: int = 3, arity: int = 4) -> DataFrame:
    """Ordered sets of seed columns: (.78 mean + .18 path) damped by .95 for each column and .93 for each edge.

    paths: start, target, cost, hops, place, as enumerate_paths gives them.
    """
    turn = F.row_number().over(Window.partitionBy("tt", "tc", "st").orderBy(F.desc("score"), "sc"))
    pool = scored.where(F.col("place") <= seeds).withColumn("turn", turn).where(F.col("turn") <= per_table)
    pool = cut(pool.select("tt", "tc", F.concat_ws(".", "st", "sc").alias("ref"), "st", "score"), "seeds")
    best = paths.where("place = 1").select("start", F.col("target").alias("end"), F.exp(-F.col("cost") / F.col("hops")).alias("strength"), "hops")
    level = pool.select("tt", "tc", F.array("ref").alias("refs"), F.col("st").alias("first"), F.array("st").alias("tables"), F.col("score").alias("total"), F.lit(1.0).alias("path"), F.lit(0).alias("edges"))
    out = []
    for k in range(2, arity + 1):
        p = pool.withColumnsRenamed({"tt": "pt", "tc": "pc", "score": "add"})
        met = level.join(p, (F.col("tt") == F.col("pt")) & (F.col("tc") == F.col("pc")) & (F.col("ref") > F.element_at("refs", -1)))
        met = met.join(best, (F.col("first") == F.col("start")) & (F.col("st") == F.col("end")), "left").where("st = first or strength is not null")
        new = ~F.array_contains("tables", F.col("st"))
        level = met.select(
            "tt", "tc", F.array_append("refs", F.col("ref")).alias("refs"), "first", F.array_union("tables", F.array("st")).alias("tables"), (F.col("total") + F.col("add")).alias("total"),
            F.when(new, F.least("path", F.coalesce("strength", F.lit(1.0)))).otherwise(F.col("path")).alias("path"), (F.col("edges") + F.when(new, F.coalesce("hops", F.lit(0))).otherwise(0)).alias("edges"))
        level = cut(level, f"composites-{k}")
        out.append(level.select("tt", "tc", "refs", "edges", F.round((0.78 * F.col("total") / k + 0.18 * F.col("path")) * 0.95 ** (k - 1) * F.pow(F.lit(0.93), "edges"), 6).alias("score")))
    return reduce(DataFrame.unionByName, out)


def select_mappings(found: DataFrame, alternatives: int = 3, threshold: float = 0.2) -> DataFrame:
    """The best candidate of each target with its confidence, and the next ones; none below the threshold."""
    refs = F.array_sort(F.transform("sources", lambda s: F.concat_ws(".", s["table"], s["column"])))
    one = F.row_number().over(Window.partitionBy("tt", "tc", "refs", "transform").orderBy(F.desc("score")))
    each = found.withColumn("refs", refs).withColumn("turn", one).where("turn = 1")
    preferred = F.when(F.col("transform") == "concat", 0.05).otherwise(0.0)
    place = F.row_number().over(Window.partitionBy("tt", "tc").orderBy(F.desc(F.col("score") + preferred), F.desc("is_primary"), "refs"))
    ranked = each.withColumn("place", place).where(F.col("place") <= 1 + alternatives)
    told = F.struct("place", "refs", "transform", "score")
    best = ranked.groupBy("tt", "tc").agg(F.array_sort(F.collect_list(told)).alias("ranked"))
    first = F.col("ranked")[0]
    abstain = first["score"] < threshold
    rest = F.slice("ranked", 2, alternatives)
    return best.select("tt", "tc", F.when(abstain, F.array().cast("array<string>")).otherwise(first["refs"]).alias("refs"), F.when(abstain, "unmapped").otherwise(first["transform"]).alias("transform"),
                       F.round(1 / (1 + F.exp(-(first["score"] - 0.42) / 0.20)), 4).alias("confidence"), rest.alias("alternatives"))


def concat_asked(target: Column, description: Column, sources: Column) -> Column:
    """Whether several source columns are the parts that a target's name or description asks for.

    By a known composite name, by a phrase in the description, or by the name of a person's role and "name"
    (manager_name, but not department_name) over a first and a last name.
    """
    words, told = _tokens(target), _tokens(description)
    arr = lambda ws: F.array(*map(F.lit, ws))
    held_words = F.array_distinct(F.flatten(F.transform(sources, lambda s: simple_tokens(s["column"]))))
    has = lambda ws, xs: F.size(F.array_intersect(ws, arr(xs))) == len(set(xs))
    asked = F.lit(False)
    for name, alternatives in COMPOSITE_NAMES.items():
        parts = reduce(lambda a, b: a | b, [has(held_words, x) for x in alternatives])
        named = F.contains(F.replace(F.lower(target), F.lit("_"), F.lit(" ")), F.lit(name.replace("_", " "))) | has(F.array_union(words, told), name.split("_"))
        asked = asked | (named & parts)
    phrase = reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(description, F.lit(""))), F.lit(x)) for x in COMBINING])
    roles = _synonymous(F.array_remove(words, "name"))
    person = F.array_contains(words, "name") & F.arrays_overlap(roles, arr(PERSON_ROLES)) & ~F.arrays_overlap(roles, arr(ENTITY_WORDS))
    return (F.size(sources) > 1) & (asked | phrase | ((person | has(words, ("full", "name"))) & has(held_words, ("first", "last"))))


def lookups(targets: DataFrame, columns: DataFrame, least: float = 0.15, min_score: float = 0.3) -> DataFrame:
    """The best column of the source table that a target's words name: (tt, tc, t_type, source, is_primary, score).

    Tables are met by their words, so no target is compared with a table that shares none with it.
    """
    t = targets.select(F.col("table").alias("tt"), F.col("column").alias("tc"), F.col("type").alias("t_type"), F.array_distinct(F.array_union(_synonymous(_tokens(F.col("column"))), _tokens(F.col("description")))).alias("words"))
    s = columns.select("table").distinct().select("table", F.array_distinct(_synonymous(_tokens(F.col("table")))).alias("st_words"))
    met = t.withColumn("word", F.explode("words")).join(s.withColumn("word", F.explode("st_words")), "word")
    shares = met.groupBy("tt", "tc", "t_type", "words", "table", "st_words").agg((F.count("*") / F.size("words")).alias("share"))
    primary = F.arrays_overlap("st_words", _synonymous(_tokens(F.col("tt"))))
    place = F.row_number().over(Window.partitionBy("tt", "tc").orderBy(F.desc("share"), "table"))
    named = shares.where(F.col("share") > least).withColumns({"place": place, "is_primary": primary}).where("place = 1").select("tt", "tc", "t_type", "words", "table", "is_primary")
    each = named.join(columns.select("table", F.col("column").alias("sc"), F.col("type").alias("s_type"), "is_pk", "is_fk"), "table")
    asked = F.arrays_overlap(_tokens(F.col("tc")), F.array(*map(F.lit, ("key", "id", "pk", "fk", "identifier", "code"))))
    kind = F.when(F.coalesce(compatible(type_bucket(F.col("s_type")), type_bucket(F.col("t_type"))), F.lit(False)), 0.2).otherwise(-0.2)
    score = _name_score(F.col("table"), F.col("sc"), F.col("tc")) + kind + F.when((F.col("is_pk") | F.col("is_fk")) & ~asked, -0.15).otherwise(0.0)
    turn = F.row_number().over(Window.partitionBy("tt", "tc").orderBy(F.desc("score"), "sc"))
    source = F.struct(F.col("table").alias("table"), F.col("sc").alias("column"), F.col("s_type").alias("type"))
    best = each.withColumn("score", F.round(score, 6)).withColumn("turn", turn).where((F.col("turn") == 1) & (F.col("score") > min_score))
    return best.select("tt", "tc", "t_type", source.alias("source"), "is_primary", "score")


# Beginnings of target tables' names that name no entity, and words for one entity.
LAYER_WORDS = ("dim", "fact", "bridge", "stg", "raw", "src")
ENTITY_GROUPS = (
    ("employee", "staff", "worker", "person", "people"), ("product", "item", "items", "goods", "merchandise", "store_item", "store_items", "catalog"),
    ("order", "purchase", "sale", "transaction"), ("customer", "client", "buyer", "account"), ("sensor", "device", "probe"), ("reading", "measurement", "observation"),
    ("department", "dept"), ("project", "initiative"), ("location", "site", "building", "place"), ("supplier", "vendor", "provider"),
)


def primary_tables(targets: DataFrame, columns: DataFrame) -> DataFrame:
    """(tt, primary, votes): the source table that a target table is about.

    Each pair of a word of the target's name and one of the source's votes 2 if they are the same but for an s at the
    end, 1.5 if they stand for the same entity. Words meet by equi-joins on themselves and on their groups.
    """
    base = lambda c: F.regexp_replace(c, "s+$", "")
    groups = _map({base_of: [f"#{i}" for i, g in enumerate(ENTITY_GROUPS) if base_of in {w.rstrip("s") for w in g}] for g in ENTITY_GROUPS for base_of in {w.rstrip("s") for w in g}})

    def voters(tables: DataFrame, name: str) -> DataFrame:
        each = tables.select(name, F.explode(_tokens(F.col(name))).alias("word")).where(~F.col("word").isin(*LAYER_WORDS)).withColumn("base", base(F.col("word")))
        keys = F.concat(F.array("base"), F.coalesce(F.try_element_at(groups, F.col("base")), F.array().cast("array<string>")))
        return each.withColumn("key", F.explode(keys))

    t = voters(targets.select(F.col("table").alias("tt")).distinct(), "tt").withColumnRenamed("word", "target_word")
    s = voters(columns.select(F.col("table").alias("primary")).distinct(), "primary").withColumnRenamed("word", "source_word")
    met = t.select("tt", "target_word", "key").join(s.select("primary", "source_word", "key"), "key")
    vote = F.max(F.when(F.col("key").startswith("#"), 1.5).otherwise(2.0)).alias("vote")
    votes = met.groupBy("tt", "primary", "target_word", "source_word").agg(vote).groupBy("tt", "primary").agg(F.sum("vote").alias("votes"))
    # of equal votes the table whose name says least besides
    place = F.row_number().over(Window.partitionBy("tt").orderBy(F.desc("votes"), F.size(_tokens(F.col("primary"))), "primary"))
    return votes.withColumn("place", place).where("place = 1").drop("place")


WAYS = "tt string, tc string, primary string, join_path array<struct<from:string,to:string,left_cols:array<string>,right_cols:array<string>,confidence:double>>"


def join_ways(mapped: DataFrame, primaries: DataFrame, edges: DataFrame, min_confidence: float = 0.55) -> DataFrame:
    """(tt, tc, primary, join_path): the joins that bring each mapping's tables to the target table's primary table.

    For each target table one tree of joins is sought over all tables that its mappings need, so mappings share joins.
    A target table without votes is rooted in the table that most of its mappings read. The frames are as small as the
    catalog. A mapping whose tables cannot be reached, or need no join, has no join_path.
    """
    roots = {r.tt: r.primary for r in primaries.collect()}
    needs: dict[str, list[tuple[str, list[str]]]] = {}
    for r in mapped.select("tt", "tc", "refs").orderBy("tt", "tc").collect():
        needs.setdefault(r.tt, []).append((r.tc, [x.split(".")[0] for x in r.refs]))
    graph, rows = JoinGraph(edges, min_confidence), []
    for tt, each in needs.items():
        read = [t for _, tables in each for t in tables]
        root = roots.get(tt) or min(set(read), key=lambda t: (-read.count(t), t), default=None)
        tree = graph.tree(root, set(read)) if root else []
        reached = {root, *(s.target for s in tree)}
        for tc, tables in each:
            steps = list(dict.fromkeys(s for t in tables for s in branch(tree, t))) if set(tables) <= reached else []
            told = [(s.source, s.target, list(s.left), list(s.right), round(s.edge if s.edge is not None else s.confidence, 4)) for s in steps]
            rows.append((tt, tc, root, told or None))
    return mapped.sparkSession.createDataFrame(rows, WAYS)


def plan_mappings(targets: DataFrame, columns: DataFrame, edges: DataFrame, alternatives: int = 3, threshold: float = 0.2, strong: float = 0.86) -> DataFrame:
    """select_mappings with the order concat, lookup, rank, and the join that a mapping needs: adds join_path and by.

    Parts that concat_asked finds come first. Else a column of another table that the target's words name is looked up,
    if it scores over .4 and no single column scores over strong and at least as high. Else the ranking decides. A
    mapping from outside the target's primary table has the joins that lead from there to its tables as join_path.
    """
    scored = cut(scored_sources(targets, columns), "scored")
    found = cut(candidates(scored).join(targets.select(F.col("table").alias("tt"), F.col("column").alias("tc"), "description"), ["tt", "tc"]), "candidates")
    ranked = select_mappings(found.drop("description"), alternatives, threshold)
    sure = lambda score, least: F.round(F.greatest(F.lit(least), 1 / (1 + F.exp(-(score - 0.42) / 0.20))), 4)
    names = F.array_sort(F.transform("sources", lambda s: F.concat_ws(".", s["table"], s["column"])))
    parts = found.where(concat_asked(F.col("tc"), F.col("description"), F.col("sources"))).withColumn("refs", names)
    # a column of the target's very name is no part of it
    same = found.where((F.size("sources") == 1) & (F.lower(F.col("sources")[0]["column"]) == F.lower("tc")) & (type_family(F.col("sources")[0]["type"]) == type_family(F.col("t_type"))))
    parts = parts.join(same.select("tt", "tc").distinct(), ["tt", "tc"], "left_anti")
    turn = F.row_number().over(Window.partitionBy("tt", "tc").orderBy(F.desc("score"), F.desc("is_primary"), "refs"))
    kind = F.when(F.col("transform") == "template", "template").otherwise("concat")
    parts = parts.withColumn("turn", turn).where("turn = 1").select("tt", "tc", F.struct("refs", kind.alias("transform"), sure(F.col("score"), 0.75).alias("confidence"), F.lit("concat").alias("by")).alias("parts"))
    direct = found.where(F.size("sources") == 1).groupBy("tt", "tc").agg(F.max("score").alias("direct"))
    looked = lookups(targets, columns).where(~F.col("is_primary") & (F.col("score") > 0.4)).join(direct, ["tt", "tc"], "left")
    looked = looked.where(F.coalesce(F.col("direct"), F.lit(0.0)) <= F.greatest(F.lit(strong), "score"))
    kind = infer_transform(F.col("tc"), F.col("t_type"), F.array("source"), F.lit(True))
    kind = F.when(kind.isin("rename", "direct_copy"), "fk_lookup").otherwise(kind)
    refs = F.array(F.concat_ws(".", "source.table", "source.column"))
    looked = looked.select("tt", "tc", F.struct(refs.alias("refs"), kind.alias("transform"), F.round(F.least(F.lit(0.95), F.col("score") * 0.7 + 0.25), 4).alias("confidence"), F.lit("lookup").alias("by")).alias("looked"))
    ranks = F.struct("refs", "transform", "confidence", F.lit("rank").alias("by"))
    best = ranked.select("tt", "tc", ranks.alias("ranks"), "alternatives").join(parts, ["tt", "tc"], "full").join(looked, ["tt", "tc"], "full")
    best = best.select("tt", "tc", F.coalesce("parts", "looked", "ranks").alias("best"), "alternatives").select("tt", "tc", "best.*", "alternatives")
    best = cut(best, "mappings")
    ways = join_ways(best, primary_tables(targets, columns), edges)
    far = (F.col("transform") == "fk_lookup") & (F.size("join_path") > 1)
    kind = F.when(far, "lookup_join").otherwise(F.col("transform"))
    return best.join(ways, ["tt", "tc"], "left").select("tt", "tc", "refs", kind.alias("transform"), "confidence", "primary", "join_path", "by", "alternatives")


def feasible_families(target_type: Column, arity: Column) -> Column:
    """Families of transformations that a target type and a number of sources allow."""
    bucket = type_bucket(target_type)
    arr = lambda *xs: F.array(*map(F.lit, xs))
    one = F.when(bucket == "string", arr("identity", "cast_to_string", "lower", "upper", "trim", "substring", "email_username_extract", "split", "regex_extract", "lookup_join"))
    one = one.when(bucket == "numeric", arr("identity", "parse_numeric", "round", "scale", "date_part", "lookup_join")).when(bucket == "date", arr("identity", "parse_date", "lookup_join"))
    one = one.when(bucket == "boolean", arr("identity", "conditional", "lookup_join")).otherwise(arr("identity", "lookup_join"))
    many = F.when(bucket == "string", arr("concat", "format", "lookup_join")).when(bucket == "numeric", arr("arithmetic", "ratio", "currency_convert", "date_diff", "lookup_join")).when(bucket == "boolean", arr("conditional")).otherwise(arr("lookup_join"))
    return F.when(arity == 1, one).otherwise(many)


def hashed_grams(text: Column, size: int = 384) -> Column:
    """A reproducible embedding: counts of 2- to 4-character grams by hashed place, as a map of unit length."""
    low = F.concat(F.lit("#"), F.lower(text), F.lit("#"))

    def cut_in(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(low) - n + 1)), lambda i: F.substring(low, i, F.lit(n)))

    grams = F.flatten(F.array(*map(cut_in, (2, 3, 4))))
    places = F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(size)).cast("int"))
    counts = F.map_from_entries(F.transform(F.array_distinct(places), lambda p: F.struct(p, F.size(F.filter(places, lambda q: q == p)).cast("double"))))
    norm = F.sqrt(F.aggregate(F.map_values(counts), F.lit(0.0), lambda s, x: s + x * x))
    return F.transform_values(counts, lambda k, v: v / norm)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two sparse maps."""
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))
