"""Queries of the matcher over the star schema, with SQL where it can say the same."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import transforms as t
from ..functions import legacy
from ..operators import candidates, execute, execution, joins, metrics, names, paths, profile, retrieval, semantics, synthesis, value_similarity
from ..sources import catalog
from ..sources.tables import table
from ..streaming.profiles import event_profile
from . import matcher_sql
from .tables import cut, own_path

# The star schema as it is matched: all columns of all its tables with their declared types, and the declared keys.
SCHEMA = {
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
                 "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "string"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "region": {"r_regionkey": "int", "r_name": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
}
WANTED = {n: list(cs) for n, cs in SCHEMA.items()}
KEYS = {"customer": "c_custkey", "nation": "n_nationkey", "orders": "o_orderkey", "part": "p_partkey", "region": "r_regionkey", "supplier": "s_suppkey"}
REFERENCES = {
    "orders.o_custkey": "customer.c_custkey", "customer.c_nationkey": "nation.n_nationkey", "nation.n_regionkey": "region.r_regionkey", "lineitem.l_orderkey": "orders.o_orderkey",
    "lineitem.l_partkey": "part.p_partkey", "lineitem.l_suppkey": "supplier.s_suppkey", "supplier.s_nationkey": "nation.n_nationkey",
}
TARGETS = (("fact_order", "order_key", "int", "identifier of the order"), ("fact_order", "customer_name", "string", "name of the customer"), ("fact_order", "order_status", "string", "status of the order"),
           ("fact_order", "total_price", "decimal", "total price of the order"), ("fact_order", "nation_name", "string", "name of the nation"), ("dim_customer", "customer_key", "int", "key of the customer"), ("dim_customer", "nation_name", "string", "name of the nation"))


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n).select(*c) for n, c in WANTED.items()}


def _counts(spark: SparkSession, sf_dir: str, wanted: dict[str, list[str]] = WANTED) -> DataFrame:
    frames = _tables(spark, sf_dir)
    return profile.counted({n: frames[n] for n in wanted}, wanted)


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.from_frames(spark, _tables(spark, sf_dir), KEYS, REFERENCES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discover the join of orders and customer, take the best path, and load fact_order along it."""
    frames = {n: table(spark, sf_dir, n) for n in ("customer", "orders")}
    columns = catalog.from_frames(spark, frames, {"customer": "c_custkey", "orders": "o_orderkey"}, {"orders.o_custkey": "customer.c_custkey"})
    edges = joins.discover(frames, columns, composites=False)
    path = paths.JoinGraph(edges).paths("orders", "customer", k=1)
    target = {
        "order_key": t.direct_copy("orders__o_orderkey"), "customer_name": t.direct_copy("customer__c_name"),
        "order_year": t.extract_year("orders__o_orderdate"), "is_open": t.equality_check("orders__o_orderstatus", "O"),
    }
    return execute.materialize(frames, "orders", path, target)


def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.profiles(cut(_counts(spark, sf_dir), "counts"))
    digits = lambda c: F.round(c, 6).alias(c)
    return p.select("table", "column", "total_rows", "valid_count", "kind", "n_distinct", *map(digits, ("null_frac", "distinct_ratio", "entropy", "min", "max", "avg_len", "std_len", "integer_ratio", "q05", "q50", "q95")))


def most_common_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = profile.most_common(cut(_counts(spark, sf_dir), "counts"), 10)
    return top.select("table", "column", "value", "n", F.round("frequency", 9).alias("frequency"), "place")


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(cut(_counts(spark, sf_dir), "counts"))


def shared_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(_counts(spark, sf_dir, {"customer": ["c_custkey", "c_nationkey"], "nation": ["n_nationkey", "n_regionkey"], "orders": ["o_custkey"], "region": ["r_regionkey"]}), "counts")
    pairs = counts.select("table", "column").distinct()
    side = lambda s: pairs.select(F.col("table").alias(s + "t"), F.col("column").alias(s + "c"))
    return value_similarity.shared_values(counts, side("l").join(side("r"), F.col("lt") < F.col("rt")))


def value_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(_counts(spark, sf_dir), "counts")
    p = cut(profile.profiles(counts), "profiles")
    scored = value_similarity.similarity(counts, p, value_similarity.column_pairs(p))
    return scored.select(*value_similarity.KEY, "value_score", "reason", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in matcher_sql.SIGNALS])


# Columns whose values are names.
NAMED = (("part", "p_name"), ("events", "event_type"))


def name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names, and the names that parts and events have in the data, each with each other."""
    held = [table(spark, sf_dir, t).select(F.col(c).alias("column")) for t, c in NAMED]
    c = cut(reduce(DataFrame.union, held, _catalog(spark, sf_dir).select("column")).where("column is not null").distinct(), "names")
    a, b = c.select(F.col("column").alias("a")), c.select(F.col("column").alias("b"))
    met = a.join(b, F.col("a") < F.col("b"))
    x, y = F.col("a"), F.col("b")
    scores = {"join_name": names.join_name_score(x, y), "lexical": names.lexical_similarity(x, y), "bridge": names.bridge_similarity(x, y), "name": names.name_similarity(x, y)}
    return met.select("a", "b", *[F.round(v, 9).alias(k) for k, v in scores.items()], F.array_join(names.conflicts(names.words(x), names.words(y)), ",").alias("conflicts"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.discover(_tables(spark, sf_dir), _catalog(spark, sf_dir))


def join_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = [F.array_join(c, ",").alias(c) for c in ("left_cols", "right_cols", "reasons")]
    return _edges(spark, sf_dir).select("left_table", told[0], "right_table", told[1], "cardinality", "direction", "confidence", told[2], "kind")


# Lines against tables that Spark derives from them: returned lines by order and line, and each part's suppliers.
COMPOSED = {
    "lineitem": {"l_orderkey": "bigint", "l_linenumber": "int", "l_partkey": "bigint", "l_suppkey": "bigint", "l_quantity": "double", "l_returnflag": "string"},
    "part_supply": {"ps_partkey": "bigint", "ps_suppkey": "bigint", "lines": "bigint"},
    "return_lines": {"order_key": "bigint", "line_number": "int", "part_key": "bigint", "quantity": "double"},
}


def composite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite keys between lines, returned lines and each part's suppliers."""
    lines = table(spark, sf_dir, "lineitem").select(*COMPOSED["lineitem"])
    frames = {
        "lineitem": lines, "part_supply": lines.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(F.count("*").alias("lines")),
        "return_lines": lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("part_key"), F.col("l_quantity").alias("quantity")),
    }
    edges = joins.discover(frames, catalog.from_frames(spark, frames)).where("kind = 'composite'")
    return edges.select("left_table", F.array_join("left_cols", ",").alias("left_cols"), "right_table", F.array_join("right_cols", ",").alias("right_cols"), "cardinality", "direction", "confidence")


def join_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paths.best_paths(spark, _edges(spark, sf_dir), "orders", "region")
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws(".", s["from"], F.array_join(s["left_cols"], "+"), s["to"], F.array_join(s["right_cols"], "+"))), " ")
    return found.select("place", F.round("cost", 6).alias("cost"), F.round("probability", 6).alias("probability"), F.round("confidence", 6).alias("confidence"), "hops", F.array_join("tables", ">").alias("tables"), steps.alias("steps"))


def declared_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple paths over the declared references, each worth .9 of the share of its rows whose key is found."""
    frames, parts = _tables(spark, sf_dir), []
    for a, b in REFERENCES.items():
        (left, x), (right, y) = a.split("."), b.split(".")
        keys = frames[right].select(F.col(y).alias("k")).distinct().withColumn("found", F.lit(1))
        rows = frames[left].select(F.col(x).alias("k")).where("k is not null").join(keys, "k", "left")
        parts.append(rows.agg((0.9 * F.count("found") / F.count("*")).alias("confidence")).select(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("target")) for s, t in ((left, right), (right, left))]).alias("ends"), "confidence"))
    edges = cut(reduce(DataFrame.unionByName, parts).select(F.inline("ends"), "confidence"), "references")
    found = paths.enumerate_paths(edges)
    return found.select("start", "target", F.array_join("tables", ">").alias("tables"), F.round("cost", 9).alias("cost"), "hops", "place")


def tuple_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples (part, supplier) of lines against (supplier, part) pairs met in other lines, as composite joins compare them."""
    lines = table(spark, sf_dir, "lineitem")
    left = joins.tuple_counts(lines.where("l_returnflag = 'R'"), [(0, ["l_partkey", "l_suppkey"]), (1, ["l_suppkey", "l_linenumber"])])
    right = joins.tuple_counts(lines.where("l_returnflag != 'R'"), [(0, ["l_partkey", "l_suppkey"]), (1, ["l_suppkey", "l_linenumber"])])
    m = joins.tuple_metrics(left, right)
    return m.select("combo", *[F.round(c, 9).alias(c) for c in ("contain", "jacc", "freq", "lu", "ru")])


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings of two target tables over the edges that discovery finds in the data."""
    targets = spark.createDataFrame(TARGETS, "table string, column string, type string, description string")
    return candidates.plan_mappings(targets, _catalog(spark, sf_dir), cut(_edges(spark, sf_dir), "edges"))


def mapping_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_order, loaded by the mappings that were found along the joins that were discovered."""
    kinds = {c: kind for tt, c, kind, _ in TARGETS if tt == "fact_order"}
    return execute.load(_tables(spark, sf_dir), mapping(spark, sf_dir).collect(), "fact_order", kinds)


_DATES, _NUMBERS = ("identity", "parse_date", "substring", "date_part"), ("identity", "round", "scale", "conditional")
_TEXTS, _PAIRS = ("identity", "lower", "upper", "trim", "substring", "split", "regex_extract", "conditional"), ("concat", "format")
_SINGLES = {"orders.o_orderdate": _DATES, "orders.o_totalprice": _NUMBERS, "orders.o_orderpriority": _TEXTS, "orders.o_orderstatus": _TEXTS,
            "customer.c_name": _TEXTS, "customer.c_mktsegment": _TEXTS, "customer.c_acctbal": _NUMBERS, "customer.c_nationkey": _NUMBERS}
_SEVERAL = {("customer.c_name", "customer.c_mktsegment"): _PAIRS, ("orders.o_orderpriority", "orders.o_orderstatus"): _PAIRS, ("orders.o_totalprice", "customer.c_acctbal"): ("arithmetic", "ratio", "currency_convert", "conditional")}
EXECUTED = ("order_year", "segment_lower", "price_hundredth", "customer_label", "priority_end", "price_total")
SAMPLE = 500


def execution_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All templates over columns of orders and customers against samples of six target columns.

    The targets' samples are other rows than the candidates': they are drawn by another salt.
    """
    frames = {n: table(spark, sf_dir, n) for n in ("customer", "orders")}
    o = execution.sample_rows(frames["orders"], ["o_orderkey"], SAMPLE, "target")
    c = execution.sample_rows(frames["customer"], ["c_custkey"], SAMPLE, "target")
    expected = [
        o.select(F.lit("order_year").alias("target"), "pos", F.year("o_orderdate").cast("string").alias("value")), c.select(F.lit("segment_lower"), "pos", F.lower("c_mktsegment")),
        o.select(F.lit("price_hundredth"), "pos", (F.col("o_totalprice") / 100).cast("string")), c.select(F.lit("customer_label"), "pos", F.concat_ws(" ", "c_name", "c_mktsegment")),
        o.select(F.lit("priority_end"), "pos", F.right("o_orderpriority", F.lit(4))), o.select(F.lit("price_total"), "pos", F.col("o_totalprice").cast("string")),
    ]
    tried = [execution.Candidate(t, (r,), f) for t in EXECUTED for r, f in _SINGLES.items()] + [execution.Candidate(t, r, f) for t in EXECUTED for r, f in _SEVERAL.items()]
    way = [paths.Step("orders", "customer", ("o_custkey",), ("c_custkey",), 0.9, "N:1")]
    found = execution.execution_scores(frames, "orders", ["o_orderkey"], way, tried, reduce(DataFrame.union, expected), SAMPLE)
    return found.select("target", "refs", "family", "n", F.round("score", 6).alias("score"))


def star_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _tables(spark, sf_dir)
    step = lambda a, x, b, y: paths.Step(a, b, (x,), (y,), 1.0, "N:1")
    way = [step("orders", "o_custkey", "customer", "c_custkey"), step("customer", "c_nationkey", "nation", "n_nationkey"), step("nation", "n_regionkey", "region", "r_regionkey")]
    return execute.materialize(frames, "orders", [way], {
        "order_key": F.col("orders__o_orderkey"), "customer": t.concat("customer__c_name", "nation__n_name", sep=" / "), "region": F.col("region__r_name"),
        "is_large": t.threshold_flag("orders__o_totalprice", 100000), "segment": t.lower("customer__c_mktsegment")})


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_profile(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as queries, their orders by price as ranked items, open orders as positives."""
    o = table(spark, sf_dir, "orders")
    ranked = o.select(F.col("o_custkey").alias("query"), t.row_number(["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).alias("place"), (F.col("o_orderstatus") == "O").cast("int").alias("label"))
    return metrics.recall_at(ranked, [1, 3, 10]).withColumn("recall", F.round("recall", 9))


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", (F.col("o_totalprice") > 100000).alias("columns_ok"), (F.col("o_custkey") % 2 == 0).alias("transform_ok"))
    return metrics.accuracy(o, ["o_orderpriority", "o_orderstatus"])


def fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cases: the parts of their large lines as predicted columns, those of their cheap lines as expected ones."""
    name = F.concat(F.lit(" S"), (F.col("l_suppkey") % 3).cast("string"), F.lit(".P"), (F.col("l_partkey") % 4).cast("string"))
    sets = lambda kept: F.collect_set(F.when(kept, name))
    cases = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(sets(F.col("l_quantity") > 20).alias("p"), sets(F.col("l_extendedprice") < 40000).alias("e"))
    return cases.select("id", F.round(metrics.fuzzy_columns(F.col("p"), F.col("e")), 6).alias("score"))


def segmented_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names without their spaces, cut into words again by the weights of the words that all names have."""
    part = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).where("name is not null")
    costs = names.weighed_words(part.select(F.explode(F.split("name", "[^a-z]+")).alias("word")).where("word != ''"))
    joined = part.groupBy(F.regexp_replace("name", "[^a-z]", "").alias("token")).agg(F.count("*").alias("n"))
    return joined.select("token", F.array_join(names.segment(F.col("token"), costs), " ").alias("words"), "n")


def monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.monotonic(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]).withColumn("monotonic", F.round("monotonic", 9))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every fiftieth vector as a query that accepts all buckets, and all vectors in buckets by label."""
    rows = table(spark, sf_dir, "embeddings")
    bucket = F.coalesce(F.col("label").cast("string"), F.lit("none"))
    items = rows.select(F.col("vec_id").alias("id"), bucket.alias("bucket"), F.col("embedding").alias("vector"))
    labels = sorted(r.bucket for r in items.select("bucket").distinct().collect())  # as many as there are labels
    every = F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>")
    return rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), every.alias("buckets"), F.col("embedding").alias("vector")), items


def nearest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 50 vectors of each bucket for every fiftieth, merged: all pairs of a query and a row, in blocks."""
    queries, items = _vectors(spark, sf_dir)
    return retrieval.merged(retrieval.search(queries, items, 50), 50).select("query", "id", F.round("similarity", 6).alias("similarity"), "place")


def nearest_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the index of cells."""
    queries, items = _vectors(spark, sf_dir)
    index = retrieval.Index.fit(retrieval.unit(items), 50)
    return retrieval.merged(retrieval.search(queries, items, 50, index), 50).select("query", "id", F.round("similarity", 6).alias("similarity"), "place")


def rejected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON lines, some spoilt by a rule of their ids, and read back with the reasons against each line."""
    rows = table(spark, sf_dir, "conversations").withColumn("kind", (F.col("conv_id") * 7 + F.col("turn")) % 11)
    kind = F.col("kind")
    whole = F.to_json(F.struct(
        F.when(kind != 1, F.col("conv_id")).alias("conv_id"), "turn", F.when(kind == 2, "robot").when(kind == 3, "").when(kind == 4, F.upper("role")).otherwise(F.col("role")).alias("role"),
        F.when(kind != 5, F.length("text")).alias("n")))
    broken = F.when(kind == 6, F.left(whole, F.length(whole) - 4)).when(kind == 7, F.regexp_replace(whole, r'"turn":(\d+)', '"turn":"t$1"')).when(kind == 8, F.concat(F.lit("["), whole, F.lit("]"))).when(kind == 9, "  ").otherwise(whole)
    path = own_path(spark, "lines")
    rows.select(broken.alias("value")).write.text(path)
    checked = catalog.checked_records(
        spark.read.text(path), "conv_id long, turn long, role string, n long", required=["conv_id", "role"], allowed={"role": ["system", "user", "assistant"]}, defaults={"n": -1}, lowered=["role"])
    reason = F.when(F.size("reasons") == 0, "valid").otherwise(F.array_join("reasons", "; "))
    return checked.groupBy(reason.alias("reason"), F.when(F.size("reasons") == 0, F.col("record.role")).alias("role")).agg(
        F.count("*").alias("lines"), F.count_if((F.size("reasons") == 0) & (F.col("record.n") == -1)).alias("defaulted"))


def semantic_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector, drawn towards one of the concepts, as a target of its two successors.

    The first vectors stand for the concepts' descriptions; each row's vector is drawn to the concept that its id names.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n = len(semantics.CONCEPTS)
    seeds = retrieval.unit(rows.where(F.col("vec_id") < n), "v").collect()
    concepts = {semantics.CONCEPTS[r.vec_id]: list(r.v) for r in seeds}
    pull = F.try_element_at(F.from_json(F.lit(json.dumps([concepts.get(c, []) for c in semantics.CONCEPTS])), "array<array<double>>"), (F.col("vec_id") * (F.col("vec_id") + 3) % n + 1).cast("int"))
    drawn = rows.withColumn("v", F.when(F.size(pull) > 0, F.zip_with("v", pull, lambda x, y: x + 1.5 * y)).otherwise(F.col("v")))
    scored = semantics.concept_scores(retrieval.unit(drawn, "v"), concepts, "v")
    scored = cut(scored, "concepts")
    other = scored.select(F.explode(F.array(F.col("vec_id") - 1, F.col("vec_id") - 2)).alias("vec_id"), F.col("concepts").alias("sc"), F.col("v").alias("sv"))
    met = scored.join(other, "vec_id").withColumn("similarity", semantics.dot(F.col("v"), F.col("sv")))
    affinity = semantics.cross_type_affinity(F.col("concepts"), F.col("sc"), F.col("similarity"))
    told = met.groupBy("vec_id").agg(F.max(affinity).alias("affinity"), F.collect_list(F.struct(F.col("sc").alias("concepts"), "similarity")).alias("sources"))
    out = scored.join(told, "vec_id").withColumn("best", semantics.best_concepts(F.col("concepts"), 1)[0])
    return out.select("vec_id", F.col("best.concept").alias("concept"), F.round("best.score", 6).alias("score"), F.array_join(semantics.target_roles(F.col("concepts")), ",").alias("roles"),
                      F.round("affinity", 6).alias("affinity"), F.round(semantics.role_compatibility(F.col("concepts"), F.col("sources")), 6).alias("role_score"))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' and customers' nations: in both, in either only, and all."""
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = [("both", c.intersect(s)), ("customers", c.subtract(s)), ("all", c.union(s).distinct())]
    return reduce(DataFrame.unionAll, [d.select(F.lit(n).alias("part"), "k") for n, d in parts])


def legacy_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    big, late = legacy.compare("o_totalprice", "gte", 100000), legacy.conditional_recent("o_orderdate", "1997-01-01")
    return o.select(
        "o_orderkey", big.alias("gte"), legacy.and_op(big, late).alias("both"), legacy.or_op(big, late).alias("any"), legacy.not_op(big).alias("small"), legacy.cast_to_int("o_totalprice").alias("whole"),
        legacy.cast_to_decimal("o_totalprice").cast("string").alias("cents"), legacy.add_days("o_orderdate", 10).cast("string").alias("later"), legacy.concat_with("-", "o_orderstatus", "o_orderpriority").alias("dashed"),
        legacy.trim_upper("o_orderpriority").alias("loud"), legacy.conditional_bucket("o_totalprice", 50000, "low", "high").alias("bucket"), legacy.date_to_quarter_format("o_orderdate").alias("quarter"))


def synthetic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import transform_queries as tq

    labels = sorted([*tq.ROWS, *tq.GROUPED, *tq.FRAMES])
    return synthesis.split(synthesis.records(spark, labels, 25, 25), "target")


SPARK = {
    "legacy_operators": legacy_operators, "synthetic_records": synthetic_records,
    "profile_columns": profile_columns, "most_common_values": most_common_values, "value_histogram": value_histogram, "shared_values": shared_values, "value_scores": value_scores,
    "name_scores": name_scores, "join_edges": join_edges, "composite_edges": composite_edges, "join_paths": join_paths, "declared_paths": declared_paths, "tuple_overlap": tuple_overlap, "mapping": mapping, "mapping_load": mapping_load, "execution_scores": execution_scores,
    "star_load": star_load, "event_windows": event_windows, "recall_at_k": recall, "accuracy_rollup": accuracy, "fuzzy_columns": fuzzy, "monotonic": monotonic, "semantic_roles": semantic_roles, "rejected_records": rejected_records, "segmented_names": segmented_names, "nearest_exact": nearest_exact, "nearest_indexed": nearest_indexed, "set_operations": set_operations, "flagship": flagship,
}



def _synthetic_sql() -> str:
    from . import transform_queries as tq

    lists = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    labels, nouns, prefixes = sorted([*tq.ROWS, *tq.GROUPED, *tq.FRAMES]), synthesis.NOUNS, synthesis.PREFIXES
    fields, kinds = [f for f, _ in synthesis.FIELDS], [k for _, k in synthesis.FIELDS]
    draw = lambda key, salt, n: f"(('0x' || substr(md5('{salt}|' || {key}), 1, 8))::BIGINT % {n})::INT"
    k = "('7:' || id)"
    n, f = len(nouns), len(fields)
    return f"""
        WITH r AS (SELECT i AS id, ({lists(labels)})[(i // 50 + 1)::INT] AS label, i % 50 AS pos FROM range({len(labels) * 50}) t(i)),
        d AS (SELECT id, label, {draw(k, 'noun', n)} AS noun, {draw(k, 'field', f)} AS field, {draw(k, 'prefix', len(prefixes))} AS p, {draw(k, 'n', n - 1)} AS dn, {draw(k, 'f', f - 1)} AS df,
              CASE WHEN pos < 25 THEN 'positive' WHEN {draw(k, 'kind', 100)} < 40 THEN 'easy' WHEN {draw(k, 'kind', 100)} < 70 THEN 'hard' ELSE 'crossed' END AS kind FROM r),
        e AS (SELECT *, CASE WHEN kind IN ('positive', 'crossed') THEN noun ELSE (noun + 1 + dn) % {n} END AS sn, CASE WHEN kind IN ('positive', 'hard') THEN field ELSE (field + 1 + df) % {f} END AS sf FROM d),
        g AS (SELECT id, label, ({lists(nouns)})[noun + 1] || '_' || ({lists(fields)})[field + 1] AS target, ({lists(prefixes)})[p + 1] || ({lists(nouns)})[sn + 1] || '_' || ({lists(fields)})[sf + 1] AS source,
              ({lists(kinds)})[sf + 1] AS source_type, ({lists(kinds)})[field + 1] AS target_type, kind = 'positive' AS positive, kind FROM e)
        SELECT *, CASE WHEN {draw('target', 'split', 100)} < 85 THEN 'train' ELSE 'val' END AS split FROM g"""


_NULLS = "('', 'null', 'none', 'nan', 'na', 'n/a', 'nil')"


def _cells_sql(wanted: dict = WANTED, sources: dict[str, str] | None = None) -> str:
    one = lambda n, c: f"SELECT '{n}' AS \"table\", '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM {(sources or {}).get(n, n)}"
    union = " UNION ALL ".join(one(n, c) for n, cs in wanted.items() for c in cs)
    return f"""cells AS ({union}),
        norm AS (SELECT "table", "column", CASE WHEN v IS NULL OR lower(trim(v)) IN {_NULLS} THEN NULL ELSE trim(regexp_replace(lower(v), '\\s+', ' ', 'g')) END AS value FROM cells),
        counts AS (SELECT "table", "column", value, TRY_CAST(regexp_replace(replace(value, ',', ''), '%$', '') AS DOUBLE) AS number, count(*) AS n FROM norm GROUP BY ALL)"""


_CATALOG = [(n, c, kind, KEYS.get(n) == c, f"{n}.{c}" in REFERENCES) for n, cs in SCHEMA.items() for c, kind in cs.items()]
_DECLARED = " UNION ALL ".join(
    f"SELECT '{a.split('.')[0]}', '{b.split('.')[0]}', 0.9::DOUBLE * count(*) FILTER ({a.split('.')[1]} IN (SELECT {b.split('.')[1]} FROM {b.split('.')[0]})) / count({a.split('.')[1]}) FROM {a.split('.')[0]}" for a, b in REFERENCES.items())


def _composite_sql() -> str:
    """The edges of COMPOSED's tables, each given as a query in place of a table."""
    renamed = {"order_key": "l_orderkey", "line_number": "l_linenumber", "part_key": "l_partkey", "quantity": "l_quantity"}
    sources = {
        "lineitem": "lineitem", "part_supply": "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, count(*) AS lines FROM lineitem GROUP BY ALL)",
        "return_lines": "(SELECT " + ", ".join(f"{c} AS {n}" for n, c in renamed.items()) + " FROM lineitem WHERE l_returnflag = 'R')",
    }
    declared = [(t, c, kind, False, False) for t, cs in COMPOSED.items() for c, kind in cs.items()]
    tail = f", {matcher_sql.composite_ctes(declared, sources)} SELECT left_table, left_cols, right_table, right_cols, cardinality, direction, confidence FROM composites"
    return matcher_sql.join_edges(_cells_sql(COMPOSED, sources), declared, tail)


SQL = {
    "value_scores": matcher_sql.value_scores(_cells_sql()),
    "name_scores": matcher_sql.name_scores([c for cs in WANTED.values() for c in cs], NAMED),
    "execution_scores": matcher_sql.execution_scores(EXECUTED, _SINGLES, _SEVERAL, SAMPLE),
    "join_edges": matcher_sql.join_edges(_cells_sql(), _CATALOG, f", {matcher_sql.composite_ctes(_CATALOG)} SELECT * FROM final UNION ALL SELECT * FROM composites"),
    "composite_edges": _composite_sql(),
    "join_paths": matcher_sql.best_paths(_cells_sql(), _CATALOG, "orders", "region"),
    "legacy_operators": """
        SELECT o_orderkey, o_totalprice >= 100000 AS gte, o_totalprice >= 100000 AND o_orderdate >= TIMESTAMP '1997-01-01' AS both, o_totalprice >= 100000 OR o_orderdate >= TIMESTAMP '1997-01-01' AS any,
               NOT o_totalprice >= 100000 AS small, trunc(o_totalprice)::BIGINT AS whole, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS cents, CAST(CAST(o_orderdate AS DATE) + 10 AS VARCHAR) AS later,
               concat_ws('-', o_orderstatus, o_orderpriority) AS dashed, upper(trim(o_orderpriority)) AS loud, CASE WHEN o_totalprice < 50000 THEN 'low' ELSE 'high' END AS bucket,
               concat(year(o_orderdate), '-Q', quarter(o_orderdate)) AS quarter FROM orders""",
    "synthetic_records": _synthetic_sql(),
    "profile_columns": f"""
        WITH {_cells_sql()},
        rows AS (SELECT "table", "column", value, TRY_CAST(regexp_replace(replace(value, ',', ''), '%$', '') AS DOUBLE) AS number FROM norm),
        totals AS (SELECT "table", "column", count(*) AS total_rows, count(value) AS valid_count,
                   CASE WHEN count(value) = 0 THEN 'unknown' WHEN count(number) >= 0.97 * count(value) THEN 'numeric' ELSE 'categorical' END AS kind FROM rows GROUP BY ALL),
        entropy AS (SELECT "table", "column", -sum(n / valid_count * ln(n / valid_count + 1e-12)) AS entropy FROM counts JOIN totals USING ("table", "column") WHERE value IS NOT NULL GROUP BY ALL)
        SELECT "table", "column", total_rows, valid_count, kind, CASE WHEN kind = 'numeric' THEN count(DISTINCT number) ELSE count(DISTINCT value) END AS n_distinct,
               round((total_rows - valid_count) / total_rows, 6) AS null_frac,
               round(CASE WHEN kind = 'numeric' THEN count(DISTINCT number) ELSE count(DISTINCT value) END / valid_count, 6) AS distinct_ratio,
               round(CASE WHEN kind = 'numeric' THEN 0.0::DOUBLE ELSE any_value(entropy) END, 6) AS entropy,
               round(CASE WHEN kind = 'numeric' THEN min(number) END, 6) AS min, round(CASE WHEN kind = 'numeric' THEN max(number) END, 6) AS max,
               round(CASE WHEN kind = 'categorical' THEN avg(length(value)) ELSE 0.0::DOUBLE END, 6) AS avg_len, round(CASE WHEN kind = 'categorical' THEN stddev_pop(length(value)) ELSE 0.0::DOUBLE END, 6) AS std_len,
               round(CASE WHEN kind = 'numeric' THEN avg(CASE WHEN number = floor(number) THEN 1.0::DOUBLE ELSE 0 END) ELSE 0.0::DOUBLE END, 6) AS integer_ratio,
               round(CASE WHEN kind = 'numeric' THEN quantile_cont(number, 0.05) END, 6) AS q05, round(CASE WHEN kind = 'numeric' THEN quantile_cont(number, 0.5) END, 6) AS q50,
               round(CASE WHEN kind = 'numeric' THEN quantile_cont(number, 0.95) END, 6) AS q95
        FROM rows JOIN totals USING ("table", "column") JOIN entropy USING ("table", "column") GROUP BY "table", "column", total_rows, valid_count, kind""",
    "most_common_values": f"""
        WITH {_cells_sql()}
        SELECT "table", "column", value, n, round(n / sum(n) OVER (PARTITION BY "table", "column"), 9) AS frequency,
               CAST(row_number() OVER (PARTITION BY "table", "column" ORDER BY n DESC, value) AS INT) AS place
        FROM counts WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY "table", "column" ORDER BY n DESC, value) <= 10""",
    "value_histogram": f"""
        WITH {_cells_sql()},
        e AS (SELECT "table", "column", min(number) AS lo, max(number) AS hi FROM counts WHERE number IS NOT NULL GROUP BY ALL)
        SELECT "table", "column", coalesce(CAST(least(floor((number - lo) * 20 / nullif(hi - lo, 0)), 19) AS INT), 0) AS bin, sum(n)::BIGINT AS n
        FROM counts JOIN e USING ("table", "column") WHERE number IS NOT NULL GROUP BY ALL""",
    "shared_values": f"""
        WITH {_cells_sql()}, v AS (SELECT DISTINCT "table" AS t, "column" AS c, number FROM counts WHERE "column" IN ('c_nationkey', 'n_nationkey', 'o_custkey', 'c_custkey', 'n_regionkey', 'r_regionkey'))
        SELECT a.t AS lt, a.c AS lc, b.t AS rt, b.c AS rc, count(*) AS shared FROM v a JOIN v b ON a.number = b.number AND a.t < b.t GROUP BY ALL""",
    "tuple_overlap": """
        WITH k AS (SELECT 0 AS combo, concat(l_partkey, '|', l_suppkey) AS key, l_returnflag = 'R' AS is_left FROM lineitem UNION ALL SELECT 1, concat(l_suppkey, '|', l_linenumber), l_returnflag = 'R' FROM lineitem),
        c AS (SELECT combo, key, count(*) FILTER (is_left) AS l, count(*) FILTER (NOT is_left) AS r FROM k GROUP BY ALL),
        s AS (SELECT combo, count(*) FILTER (l > 0 AND r > 0) AS shared, count(*) FILTER (l > 0) AS ld, count(*) FILTER (r > 0) AS rd, sum(l) AS la, sum(r) AS ra, sum(least(l, r)) AS low FROM c GROUP BY combo)
        SELECT combo, round(shared / least(ld, rd), 9) AS contain, round(shared / (ld + rd - shared), 9) AS jacc, round(low / (la + ra - low), 9) AS freq, round(ld / la, 9) AS lu, round(rd / ra, 9) AS ru FROM s""",
    "declared_paths": f"""
        WITH RECURSIVE one(source, target, c) AS ({_DECLARED}),
        e AS (SELECT source, target, -ln(c * 0.97) AS step FROM one UNION ALL SELECT target, source, -ln(c * 0.97) FROM one),
        p AS (SELECT source AS start, target, [source, target] AS tables, step AS cost, 1 AS hops FROM e
              UNION ALL SELECT p.start, e.target, list_append(p.tables, e.target), p.cost + e.step, p.hops + 1 FROM p JOIN e ON p.target = e.source WHERE NOT list_contains(p.tables, e.target) AND p.hops < 3)
        SELECT start, target, array_to_string(tables, '>') AS tables, round(cost, 9) AS cost, hops, CAST(row_number() OVER (PARTITION BY start, target ORDER BY round(cost, 9), tables) AS INT) AS place FROM p""",
    "mapping_load": """
        SELECT o_orderkey AS order_key, c_name AS customer_name, o_orderstatus AS order_status, o_totalprice AS total_price, n_name AS nation_name
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "star_load": """
        SELECT o_orderkey AS order_key, concat_ws(' / ', c_name, n_name) AS customer, r_name AS region, o_totalprice > 100000 AS is_large, lower(c_mktsegment) AS segment
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "event_windows": """
        SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, count(DISTINCT user_id) AS users, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY ALL""",
    "recall_at_k": """
        WITH r AS (SELECT o_custkey AS q, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, o_orderstatus = 'O' AS hit FROM orders),
        f AS (SELECT q, min(place) FILTER (hit) AS first FROM r GROUP BY q)
        SELECT k, round(avg(CASE WHEN first <= k THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall FROM f, (VALUES (1), (3), (10)) v(k) GROUP BY k""",
    "accuracy_rollup": """
        WITH c AS (SELECT o_orderpriority, o_orderstatus, o_totalprice > 100000 AS a, o_custkey % 2 = 0 AS b FROM orders)
        SELECT o_orderpriority, o_orderstatus, count(*) AS cases, round(avg(a::INT), 4) AS column_accuracy, round(avg(b::INT), 4) AS transform_accuracy, round(avg((a AND b)::INT), 4) AS joint_accuracy
        FROM c GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""",
    "fuzzy_columns": """
        WITH n AS (SELECT l_orderkey AS id, concat('s', l_suppkey % 3, '.p', l_partkey % 4) AS c, l_quantity > 20 AS is_p, l_extendedprice < 40000 AS is_e FROM lineitem),
        s AS (SELECT id, coalesce(list_sort(list(DISTINCT c) FILTER (is_p)), []) AS p, coalesce(list_sort(list(DISTINCT c) FILTER (is_e)), []) AS e FROM n GROUP BY id),
        t AS (SELECT *, list_sort(list_transform(p, lambda x: split_part(x, '.', 1))) AS pt, list_sort(list_transform(e, lambda x: split_part(x, '.', 1))) AS et, len(list_intersect(p, e))::DOUBLE AS shared FROM s)
        SELECT id, round(CASE WHEN p = e THEN 1.0::DOUBLE WHEN len(pt) > 0 AND pt = et THEN 0.5::DOUBLE ELSE (shared / greatest(len(p), 1) + shared / greatest(len(e), 1)) / 4 END, 6) AS score FROM t""",
    "monotonic": """
        WITH s AS (SELECT l_extendedprice - lag(l_extendedprice) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS step FROM lineitem)
        SELECT round(greatest(count(*) FILTER (step >= 0), count(*) FILTER (step <= 0)) / count(step), 9) AS monotonic FROM s""",
    "nearest_exact": """
        WITH s AS (
          SELECT q.vec_id AS query, e.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS similarity
          FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)
        SELECT query, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id)::INT AS place
        FROM s QUALIFY place <= 50""",
    "segmented_names": """
        SELECT regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS token, array_to_string(list_filter(string_split_regex(lower(p_name), '[^a-z]+'), lambda w: w <> ''), ' ') AS words, count(*) AS n
        FROM part WHERE p_name IS NOT NULL GROUP BY ALL""",
    "rejected_records": """
        WITH c AS (SELECT *, (conv_id * 7 + turn) % 11 AS kind FROM conversations),
        t AS (SELECT CASE kind WHEN 1 THEN 'missing conv_id' WHEN 2 THEN 'invalid role: robot' WHEN 3 THEN 'missing role' WHEN 6 THEN 'malformed' WHEN 7 THEN 'malformed' WHEN 8 THEN 'malformed' ELSE 'valid' END AS reason, role, kind
              FROM c WHERE kind <> 9)
        SELECT reason, CASE WHEN reason = 'valid' THEN role END AS role, count(*) AS lines, count(*) FILTER (reason = 'valid' AND kind = 5) AS defaulted FROM t GROUP BY ALL""",
    "semantic_roles": matcher_sql.semantic_roles(semantics.CONCEPTS),
    "set_operations": """
        SELECT 'both' AS part, * FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
        UNION ALL SELECT 'customers', * FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
        UNION ALL SELECT 'all', * FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""",
    "flagship": """
        SELECT o_orderkey AS order_key, c_name AS customer_name, CAST(year(o_orderdate) AS INT) AS order_year, o_orderstatus = 'O' AS is_open FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"match_{k}": f for k, f in SPARK.items()}


def oracle_sql() -> dict[str, str]:
    return {f"match_{k}": s for k, s in SQL.items()}
