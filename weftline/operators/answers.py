"""Prompts for a language model that maps columns, and its answers read and checked against the catalog.

The model itself is outside: any job that turns prompt into response fits between the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import type_bucket
from ..sources.catalog import schema_text
from .semantics import of

#: Confidence of an answer that names a known column, and of any other.
READ, UNREAD = 0.90, 0.10


def prompts(targets: DataFrame, columns: DataFrame, edges: DataFrame) -> DataFrame:
    """(table, column, prompt): the source schema, its joins and the target's line. The schema is as small as the catalog."""
    tables = [r.text for r in schema_text(columns).orderBy("table").collect()]
    ends = lambda t, cs: F.transform(cs, lambda c: F.concat(F.col(t), F.lit("."), c))
    joins = F.zip_with(ends("left_table", F.col("left_cols")), ends("right_table", F.col("right_cols")), lambda a, b: F.concat(a, F.lit(" = "), b))
    lines = sorted({line for r in edges.select(joins.alias("lines")).collect() for line in r.lines})
    head = "Source Schema:\n" + "\n".join(f"  {t}" for t in tables) + "\n\nJoins:\n" + "\n".join(f"  {x}" for x in lines) + "\n\n"
    told = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(' - "'), "description", F.lit('"'))).otherwise("")
    line = F.concat(F.lit("Map target: "), "table", F.lit("."), "column", F.lit(" ("), "type", F.lit(")"), told)
    return targets.select("table", "column", F.concat(F.lit(head), line).alias("prompt"))


def _named(word: Column, known: list[str], otherwise: Column) -> Column:
    """The known word that word is, or else the first of which one begins the other."""
    every = F.array(*map(F.lit, known))
    near = F.filter(every, lambda k: word.startswith(k) | k.startswith(word))
    return F.when(word.isNull() | (word == ""), F.lit(None)).when(F.array_contains(every, word), word).otherwise(F.coalesce(F.get(near, F.lit(0)), otherwise))


def parsed(answers: DataFrame, transforms: list[str], operations: list[str], response: str = "response") -> DataFrame:
    """answers with source_columns, transform_type, sub_operation and reasoning, read from lines "name: value"."""
    text = F.coalesce(F.col(response), F.lit(""))
    part = lambda pattern: F.trim(F.regexp_extract(text, pattern, 1))
    refs = F.transform(F.split(part(r"(?i)source_columns?\s*:\s*([^\n]+)"), ","), lambda c: F.regexp_replace(F.trim(c), r"\.+$", ""))
    refs = F.filter(refs, lambda c: (F.size(F.split(c, r"\.")) == 2))
    transform, operation = F.lower(part(r"(?i)transform_type\s*:\s*(\S+)")), F.lower(part(r"(?i)sub_operation\s*:\s*(\S+)"))
    return answers.select(
        "*", refs.alias("source_columns"), F.coalesce(_named(transform, transforms, F.lit(None)), F.lit("unmapped")).alias("transform_type"),
        F.coalesce(_named(operation, operations, operation), F.lit("")).alias("sub_operation"), part(r"(?is)reasoning\s*:\s*(.+)").alias("reasoning"))


def validated(answers: DataFrame, columns: DataFrame, key: list[str]) -> DataFrame:
    """parsed() answers with only the columns that the catalog has, in their order, parse_success and confidence.

    key names the columns that identify an answer. Columns meet the catalog by an equi-join on their names.
    """
    each = answers.select(*key, F.posexplode("source_columns").alias("at", "ref"))
    real = columns.select(F.concat_ws(".", "table", "column").alias("ref")).distinct()
    kept = each.join(real, "ref").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda x: x["ref"]).alias("_kept"))
    out = answers.join(kept, key, "left").withColumn("source_columns", F.coalesce("_kept", F.array().cast("array<string>"))).drop("_kept")
    success = F.size("source_columns") > 0
    return out.withColumns({"parse_success": success, "confidence": F.when(success, READ).otherwise(UNREAD)})


def composite_possible(target_type: Column, currency_like: Column, sources: Column) -> Column:
    """Whether several columns can make a target at all. sources: array of structs (type, valid_count, concepts).

    A number needs a number or a date, an amount in a currency an amount and its rate or currency, a date a date or a
    text, a flag some column with values.
    """
    target = type_bucket(target_type)
    of_type = lambda *kinds: F.exists(sources, lambda s: type_bucket(s["type"]).isin(*kinds))
    about = lambda c, least: F.exists(sources, lambda s: of(s["concepts"], c) > least)
    priced = about("monetary", 0.38) & (about("exchange_rate", 0.35) | about("currency", 0.35))
    number = of_type("numeric", "date") & (~F.coalesce(currency_like, F.lit(False)) | (F.size(sources) < 2) | priced)
    possible = F.when(target == "numeric", number).when(target == "date", of_type("date", "string"))
    return (F.size(sources) > 0) & possible.when(target == "boolean", F.exists(sources, lambda s: F.coalesce(s["valid_count"], F.lit(0)) > 0)).otherwise(True)
