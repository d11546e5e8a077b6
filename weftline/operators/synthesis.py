"""Synthetic labelled records, made by ranges and hashes so that the same seed gives the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Nouns and endings of column names, and conventions of writing them.
NOUNS = ("customer", "order", "product", "invoice", "employee", "account", "shipment", "payment", "store", "region", "vendor", "ticket")
FIELDS = (("name", "string"), ("code", "string"), ("amount", "decimal"), ("count", "int"), ("date", "date"), ("status", "string"), ("rate", "decimal"), ("flag", "boolean"))
PREFIXES = ("", "src_", "raw_", "stg_", "dim_")
#: Of a hundred negatives: easy ones (another noun and type), hard ones (same type) and crossed ones (another type, same noun).
EASY, HARD = 40, 30


def draw(key: Column, salt: str, n: int) -> Column:
    """A number from 0 to n - 1, from the first 32 bits of an MD5."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt + "|"), key.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def _pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def records(spark: SparkSession, labels: list[str], positives: int, negatives: int, seed: str = "7") -> DataFrame:
    """(id, label, target, source, source_type, target_type, positive, kind): for each label so many positives and negatives."""
    per = positives + negatives
    rows = spark.range(len(labels) * per).withColumn("label", _pick(tuple(labels), F.floor(F.col("id") / per).cast("int")))
    at = F.pmod(F.col("id"), F.lit(per))
    key = F.concat(F.lit(seed + ":"), F.col("id").cast("string"))
    noun, field = draw(key, "noun", len(NOUNS)), draw(key, "field", len(FIELDS))
    chance = draw(key, "kind", 100)
    kind = F.when(at < positives, "positive").when(chance < EASY, "easy").when(chance < EASY + HARD, "hard").otherwise("crossed")
    other_noun, other_field = F.pmod(noun + 1 + draw(key, "n", len(NOUNS) - 1), F.lit(len(NOUNS))), F.pmod(field + 1 + draw(key, "f", len(FIELDS) - 1), F.lit(len(FIELDS)))
    rows = rows.select("id", "label", kind.alias("kind"), noun.alias("noun"), field.alias("field"), other_noun.alias("n2"), other_field.alias("f2"), draw(key, "prefix", len(PREFIXES)).alias("p"))
    s_noun = F.when(F.col("kind").isin("positive", "crossed"), F.col("noun")).otherwise(F.col("n2"))
    s_field = F.when(F.col("kind").isin("positive", "hard"), F.col("field")).otherwise(F.col("f2"))
    names, types = tuple(f for f, _ in FIELDS), tuple(k for _, k in FIELDS)
    return rows.select(
        "id", "label", F.concat_ws("_", _pick(NOUNS, F.col("noun")), _pick(names, F.col("field"))).alias("target"),
        F.concat(_pick(PREFIXES, F.col("p")), _pick(NOUNS, s_noun), F.lit("_"), _pick(names, s_field)).alias("source"),
        _pick(types, s_field).alias("source_type"), _pick(types, F.col("field")).alias("target_type"), (F.col("kind") == "positive").alias("positive"), "kind")


def conventions(name: Column) -> Column:
    """A snake-case name in other conventions: snake, camel, Pascal, joined, upper."""
    parts = F.split(name, "_")
    pascal = F.array_join(F.transform(parts, F.initcap), "")
    return F.array(name, F.concat(F.lower(F.left(pascal, F.lit(1))), F.substring(pascal, 2, 1_000_000)), pascal, F.array_join(parts, ""), F.upper(name))


def boundaries(parts: Column) -> tuple[Column, Column]:
    """(text, labels): the parts joined, and for each character 1 where a part ends, else 0."""
    text = F.array_join(parts, "")
    labels = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(1), F.char_length(p)), lambda i: (i == F.char_length(p)).cast("int"))))
    return text, labels


def chat(records: DataFrame) -> DataFrame:
    """Records as prompts and answers."""
    prompt = F.concat(F.lit("Target: "), "target", F.lit(" ("), "target_type", F.lit(")\nCandidate: "), "source", F.lit(" ("), "source_type", F.lit(")"))
    return records.select("id", prompt.alias("prompt"), F.when(F.col("positive"), F.concat(F.lit("MATCH "), "label")).otherwise("NO MATCH").alias("answer"))


def split(records: DataFrame, key: str, train: int = 85) -> DataFrame:
    """Adds split, train or val, by a hash of the key, so that equal keys go together."""
    return records.withColumn("split", F.when(draw(F.col(key), "split", 100) < train, "train").otherwise("val"))
