"""The catalog: declared columns of tables, from JSON or from data frames, as a frame with one row per column."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = (
    "table string, column string, ordinal int, type string, nullable boolean, is_pk boolean, is_fk boolean, is_unique boolean, "
    "enum array<string>, regex string, min double, max double, description string"
)
JSON = (
    "name string, columns array<struct<name:string,type:string,nullable:boolean,is_pk:boolean,is_fk:boolean,is_unique:boolean,description:string,"
    "enum:array<string>,regex:string,min:double,max:double>>, sample_data array<map<string,string>>"
)


def from_json_tables(tables: DataFrame) -> DataFrame:
    """Rows of the JSON form (name, columns, sample_data) as catalog rows. A primary key is unique; types default to string."""
    each = tables.select(F.col("name").alias("table"), F.posexplode("columns").alias("ordinal", "c"))
    no = F.lit(False)
    return each.select(
        "table", F.col("c.name").alias("column"), "ordinal", F.coalesce("c.type", F.lit("string")).alias("type"), F.coalesce("c.nullable", F.lit(True)).alias("nullable"),
        F.coalesce("c.is_pk", no).alias("is_pk"), F.coalesce("c.is_fk", no).alias("is_fk"),
        (F.coalesce("c.is_unique", no) | F.coalesce("c.is_pk", no)).alias("is_unique"), "c.enum", "c.regex", "c.min", "c.max", "c.description",
    )


def read_json_tables(spark: SparkSession, path: str) -> DataFrame:
    """A file of one JSON list of tables, or of one table a line."""
    return spark.read.schema(JSON).option("multiLine", True).json(path)


def json_tables(spark: SparkSession, tables: list[dict]) -> DataFrame:
    """The same from Python values, as a request would carry them."""
    return spark.createDataFrame([json.dumps(t) for t in tables], "string").select(F.from_json("value", JSON).alias("t")).select("t.*")


def sample_frames(spark: SparkSession, tables: list[dict]) -> dict[str, DataFrame]:
    """Each table's sample rows as a frame of strings."""
    out = {}
    for t in tables:
        names = [c["name"] for c in t["columns"]]
        rows = [[None if r.get(n) is None else str(r[n]) for n in names] for r in t.get("sample_data") or []]
        out[t["name"]] = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    return out


# Spark's type names as declared types.
_SPARK_TYPES = {"bigint": "bigint", "int": "int", "smallint": "smallint", "double": "double", "float": "float", "string": "string", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp"}


def from_frames(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, str] | None = None, references: dict[str, str] | None = None) -> DataFrame:
    """Catalog of frames. keys names each table's primary key; references maps "table.column" to "table.column"."""
    keys, references, rows = keys or {}, references or {}, []
    for name, df in sorted(tables.items()):
        for i, (c, kind) in enumerate(df.dtypes):
            declared = "decimal" if kind.startswith("decimal") else _SPARK_TYPES.get(kind, kind)
            pk, fk = keys.get(name) == c, f"{name}.{c}" in references
            rows.append((name, c, i, declared, not pk, pk, fk, pk, None, None, None, None, None))
    return spark.createDataFrame(rows, COLUMNS)


def summary(columns: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row per table: its columns in order and their number, with row counts if given as (table, row_count)."""
    out = columns.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("ordinal", "column", "type", "is_pk", "is_fk"))).alias("columns"), F.count("*").alias("n_columns"))
    return out if rows is None else out.join(rows, "table", "left")


def schema_text(columns: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(table, text): table(column type PK, ...) for prompts and logs; with edges, its joins below, sorted and each once."""
    mark = F.concat_ws(" ", "column", "type", F.when(F.col("is_pk"), "PK"), F.when(F.col("is_fk"), "FK"))
    lines = columns.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("ordinal", mark.alias("m")))).alias("c"))
    out = lines.select("table", F.concat("table", F.lit("("), F.array_join(F.col("c.m"), ", "), F.lit(")")).alias("text"))
    if edges is None:
        return out
    end = lambda t, cs: F.transform(cs, lambda c: F.concat(F.col(t), F.lit("."), c))
    joins = F.zip_with(end("left_table", F.col("left_cols")), end("right_table", F.col("right_cols")), lambda a, b: F.concat(a, F.lit(" = "), b))
    told = edges.select(F.explode(F.array("left_table", "right_table")).alias("table"), F.array_join(joins, " AND ").alias("line"))
    told = told.groupBy("table").agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("lines"))
    return out.join(told, "table", "left").select("table", F.concat_ws("\n", "text", "lines").alias("text"))


def checked_records(
    lines: DataFrame, schema: str, required: list[str] = (), allowed: dict[str, list] | None = None, defaults: dict | None = None, lowered: list[str] = ()
) -> DataFrame:
    """JSON lines (column value) as (line, reasons, record); blank lines are skipped, reasons is empty for a valid line.

    A line that is no JSON object, or has a value that does not fit its field's type, is malformed. Fields without a
    value get their default; those named in lowered are lower-cased. A required field must then have a value, not empty
    for text, and fields in allowed one of theirs. Reasons come in that order, fields in the schema's order.
    """
    record = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.where(F.col("value").rlike(r"\S")).select(F.col("value").alias("line"), record.alias("r"))
    fields = [f for f in parsed.schema["r"].dataType.names if f != "_corrupt"]

    def field(name: str) -> Column:
        c = F.col(f"r.{name}")
        c = F.coalesce(c, F.lit((defaults or {})[name])) if name in (defaults or {}) else c
        return F.lower(c) if name in lowered else c

    broken = ~F.col("line").rlike(r"^\s*\{") | F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    filled = parsed.select("line", broken.alias("broken"), F.struct(*[field(f).alias(f) for f in fields]).alias("record"))
    reasons = [F.when(F.col("broken"), "malformed")]
    for f in fields:
        c = F.col(f"record.{f}")
        empty = c.isNull() | (c.cast("string") == "")
        if f in required:
            reasons.append(F.when(~F.col("broken") & empty, f"missing {f}"))
        if f in (allowed or {}):
            reasons.append(F.when(~F.col("broken") & ~empty & ~c.isin(list(allowed[f])), F.concat(F.lit(f"invalid {f}: "), c.cast("string"))))
    return filled.select("line", F.array_compact(F.array(*reasons)).alias("reasons"), "record")


def read_records(spark: SparkSession, path: str, schema: str, **rules) -> tuple[DataFrame, DataFrame]:
    """A file or folder of JSON lines as (valid, rejected): records as columns, and lines with the reasons against them."""
    checked = checked_records(spark.read.text(path), schema, **rules)
    return checked.where(F.size("reasons") == 0).select("record.*"), checked.where(F.size("reasons") > 0).select("line", "reasons")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without rules: every line that is an object of the schema's types; others fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls left out."""
    df.write.json(path)


def union_records(parts: list[DataFrame], label: str, aliases: dict[str, str], seed: int) -> DataFrame:
    """Datasets united by name, old labels renamed, in an order that the seed alone fixes."""
    from functools import reduce

    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    named = every if known is None else every.withColumn(label, F.coalesce(F.try_element_at(known, F.col(label)), F.col(label)))
    return named.orderBy(F.xxhash64(F.to_json(F.struct(*named.columns)), F.lit(seed)))


def edges_json(edges: DataFrame) -> DataFrame:
    """Edges as JSON lines, the confidence in three decimals."""
    return edges.withColumn("confidence", F.round("confidence", 3)).select(F.to_json(F.struct("*")).alias("value"))
