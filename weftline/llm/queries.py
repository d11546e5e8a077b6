"""The thin queries opN_<name>: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_bpe, conversation_repair, exact_dedup, filter_audit, html_extract, license_scan, line_dedup, mixing, quality_rules, sharding, simhash, toxicity
from .common import held, read_table

BPE_FILE = "word_bpe_49k.json"
RANK_FILE = "byte_bpe_multi_50k.tiktoken"
SHARDS = 40


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(BPE_FILE)


def byte_bpe_file() -> tuple[str, str]:
    """The rank file's path and the pattern that cuts words."""
    import public_tokenizers

    return public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    left = line_dedup.dedup_lines(docs)
    text = F.coalesce("text", F.lit(""))
    return left.select("doc_id", "n_lines", "n_kept", F.char_length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sizes = held(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")))
    plan = mixing.planned(sizes, size=F.col("size")).select("doc_id", "_mix.*").drop("copies")
    return plan.orderBy("position", "doc_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest_documents(docs, bpe_path()).drop("text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).drop("text")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    # two snapshots and the batch after them, dealt by the id's hash; all rows are in one of them
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    return exact_dedup.dedup(docs, arrival, 3).drop("snapshot")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.with_quality(docs).drop("text")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), SHARDS)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.summarise_repairs(conversation_repair.damaged(rows))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, read_table(spark, sf_dir, "labels"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digest_documents(docs, *byte_bpe_file()).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_extract": op7_html_extract,
    "op8_simhash": op8_simhash,
    "op9_sharding": op9_sharding,
    "op10_license_scan": op10_license_scan,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_byte_bpe": op13_byte_bpe,
}

def _license_sql() -> str:
    plain = f"regexp_replace(regexp_replace(unit, '{license_scan.COPYRIGHT_LINE}', '', 'g'), '{license_scan.MARKS}', ' ', 'g')"
    plain = f"' ' || trim({plain}) || ' '"
    for one, other in license_scan.SPELLINGS:
        plain = f"replace({plain}, ' {one} ', ' {other} ')"
    known = ", ".join(f"('{d}', '{n}')" for d, n in license_scan.known_digests())
    return f"""
        WITH known(digest, license) AS (VALUES {known}),
        docs AS (SELECT doc_id, row_number() OVER () AS r, {_LOWER} AS low FROM documents),
        units AS (
          SELECT r, 'text' AS kind, low AS unit FROM docs
          UNION ALL SELECT r, 'block', unnest(b) FROM (SELECT r, regexp_split_to_array(low, '\n[ \t]*\n') AS b FROM docs) WHERE len(b) > 1
          UNION ALL SELECT r, 'line', unnest(b) FROM (SELECT r, string_split(low, chr(10)) AS b FROM docs) WHERE len(b) > 1),
        hits AS (
          SELECT r, kind, license FROM (SELECT r, kind, sha256(trim({plain})) AS digest FROM units WHERE regexp_matches(unit, '{license_scan.ANCHOR}'))
          JOIN known USING (digest)),
        found AS (
          SELECT r, max(license) FILTER (kind = 'text') AS text_license, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
                 greatest(count(*) FILTER (kind = 'text'), count(*) FILTER (kind = 'block'), count(*) FILTER (kind = 'line')) AS n
          FROM hits GROUP BY r)
        SELECT doc_id, text_license, coalesce(licenses, '') AS licenses, coalesce(n, 0)::BIGINT AS n_notices FROM docs LEFT JOIN found USING (r)"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": r"""
        WITH sizes AS (
          SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                 md5(concat('mix:', coalesce(doc_id::VARCHAR, 'null'))) AS ord
          FROM documents),
        by_source AS (
          SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
          FROM sizes GROUP BY source),
        weighted AS (SELECT *, ([5, 2, 1])[(place % 3 + 1)::INT]::BIGINT AS weight, 2 * source_size AS cap FROM by_source),
        levels AS (
          SELECT *, (sum(source_size) OVER () * 3 / 2::DOUBLE - coalesce(sum(cap) OVER before, 0))
                    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
          FROM weighted
          WINDOW before AS (ORDER BY cap / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        targets AS (
          SELECT source, place, source_size,
                 CASE WHEN cap / weight::DOUBLE > level
                      THEN max(CASE WHEN cap / weight::DOUBLE > level THEN level END) OVER () * weight ELSE cap::DOUBLE END AS target
          FROM levels),
        begun AS (
          SELECT doc_id, size, source_size, target, place,
                 coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
          FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
        shares AS (
          SELECT *, greatest(0, least(size, floor(target)::BIGINT - b)) + greatest(0, least(size, floor(target)::BIGINT - b - source_size)) AS taken,
                 b / target AS y
          FROM begun)
        SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
               CASE WHEN taken = 0 THEN NULL
                    WHEN place % 3 = 0 THEN 2.0 * y / (1.5 + sqrt(2.25::DOUBLE + -2.0::DOUBLE * y))
                    WHEN place % 3 = 1 THEN 2.0 * y / (1.0 + sqrt(1.0::DOUBLE + 0.0::DOUBLE * y))
                    WHEN y < 0.3125 / 1.0 THEN 2.0 * y / (0.5 + sqrt(0.25::DOUBLE + 1.0::DOUBLE * y))
                    ELSE 0.5 + 2.0 * (y - 0.3125) / (0.75 + sqrt(0.5625::DOUBLE + 5.0::DOUBLE * greatest(y - 0.3125, 0.0))) END AS position
        FROM shares""",
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept,
               text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op10_license_scan": _license_sql(),
    "op12_filter_audit": r"""
        WITH d AS (
          SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                 min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low
          FROM documents),
        f AS (
          SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
                 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > low, false) AS e
          FROM d),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        t AS (
          SELECT part, map(['A', 'B', 'C', 'D', 'E'], [a, b, c, d, e]) AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails,
                 count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
          FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
        letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        orders AS (
          SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
          WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
        steps AS (
          SELECT filter_order, step::INT AS step, filter_order[step] AS filter, string_split(filter_order[1:step - 1], '') AS earlier FROM orders, range(1, 6) u(step)),
        told AS (
          SELECT part, filter_order, step, filter, n, good, toxic, n_fails, fails[filter] AS fail,
                 len(list_filter(earlier, lambda x: x <> '' AND coalesce(fails[x], false))) > 0 AS gone
          FROM t, steps)
        SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0)::BIGINT AS kept,
               coalesce(sum(n) FILTER (fail AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fail AND gone), 0)::BIGINT AS redundant,
               coalesce(sum(n) FILTER (fail AND n_fails = 1), 0)::BIGINT AS unique_fails,
               coalesce(sum(good) FILTER (fail AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fail AND NOT gone), 0)::BIGINT AS toxic_lost,
               coalesce(sum(n * 120 // greatest(n_fails, 1)) FILTER (fail), 0)::BIGINT AS shapley
        FROM told GROUP BY part, filter_order, step, filter""",
}
