"""Operator 8, SimHash near-duplicates by pigeonring filtering.

A text's fingerprint has a bit set where over half of its 3-word shingles' XXH64 values have it. Two fingerprints link
when they differ in at most tau bits. For tau + 1 segments on a ring, the pigeonring principle (Qin and Xiao, 2018)
says that linked fingerprints have a segment from which every chain of l consecutive segments differs in at most
l * tau / (tau + 1) bits. Chains of one and two segments become the join key: the first segment is equal, the second
differs in at most one bit, which a probe for each cleared bit finds. Longer chains prune what the join returns before
the full Hamming check.

Copies share a fingerprint and are joined as one, so nothing grows with the square of a group of copies. Null and
empty texts have fingerprint zero and link like any other; repeated rows and ties get the same answer; a null doc_id
gets its class's component, null if the class has no id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, small, small_batches, stored, unused

SHINGLE_WORDS = 3
SEED = 42
TAU = 3


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one text, as a signed number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    count = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=count)
    for at in range(0, count, 65536):  # in blocks, so that a very long text needs little memory
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<i8")[0])


def _fingerprints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def fingerprints(text: Column) -> Column:
    """The fingerprint column of a text column."""
    return F.pandas_udf(_fingerprints, "long")(text)


def _ring(tau: int) -> tuple[int, list[int]]:
    """Bits of a segment, and what chains of 1, 2, ... segments may differ in."""
    parts = tau + 1
    return 64 // parts, [(k * tau) // parts for k in range(1, parts + 1)]


def near_pairs(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """All pairs (u, v) of different values of prints.fp, distinct already, that differ in at most tau bits.

    tau is 1 or 3, so that the ring's segments are equally long.
    """
    if tau not in (1, 3):
        raise ValueError("tau must be 1 or 3")
    width, quota = _ring(tau)
    parts, mask = tau + 1, (1 << width) - 1
    turned = [f"(shiftrightunsigned(fp, {width * i}) | shiftleft(fp, {64 - width * i}))" if i else "fp" for i in range(parts)]
    ring = prints.select("fp", F.posexplode(F.expr(f"array({', '.join(turned)})")).alias("start", "turned"))
    # the key holds the first two segments; it and the start together name a bucket
    pair_mask = (1 << (2 * width)) - 1
    key = f"(turned & {pair_mask}L)" if 2 * width < 64 else "turned"
    index = ring.select("start", F.expr(key).alias("key"), F.col("fp").alias("v"), F.col("turned").alias("v_turned"))
    flips = f"filter(transform(sequence(0, {width - 1}), b -> shiftleft(1L, {width} + b)), x -> (turned & x) != 0)"
    probe = ring.select("start", "fp", "turned", F.expr(key).alias("key"), F.explode(F.expr(f"concat(array(0L), {flips})")).alias("cleared"))
    probe = probe.select("start", (F.col("key").bitwiseXOR(F.col("cleared"))).alias("key"), F.col("fp").alias("u"), F.col("turned").alias("u_turned"), "cleared")
    # Spark sizes what explode makes like the rows before it, and would send all fingerprints, four times, through the driver
    found = probe.join(index.hint("merge"), ["start", "key"]).where("u != v and (cleared != 0 or u > v)")
    differ = F.col("u_turned").bitwiseXOR(F.col("v_turned"))
    for chain in range(1, parts + 1):
        bits = width * chain
        part = differ if bits >= 64 else differ.bitwiseAND(F.lit((1 << bits) - 1))
        found = found.where(F.bit_count(part) <= quota[chain - 1])
    return found.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= tau).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _rooted(prints: DataFrame, tau: int) -> DataFrame:
    """One row per fp of prints: fp, root (its component's key), component_id (the component's smallest doc_id)."""
    # written, not held: a held table's plan would be a part of every plan that the driver describes
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(near_pairs(classes.select("fp"), tau))
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "named")
    for made in (classes, roots):
        discard(made)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return small(named.join(small(least, named.count()), "root").select("fp", "root", "component_id"), named.count())


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tau: int = TAU) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable over links)."""
    small_batches(docs.sparkSession)
    prints = stored(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprints(F.col(f"`{text}`")).alias("fp")), "prints")
    return prints.join(_rooted(prints, tau).drop("root"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tau: int = TAU) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id, of several texts of that id the one with
    the smallest hash. Rows without a doc_id come last; rows that repeat doc_id and text count once. Columns of docs pass
    through, whatever their names.
    """
    small_batches(docs.sparkSession)
    own_key, keep, keep_key = unused(docs, "key", "keep", "keep_key")
    key = F.xxhash64(F.col(f"`{text}`"))
    prints = stored(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), key.alias("key"), fingerprints(F.col(f"`{text}`")).alias("fp")), "prints")
    rooted = prints.join(_rooted(prints, tau).select("fp", "root"), "fp")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first"))
    found = first.select(F.col("first.doc_id").alias(keep), F.col("first.key").alias(keep_key))
    kept = docs.withColumn(own_key, key).join(found, F.col(f"`{doc_id}`").eqNullSafe(F.col(keep)) & (F.col(own_key) == F.col(keep_key)), "left_semi")
    return kept.dropDuplicates([doc_id, own_key]).drop(own_key)
