"""Operator 5, exact deduplication against immutable snapshots by binary-fuse filters.

Documents arrive in batches. A batch is grouped by the digest of its normalised texts on its own first; its digests are
then screened by the static binary-fuse filters (Graf and Lemire, 2022) of all earlier snapshots, one filter for each
bucket of digests; only positives join the snapshots' exact buckets, and the bytes of their texts are compared before
they count as equal. What no snapshot holds becomes the batch's own immutable snapshot.

Texts are equal when identical after lower-casing A-Z only. The row with the largest doc_id stays. Null counts as
empty, so null and empty texts are one group. Of rows that repeat a doc_id in a group one stays; null ids stay only in
groups without any id. An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, held, small, stored, unused

#: Digests of a filter, on average at most.
KEYS_PER_BUCKET = 2048
_TWO32 = np.uint64(32)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


class BinaryFuse:
    """A three-wise binary-fuse filter with 8-bit fingerprints over distinct 64-bit keys."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        mask = np.uint64(segment - 1)
        first = ((h >> _TWO32) * np.uint64(segments * segment)) >> _TWO32
        second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> _TWO32)) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        """Peel slots that one key alone uses, all such slots of a round at once, and fill them in reverse order."""
        n = len(keys)
        size = max(n, 2)
        segment = 1 << min(18, int(np.floor(np.log(size) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(size))
        segments = max(1, -(-int(round(size * factor)) // segment) - 2)
        for seed in range(1, 1000):
            h = _mix(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            at = cls._places(h, segment, segments)
            length = (segments + 2) * segment
            count, owner = np.zeros(length, np.int64), np.zeros(length, np.int64)
            for row in at:
                np.add.at(count, row, 1)
                np.bitwise_xor.at(owner, row, np.arange(n))
            rounds, left = [], n
            while left:
                slots = np.flatnonzero(count == 1)
                if not len(slots):
                    break
                who, first = np.unique(owner[slots], return_index=True)
                rounds.append((who, slots[first]))
                left -= len(who)
                for row in at:
                    np.add.at(count, row[who], -1)
                    np.bitwise_xor.at(owner, row[who], who)
            if left:
                segments += seed % 8 == 0
                continue
            table, prints = np.zeros(length, np.uint8), cls._prints(h)
            for who, slots in reversed(rounds):
                table[slots] = 0
                table[slots] = prints[who] ^ table[at[0, who]] ^ table[at[1, who]] ^ table[at[2, who]]
            return cls(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, segment, segments, table)
        raise ValueError("keys of a binary-fuse filter must be distinct")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys, self.seed)
        at = self._places(h, self.segment, self.segments)
        return (self.table[at[0]] ^ self.table[at[1]] ^ self.table[at[2]]) == self._prints(h)


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    """A 60-bit key of the digest, and the bucket that the key's low bits name."""
    key = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    return groups.withColumn("key", key).withColumn("bucket", F.col("key").bitwiseAND(F.lit(buckets - 1)))


def _gathered(groups: DataFrame, buckets: int) -> DataFrame:
    """One row for each bucket with its keys and digests, KEYS_PER_BUCKET on average: digests are distinct and spread evenly."""
    each = F.collect_list(F.struct("key", "digest")).alias("each")
    return _bucketed(groups.select("digest"), buckets).groupBy("bucket").agg(each)


def _unsigned(keys: np.ndarray) -> np.ndarray:
    return np.asarray(keys, dtype=np.int64).view(np.uint64)


def _built(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for lists in parts:
        made = [BinaryFuse.build(np.unique(_unsigned(keys))) for keys in lists]
        rows = [(np.uint64(f.seed).view(np.int64), f.segment, f.segments, f.table.tobytes()) for f in made]
        yield pd.DataFrame(rows, columns=["seed", "segment", "segments", "cells"])


def _contained(parts: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
    for lists, filters in parts:
        out = []
        for keys, row in zip(lists, filters.itertuples()):
            f = BinaryFuse(int(np.int64(row.seed).view(np.uint64)), row.segment, row.segments, np.frombuffer(row.cells, np.uint8))
            out.append(f.contains(_unsigned(keys)))
        yield pd.Series(out, dtype=object)


def snapshot_filters(entries: DataFrame, snapshot: int, buckets: int) -> DataFrame:
    """One binary-fuse filter for each bucket of an immutable snapshot's distinct digests."""
    build = F.pandas_udf(_built, "seed long, segment long, segments long, cells binary")
    gathered = _gathered(entries, buckets)
    return gathered.select("bucket", F.lit(snapshot).alias("snapshot"), build(F.transform("each", lambda x: x["key"])).alias("filter"))


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The (digest, snapshot) pairs that the filters let through: all true ones and about 1 in 256 of the others."""
    contained = F.pandas_udf(_contained, "array<boolean>")
    tested = _gathered(groups, buckets).join(filters, "bucket")
    tested = tested.withColumn("in", contained(F.transform("each", lambda x: x["key"]), F.col("filter")))
    pairs = tested.select("snapshot", F.inline(F.arrays_zip(F.transform("each", lambda x: x["digest"]).alias("digest"), F.col("in"))))
    return pairs.where("in").select("digest", "snapshot")


def dedup(docs: DataFrame, arrival: Column, batches: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, snapshot (the batch that first held the text).

    arrival gives each row's batch, 0 to batches - 1; batches are ingested in that order.
    """
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), arrival.cast("int").alias("batch"), normalised(F.col(f"`{text}`")).alias("plain"))
    digests = held(plain.select("doc_id", "batch", F.sha2("plain", 256).alias("digest"), F.xxhash64("plain").alias("quick")))
    rows = digests.count()
    buckets = 1
    while buckets * KEYS_PER_BUCKET < rows / batches:
        buckets *= 2
    known: list[DataFrame] = []  # entries of the snapshots: digest, snapshot
    filters: list[DataFrame] = []
    ingested: list[DataFrame] = []
    for number in range(batches):
        # the batch's own duplicates, grouped apart from any snapshot
        groups = digests.where(F.col("batch") == number).groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"), F.min("quick").alias("quick"))
        if known:
            groups = held(groups)
            positives = screen(groups, reduce(DataFrame.union, filters), buckets)
            hits = positives.join(reduce(DataFrame.union, known), ["digest", "snapshot"])
            hits = held(hits.join(groups.select("digest", "quick"), "digest"))
            matched = _same_bytes(plain, hits, number)
            groups = stored(groups.join(matched, "digest", "left"), "batch", rows)
        else:
            groups = stored(groups.withColumn("snapshot", F.lit(None).cast("int")), "batch", rows)
        fresh = groups.where("snapshot is null").select("digest", F.lit(number).alias("snapshot"))
        known.append(fresh)
        filters.append(stored(snapshot_filters(fresh, number, buckets), "filters", rows))
        ingested.append(groups.select(F.lit(number).alias("batch"), "digest", F.coalesce("snapshot", F.lit(number)).alias("snapshot"), "keep_id", "n"))
    every = reduce(DataFrame.union, ingested)
    whole = every.groupBy("digest", "snapshot").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    classes = every.select("batch", "digest", "snapshot").join(whole, ["digest", "snapshot"])
    found = digests.drop("quick").join(classes, ["batch", "digest"])
    # of rows that repeat the kept doc_id, one stays
    turn = F.row_number().over(Window.partitionBy("digest", "snapshot", "doc_id").orderBy("batch"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)
    return found.withColumn("turn", turn).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"), "snapshot")


def _same_bytes(plain: DataFrame, hits: DataFrame, number: int) -> DataFrame:
    """The hits whose texts, in the batch and in the snapshot, are the same bytes: smallest and largest text are equal.

    Both are partial aggregates, so that each task sends one text of a digest however many copies it has.
    """
    rows = hits.count()
    # the quick hash finds the few texts that are digested again
    texts = plain.where(F.col("batch") <= number).withColumn("quick", F.xxhash64("plain")).join(small(hits, rows), "quick")
    texts = texts.where((F.col("batch") == number) | (F.col("batch") == F.col("snapshot"))).where(F.sha2("plain", 256) == F.col("digest"))
    ends = texts.groupBy("digest", "snapshot").agg(F.min("plain").alias("low"), F.max("plain").alias("high"))
    return ends.where("low = high").select("digest", "snapshot")


def stay(docs: DataFrame, arrival: Column, batches: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns; of repeated rows one."""
    own_id, own_sha = unused(docs, "id", "sha")
    found = dedup(docs, arrival, batches, text, doc_id).where("kept").select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_sha))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(own_id)) & (F.sha2(normalised(F.col(f"`{text}`")), 256) == F.col(own_sha))
    return docs.join(found, same, "left_semi").dropDuplicates([doc_id, text])
