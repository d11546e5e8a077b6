"""Operator 12, filter interaction audit: what each order of document filters removes, step by step.

Copies are found by partition refinement. Documents are split by their number of code points, then by the hashes of
successive blocks of the text; a class of one document, or of one id, leaves at once. What survives all blocks is
compared as full texts; a class whose texts turn out different is split by the texts themselves. Of equal texts, each
document but those with the smallest id fails the duplicate filter. Then every document is one mask of failed filters,
masks are counted in each part, and all orders are read off the counts: no order passes over documents again.

Null texts count as empty, a null part as the empty string. Rows without an id fail no duplicate filter and are
nobody's smaller id; rows that repeat id and text are counted each, and none is the other's copy. Ids that labels
repeat count as labelled if one of their rows is so. Other columns are not read; an empty table gives no parts.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, discard, small, stored

#: The first block's code points; each later block ends at that many times the end of the one before.
BLOCK, GROWTH = 64, 16
#: Blocks that together hold any text: Spark's strings are shorter than 2^31 bytes.
BLOCKS = 8

#: Failure conditions over text, words (array) and n_words; the letter DUPLICATE is the class's own.
FILTERS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.col("n_words") < 100,
    "B": lambda: 100 * F.size(F.array_distinct("words")) < 80 * F.col("n_words"),
    "C": lambda: 100 * (F.col("length") - F.char_length(F.regexp_replace("text", "[A-Z]", ""))) > 10 * F.col("length"),
    "D": lambda: F.col("text").rlike(r"[#$%&*|]"),
}
DUPLICATE = "E"


def block_ends() -> list[int]:
    return [BLOCK * GROWTH**i for i in range(BLOCKS)]


def _hashes(block_hash: Callable[[Column], Column]) -> Column:
    """The hash of each block that the text reaches into: one to BLOCKS of them."""
    ends = block_ends()
    each = []
    for start, end in zip([0, *ends], ends):
        block = F.substring(F.col("text"), start + 1, min(end - start, 2**31 - 1))
        each.append(F.when(F.col("length") > start, block_hash(block)))
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang", block_hash: Callable[[Column], Column] = F.xxhash64, filters: dict | None = None) -> DataFrame:
    """A narrow row for each document: id, part, mask (a bit for each failed filter but the duplicate's), length, hashes; and its text."""
    filters = FILTERS if filters is None else filters
    plain = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    plain = plain.withColumn("length", F.char_length("text").cast("long"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    cut = plain.withColumn("words", words).withColumn("n_words", F.size("words").cast("long"))
    mask = sum((F.when(fails(), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    return cut.select("id", "part", "text", "length", mask.alias("mask"), _hashes(block_hash).alias("hashes"))


def refined(rows: DataFrame) -> tuple[DataFrame, int]:
    """Classes (length, hashes, low) of two ids or more that no block tells apart, low their smallest id; and how many.

    rows: id, length, hashes. Level 0 splits by length, level n by the hash of the nth block as well. Each level counts
    its classes by a partial aggregate, drops those of one id and lets the next level see only the others' documents.
    """
    alive, before = rows.where("id is not null").select("id", "length", "hashes"), None
    for level in range(BLOCKS + 1):
        key = [F.col("length"), F.slice("hashes", 1, level).alias("prefix")]
        classes = alive.select("id", *key).groupBy("length", "prefix").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        classes = stored(classes.where("low < high").drop("high"), "classes")
        n, longest = classes.agg(F.count("*"), F.max("length")).first()
        if before is not None:
            discard(before)
        before = classes
        if not n or level == BLOCKS or longest <= ([0] + block_ends())[level]:
            break
        shared = small(classes.select(F.col("length").alias("l"), F.col("prefix").alias("p")), n)
        alive = rows.where("id is not null").select("id", "length", "hashes").join(shared, (F.col("length") == F.col("l")) & (F.slice("hashes", 1, level) == F.col("p")), "left_semi")
    return classes.select("length", F.col("prefix").alias("hashes"), "low"), n


def with_duplicates(docs: DataFrame, **columns) -> DataFrame:
    """id, part, mask of each document, the duplicate filter's bit after the others'; written to the shared folder.

    The survivors' texts meet in two aggregates, smallest and largest text of a class, partial in each task: however
    many copies a class has, a task sends two texts. Classes of unequal texts are grouped by the texts themselves.
    """
    bit = 1 << len(columns.get("filters") or FILTERS)
    texts = measured(docs, **columns)
    rows = stored(texts.drop("text"), "measured")
    classes, n = refined(rows)
    if not n:
        return rows.select("id", "part", "mask")
    held_texts = texts.join(small(classes.drop("low"), n), ["length", "hashes"], "left_semi").where("id is not null")
    ends = held_texts.groupBy("length", "hashes").agg(F.min("text").alias("first"), F.max("text").alias("last"))
    equal = stored(ends.select("length", "hashes", (F.col("first") == F.col("last")).alias("equal")), "compared")
    known = classes.join(equal, ["length", "hashes"])
    # classes of unequal texts stay out of the first branch and go by their texts in the second
    odd = equal.where("not equal").drop("equal")
    n_odd = odd.count()
    told = rows.join(small(known, n), ["length", "hashes"], "left")
    fails = F.coalesce(F.col("equal") & (F.col("id") > F.col("low")), F.lit(False))
    found = told.where("equal is null or equal or id is null").select("id", "part", (F.col("mask") + F.when(fails, bit).otherwise(0)).alias("mask"))
    if n_odd:
        apart = texts.join(small(odd, n_odd), ["length", "hashes"], "left_semi").where("id is not null")
        lows = apart.groupBy("length", "hashes", "text").agg(F.min("id").alias("low"))
        apart = apart.join(lows, ["length", "hashes", "text"])
        found = found.union(apart.select("id", "part", (F.col("mask") + F.when(F.col("id") > F.col("low"), bit).otherwise(0)).alias("mask")))
    found = stored(found, "masks")
    for done in (rows, classes, equal):
        discard(done)
    return found


def counted(masks: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: documents of each mask in each part, those labelled of quality, and toxic ones."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    by_id = labels.groupBy(F.col(f"`{doc_id}`").alias("id")).agg(flag("quality").alias("is_good"), flag("toxic").alias("is_toxic"))
    joined = masks.join(by_id, "id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), total("is_good").alias("good"), total("is_toxic").alias("toxic"))


def orders(letters: str) -> Column:
    """Every step of every order: filter_order, step, filter, its bit and the bits of the filters before it, one struct each."""
    steps = []
    for order in permutations(letters):
        earlier = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            steps.append({"filter_order": "".join(order), "step": step, "filter": letter, "bit": bit, "earlier": earlier})
            earlier |= bit
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, filter string, bit int, earlier int>>")


def steps_of(cells: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order and step, read off the part's counts by mask: at most 2^filters of them."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    each = parts.select("part", "cells", F.inline(orders(letters)))
    total = lambda value, keep: F.aggregate(F.filter("cells", keep), F.lit(0).cast("long"), lambda a, x: a + value(x))
    fails = lambda x: x["mask"].bitwiseAND(F.col("bit")) != 0
    gone = lambda x: x["mask"].bitwiseAND(F.col("earlier")) != 0
    here = lambda x: fails(x) & ~gone(x)
    n = lambda x: x["n"]
    # of a mask's filters each comes first in an equal share of all orders
    share = lambda x: x["n"] * F.lit(factorial(len(letters))).cast("long") / F.bit_count(x["mask"])
    return each.select(
        "part", "filter_order", "step", "filter",
        total(n, lambda x: ~fails(x) & ~gone(x)).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda x: fails(x) & gone(x)).alias("redundant"),
        total(n, lambda x: x["mask"] == F.col("bit")).alias("unique_fails"),
        total(lambda x: x["good"], here).alias("good_lost"),
        total(lambda x: x["toxic"], here).alias("toxic_lost"),
        total(lambda x: share(x).cast("long"), fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """A row for each part, order of the filters and step. columns: text, doc_id, part, filters, block_hash as in measured()."""
    letters = "".join(columns.get("filters") or FILTERS) + DUPLICATE
    masks = with_duplicates(docs, **columns)
    cells = stored(counted(masks, labels), "cells", 0)
    discard(masks)
    return steps_of(cells, letters)
