"""Operator 9, sharding by balanced label propagation.

Documents start on shards by the hash of their ids. In each round every hub (the documents that are linked to each
other, here those of equal text) is counted by shard, its documents want the shard where most of the hub is, and
quotas bound what a shard takes in; what is refused, and documents without links, fill the places that remain in an
order that keeps hubs together. Every round ends in a whole assignment under the law `rows` (counts at most one
apart); rounds end when no fewer links are cut.

Only DataFrame functions. A hub over a shard's quota is cut into parts of a quota, which want shards next to each
other; every other hub stays whole, and links cut are counted over whole hubs. Large hubs are salted for joins, and
ranks are taken in short cells whose counts are summed apart, so that no task holds a hub or a shard. Null texts have
no bytes and are linked with empty ones; repeated rows are rows of their own and interchangeable; null ids are rows
like any other; an empty table gives an empty result. Columns of other names are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Rows of a cell of a rank, on average at most, in tables of more than CELLS cells of so many; the cells' counts are a small table.
CELL_ROWS = 50_000
CELLS = 1024
#: Rows of a larger share of a shard than one of so many are counted and joined under several salts.
PART_OF_SHARD = 4


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """rows with a gapless rank from 0 within keys, ordered by cell and then order. rows is read twice."""
    cells = rows.groupBy(*keys, "cell").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select(*keys, "cell", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    inner = F.row_number().over(Window.partitionBy(*keys, "cell").orderBy(*order)) - 1
    return rows.withColumn("_rank", inner).join(base, [*keys, "cell"]).withColumn(name, F.col("_base") + F.col("_rank")).drop("_base", "_rank")


def _cells(rows: int) -> int:
    """The number of cells for so many rows, a power of two."""
    return max(CELLS, 1 << (rows // CELL_ROWS).bit_length())


def _quota(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _place(free: list[int], rank: Column) -> Column:
    """The shard whose free places, in order of shards, hold the rank; the list has one number a shard."""
    ends, total = [], 0
    for n in free:
        total += n
        ends.append(total)
    return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in ends]), lambda e: e <= rank))


def _with_sizes(rows: DataFrame, sizes: DataFrame, large: int) -> DataFrame:
    """rows with n, the size of their hub, null if they are alone. sizes has hub and n.

    There are few hubs of over large rows, a bounded part of all rows each: they are broadcast. Rows without a hub take
    no part in the join of the others, so that no key of it has more than large rows.
    """
    alone = rows.where("hub is null").withColumn("n", F.lit(None).cast("long"))
    first = rows.where("hub is not null").join(F.broadcast(sizes.where(F.col("n") > large)), "hub", "left")
    rest = first.where("n is null").drop("n").join(sizes.where(F.col("n") <= large), "hub", "left")
    return first.where("n is not null").unionByName(rest).unionByName(alone)


def _quota_parts(linked: DataFrame, quota: int, cells: int) -> DataFrame:
    """linked with _part: rows of a hub over the quota are dealt to parts of just a quota, others are of part 0."""
    rest = [c for c in linked.columns if c not in ("hub", "doc_id", "n")]
    over = linked.where(F.col("n") > quota).withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)))
    over = ranked(over, ["hub"], ["doc_id", *rest], "at").withColumn("_part", F.floor(F.col("at") / quota).cast("int")).drop("cell", "at")
    return linked.where(F.coalesce(F.col("n") <= quota, F.lit(True))).withColumn("_part", F.lit(0)).unionByName(over)


def label_propagation(rows: DataFrame, shards: int, rounds: int | None = None) -> DataFrame:
    """rows (doc_id, hub, ...) with shard. hub is null for a document without links. rounds bounds the rounds, if given."""
    total = rows.count()
    if not total:
        return rows.withColumn("shard", F.lit(0))
    quota = _quota(total, shards)
    whole = max(1, quota[-1])
    salted = max(1, quota[-1] // PART_OF_SHARD)
    # tables are written, not held: the plan of a held table is a part of every later plan, and the driver describes each
    # plan anew whenever a stage ends
    sizes = stored(rows.where("hub is not null").groupBy("hub").agg(F.count("*").alias("n")).where("n > 1"), "hubs", total)
    cells = _cells(total)
    linked = _with_sizes(rows, sizes, salted)
    over = not sizes.where(F.col("n") > whole).isEmpty()
    linked = stored(linked, "linked", total) if over else linked
    parts = _quota_parts(linked, whole, cells) if over else linked.withColumn("_part", F.lit(0))
    salts = F.coalesce(F.ceil(F.col("n") / salted), F.lit(1)).cast("int")
    state = parts.withColumns({"hub": F.when(F.col("n") > 1, F.xxhash64("hub")), "_salts": salts, "_salt": F.pmod(F.xxhash64("doc_id"), salts).cast("int")}).drop("n")
    spread = F.coalesce(F.col("hub"), F.xxhash64("doc_id", F.lit("alone")))
    # a large hub has cells of its own, next to each other and before all others, so that its parts are granted whole;
    # there are few such hubs
    near = F.pmod(F.xxhash64("hub", F.lit("cell")), F.lit(1 << 20)) * (1 << 20) + F.col("_salt")
    state = state.withColumn("cell", F.when(F.col("_salts") > 1, near).otherwise((1 + F.pmod(F.xxhash64(spread), F.lit(cells))) * (1 << 42)))
    state = stored(state.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("start")), F.lit(shards)).cast("int")), "state", total)
    for made in (sizes, linked):
        discard(made)
    order = ["hub", "doc_id", *[c for c in state.columns if c not in ("hub", "doc_id", "cell", "shard")]]
    cut = None
    for number in itertools.count():
        if number == rounds:
            break
        votes = state.where("hub is not null").groupBy("hub", "shard").agg(F.count("*").alias("n"), F.max("_salts").alias("_salts"))
        # ties go by hash, so that they spread over shards
        want = votes.groupBy("hub").agg(F.max_by("shard", F.struct("n", F.xxhash64("hub", "shard"))).alias("want"), F.max("_salts").alias("_of"))
        want = want.select("hub", "want", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_salt"))
        # rows without a hub stay out of the join: their key would be one
        moved = state.where("hub is not null").join(want, ["hub", "_salt"]).withColumn("want", F.pmod(F.col("want") + F.col("_part"), F.lit(shards)))
        moved = stored(moved.unionByName(state.where("hub is null").withColumn("want", F.lit(None).cast("int"))), "moved", total)
        asking = ranked(moved.where("want is not null"), ["want"], order, "at")
        full = F.element_at(F.array(*map(F.lit, quota)), F.col("want") + 1)
        placed = stored(asking.withColumn("granted", F.col("at") < full).drop("at"), "placed", total)
        taken = dict(placed.where("granted").groupBy("want").count().collect())  # a number for each shard
        free = [q - taken.get(s, 0) for s, q in enumerate(quota)]
        rest = placed.where("not granted").drop("granted").unionByName(moved.where("want is null"))
        filled = ranked(rest.withColumn("all", F.lit(0)), ["all"], order, "at")
        filled = filled.withColumn("shard", _place(free, F.col("at")).cast("int")).drop("all", "at", "want")
        after = placed.where("granted").withColumn("shard", F.col("want")).drop("granted", "want").unionByName(filled)
        after = stored(after, "state", total)
        now = cut_links(after)
        discard(moved)
        discard(placed)
        if cut is not None and now >= cut:
            discard(after)
            break
        discard(state)
        state, cut = after, now
        if not cut:
            break
    return state.drop("cell", "_part", "_salt", "_salts")


def cut_links(state: DataFrame) -> int:
    """Links cut when each hub is held together by as few links as can be: shards of a hub less one, summed."""
    by = state.where("hub is not null").groupBy("hub", "shard").count().groupBy("hub").agg((F.count("*") - 1).alias("cut"))
    return by.agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0]


def shard_documents(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard), grown_shard (null)."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(whole) + 16).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole, F.octet_length(whole)).alias("hub"),
    )
    rows = stored(rows, "rows")
    total = rows.count()
    state = label_propagation(rows, shards)
    if total:
        discard(rows)
    state = state.withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(_cells(total))).cast("int"))
    slots = ranked(state, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
