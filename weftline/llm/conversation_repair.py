"""Operator 11, conversation structure repair by weighted finite-state composition.

Three automata are composed: an acceptor of a conversation's rows, a transducer of edits (Keep 0, Rerole 3, Delete 4,
Insert 3; a kept or reroled truncated row costs 3 more; blank and duplicate rows can only be deleted) and an acceptor
of the role grammar (s?(ua)+)?. States of the composition are expanded lazily, row by row in topological order, and
the shortest path is sought over weights (cost, labels), the cheapest first and of equals the ASCII-least string of
edits. Two paths over the same rows of the same cost never have labels of which one begins the other, for a label's
cost depends on its row alone; so the weights form a semiring, and stretches of rows can be solved apart.

Rows are dealt out by ranges of (conversation, turn, role, text), so that a conversation of any length spans tasks.
Each task streams its rows: conversations that lie inside of it are solved there; of those at its edges, and of long
ones, it emits segments of bounded size with their weights from each state to each state. The few segments are brought
together by conversation and composed in order, edits being carried out as soon as all paths that can still win agree
on them. Only that last pass, whose digest is sequential by nature, holds a conversation in one task, and it streams.

Nulls count as one space in ids of the damage, roles and texts; null turns come first; a null conversation is one. Rows
of the same turn are ordered by role, then text; repeated rows are copies, of which the later ones are duplicates.
Roles of other initials are reroled or deleted. Conversations that lose all rows stay, with zeros. Very long texts are
cut out of the weights and only streamed; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os.path
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, stored

#: Rows and bytes of a segment, and segments of a conversation that a task keeps before it emits them.
SEGMENT_ROWS = 512
SEGMENT_BYTES = 4 << 20
KEPT_SEGMENTS = 4
#: Repaired rows in a batch that a task hands back.
BATCH = 500

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The grammar's states: begun, after s, after u, after a; an empty repair or one that ends in a is accepted.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Any path from one state can follow any from another after at most an insert and a deletion more.
SLACK = INSERT + DELETE
BLANK = r"^[\x20\x09-\x0D]*\z"
SPACES = " \t\n\x0b\f\r"
#: Weight: cost and labels.
Weight = tuple[int, str]
Weights = dict[int, Weight]

SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "position long, role string, text string, edit string"


@lru_cache(maxsize=None)
def edits(symbol: str) -> tuple[tuple[str, str | None, int], ...]:
    """The transducer's arcs over one row: label, output, cost. Symbols: D must go; s, u, a, x kept; upper case truncated."""
    if symbol == "D":
        return (("D", None, DELETE),)
    more = TRUNCATED if symbol.isupper() else 0
    kept = (("K", symbol.lower(), KEEP + more),) if symbol.lower() in "sua" else ()
    return (*kept, ("R", "u", REROLE + more), ("R", "a", REROLE + more), ("D", None, DELETE))


def _relax(into: Weights, state: int, weight: Weight) -> None:
    if state not in into or weight < into[state]:
        into[state] = weight


def inserted(weights: Weights) -> Weights:
    """After up to two insertions: two lead from any state to any other, and more only cost."""
    best, layer = dict(weights), weights
    for _ in range(2):
        after: Weights = {}
        for state, (cost, labels) in layer.items():
            for output in ROLES:
                if output in GRAMMAR[state]:
                    _relax(after, GRAMMAR[state][output], (cost + INSERT, labels + "I"))
        for state, weight in after.items():
            _relax(best, state, weight)
        layer = after
    return best


def advance(weights: Weights, symbols: str) -> Weights:
    """Shortest paths from weighted states over rows, by state of the grammar after the last of them."""
    for symbol in symbols:
        after: Weights = {}
        for state, (cost, labels) in inserted(weights).items():
            for label, output, more in edits(symbol):
                to = state if output is None else GRAMMAR[state].get(output)
                if to is not None:
                    _relax(after, to, (cost + more, labels + label))
        weights = after
    return weights


@lru_cache(maxsize=4096)
def _short(symbols: str) -> Weights:
    return advance({0: (0, "")}, symbols)


def closed(weights: Weights) -> Weight:
    """The best weight of an accepted repair."""
    done = inserted(weights)
    return min(done[state] for state in FINAL if state in done)


class Segment:
    """Some rows of a conversation in a row: what the weights and counts need, and the rows that may stay."""

    def __init__(self):
        self.symbols: list[str] = []
        self.rows: list[tuple[str, str] | None] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.size = 0
        self.first = self.last = None  # initials
        self.low = self.high = self.low_turn = self.high_turn = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        initial = role[:1]
        if self.symbols:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.last = initial
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        known = initial if initial and initial in "sua" else "x"
        self.symbols.append("D" if blank or duplicate else known.upper() if truncated else known)
        self.rows.append(None if blank or duplicate else (role, text))
        self.size += 0 if blank or duplicate else len(text)

    def full(self) -> bool:
        return len(self.rows) >= SEGMENT_ROWS or self.size >= SEGMENT_BYTES

    def packed(self) -> str:
        """With the weights from each state to each state, for the task that composes segments."""
        symbols = "".join(self.symbols)
        matrix = {state: advance({state: (0, "")}, symbols) for state in GRAMMAR}
        return json.dumps([self.__dict__ | {"symbols": symbols}, matrix])

    @staticmethod
    def unpacked(packed: str) -> tuple[Segment, dict[int, Weights]]:
        values, matrix = json.loads(packed)
        segment = Segment()
        segment.__dict__ |= values
        return segment, {int(i): {int(j): (cost, labels) for j, (cost, labels) in row.items()} for i, row in matrix.items()}


class Repair:
    """Composes a conversation's segments in order and carries out edits once they are settled."""

    def __init__(self, emit=None):
        self.weights: Weights = {0: (0, "")}
        self.waiting: deque[tuple[str, str] | None] = deque()
        self.emit, self.state, self.position = emit, 0, 0
        self.digest, self.audit = hashlib.sha256(), []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.turns, self.low, self.high, self.last = 0, None, None, None

    def add(self, segment: Segment, matrix: dict[int, Weights] | None = None) -> None:
        if segment.rows:
            for name in self.counts:
                self.counts[name] += getattr(segment, name)
            if self.last is not None:
                self.counts["illegal"] += self.last + segment.first not in ("su", "ua", "au")
            self.last = segment.last
        if segment.low is not None:
            self.turns += segment.turns - (segment.low == self.high)
            self.low = segment.low if self.low is None else self.low
            self.high = segment.high
        self.waiting.extend(segment.rows)
        if matrix is None:
            symbols = "".join(segment.symbols)
            self.weights = dict(_short(symbols)) if self.weights == {0: (0, "")} and len(symbols) < 64 else advance(self.weights, symbols)
        else:
            after: Weights = {}
            for i, (cost, labels) in self.weights.items():
                for j, (more, added) in matrix[i].items():
                    _relax(after, j, (cost + more, labels + added))
            self.weights = after
        least = min(cost for cost, _ in self.weights.values())
        alive = {state: w for state, w in self.weights.items() if w[0] <= least + SLACK}
        settled = len(os.path.commonprefix([labels for _, labels in alive.values()]))
        self._carry_out(next(iter(alive.values()))[1][:settled])
        self.weights = {state: (cost, labels[settled:]) for state, (cost, labels) in alive.items()}

    def _carry_out(self, labels: str) -> None:
        self.audit.append(labels)
        for label in labels:
            row = None if label == "I" else self.waiting.popleft()
            if label == "D":
                continue
            if label == "K":
                role, text = row
                output = role[:1]
            else:
                output = "a" if self.state == 2 else "u"
                role, text = ROLES[output], row[1] if row else ""
            self.state = GRAMMAR[self.state][output]
            if self.emit is None:
                self.digest.update((("\n" if self.position else "") + f"{role}:{text}").encode("utf-8", "replace"))
            else:
                self.emit(self.position, role, text, label)
            self.position += 1

    def finish(self) -> tuple:
        """The values of SUMMARY."""
        cost, labels = closed(self.weights)
        self._carry_out(labels)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *self.counts.values(), cost, "".join(self.audit), self.digest.hexdigest())


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: one row in twenty each is dropped, emptied, stripped, doubled, or set to user."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select(
        "conv_id", F.when(F.col("kind") != 0, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, copies) with their faults; copies of a row are one row, summed before the shuffle.

    Rows whose role and text the conversation has in an earlier turn are few: their first turns are found by digest in
    a partial aggregate and joined back.
    """
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    digest = F.unhex(F.sha2("text", 256))
    seen = rows.where("copies > 0").select("conv_id", "role", digest.alias("digest"), order.alias("at"))
    later = seen.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last")
    later = later.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    each = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (digest == F.col("d"))
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    return each.join(later, same, "left").select(
        "conv_id", "turn", "role", "text", "copies", F.col("text").rlike(BLANK).alias("blank"), (~end.isin(".", "!", "?")).alias("cut"),
        (F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("again"),
    )


class _Out:
    """Rows on their way back to Spark."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def batch(self, at_least: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= at_least:
            columns = list(zip(*self.rows))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
            self.rows = []


def _schema(batch: pa.RecordBatch, rows: bool) -> pa.Schema:
    texts = ("role", "text", "edit") if rows else ("audit", "repaired_sha256")
    names = [x.split()[0] for x in (ROWS if rows else SUMMARY).split(", ")]
    own = [pa.field(n, pa.string() if n in texts else pa.int64()) for n in names]
    return pa.schema([batch.schema.field("conv_id"), pa.field("part", pa.int64()), pa.field("no", pa.int64()), pa.field("segment", pa.string()), *own])


def _solved(as_rows: bool):
    width = len((ROWS if as_rows else SUMMARY).split(", "))

    def close(out: _Out, conv, segments: list[Segment]) -> None:
        repair = Repair(_emitter(out, conv) if as_rows else None)
        for segment in segments:
            repair.add(segment)
        summary = repair.finish()
        if not as_rows:
            out.rows.append((conv, None, None, None, *summary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), None
        conv, segments, number, edge = None, [], 0, True

        def leave() -> None:
            """Hand the segments so far to the task that composes them."""
            nonlocal number
            for segment in segments:
                out.rows.append((conv, part, number, segment.packed(), *[None] * width))
                number += 1
            segments.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out, conv, segments = _Out(_schema(batch, as_rows)), row[0], [Segment()]
                if row[0] != conv:
                    if edge:
                        leave()
                    else:
                        close(out, conv, segments)
                    conv, segments, number, edge = row[0], [Segment()], 0, False
                    yield from out.batch(BATCH)
                _, turn, role, text, copies, blank, cut, again = row
                for copy in range(copies):
                    if segments[-1].full():
                        if edge or len(segments) >= KEPT_SEGMENTS:
                            edge = True
                            leave()
                            yield from out.batch(1)
                        segments.append(Segment())
                    repeated = not blank and (again or copy > 0)
                    segments[-1].add(turn, role, text, blank, repeated, cut and not blank and not repeated)
        if out is not None:
            leave()
            yield from out.batch(1)

    return run


def _emitter(out: _Out, conv):
    return lambda position, role, text, edit: out.rows.append((conv, None, None, None, position, role, text, edit))


def _composed(as_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, repair = None, None, None
        for batch in batches:
            for now, packed in zip(batch.column("conv_id").to_pylist(), batch.column("segment").to_pylist()):
                if out is None:
                    out = _Out(_schema(batch, as_rows))
                if repair is None or now != conv:
                    if repair is not None:
                        summary = repair.finish()
                        if not as_rows:
                            out.rows.append((conv, None, None, None, *summary))
                    conv, repair = now, Repair(_emitter(out, now) if as_rows else None)
                repair.add(*Segment.unpacked(packed))
                yield from out.batch(BATCH)
        if repair is not None:
            summary = repair.finish()
            if not as_rows:
                out.rows.append((conv, None, None, None, *summary))
            yield from out.batch(1)

    return run


def _repaired(rows: DataFrame, as_rows: bool) -> DataFrame:
    small_batches(rows.sparkSession)
    faults = with_faults(rows)
    key = ("conv_id", "turn", "role")
    dealt = faults.repartitionByRange(*key, F.substring("text", 1, 64)).sortWithinPartitions(*key, "text")
    own = ROWS if as_rows else SUMMARY
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, part long, no long, segment string, {own}"
    solved = stored(dealt.mapInArrow(_solved(as_rows), schema), "repaired")
    apart = solved.where("segment is not null").repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    composed = stored(apart.mapInArrow(_composed(as_rows), schema), "composed")
    names = [x.split()[0] for x in own.split(", ")]
    return solved.where("segment is null").union(composed).select("conv_id", *names)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The repaired rows of each conversation: conv_id, position, role, text, edit (K, R or I).

    rows: conv_id, turn, role, text, copies (how often the row stands there; 0 keeps only the conversation).
    """
    return _repaired(rows, True)


def summarise_repairs(rows: DataFrame) -> DataFrame:
    """One row for each conversation: its faults, the repair's cost and edits, and the digest of the repaired rows."""
    return _repaired(rows, False)
