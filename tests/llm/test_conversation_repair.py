"""Operator 11 against enumeration of all edits, and whole tables against a row-by-row version."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from weftline.llm import conversation_repair as cr
from weftline.llm import queries

SF = "/root/testdata/sf0.001"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
SHOWN = re.compile(r"[^\x20\x09-\x0D]")


def enumerated(symbols):
    """(cost, labels) by trying every edit of every row with up to two insertions in each gap."""
    best = None
    gaps = [("", ()), ("I", "u"), ("I", "a"), ("II", "ua"), ("II", "au")]
    for edits in product(*[cr.edits(s) for s in symbols]):
        for filled in product(gaps, repeat=len(symbols) + 1):
            labels, outputs, cost = filled[0][0], list(filled[0][1]), 3 * len(filled[0][0])
            for (label, output, more), (added, roles) in zip(edits, filled[1:]):
                labels += label + added
                cost += more + 3 * len(added)
                outputs += [x for x in (output, *roles) if x]
            if GRAMMAR.match("".join(outputs)) and (best is None or (cost, labels) < best):
                best = cost, labels
    return best


def test_every_short_conversation():
    for n, alphabet in ((0, "s"), (1, "suaxDSUAX"), (2, "suaxDSUAX"), (3, "suxDA")):
        for symbols in product(alphabet, repeat=n):
            assert cr.closed(cr.advance({0: (0, "")}, "".join(symbols))) == enumerated("".join(symbols)), symbols


def dijkstra(symbols):
    """Shortest path backwards, labels put in front: the order of whole strings needs no argument here."""
    best = {q: (0, "") if q in (0, 3) else (10**9, "") for q in cr.GRAMMAR}

    def closing(best):
        for _ in range(3):
            best = {q: min([best[q], *((best[t][0] + 3, "I" + best[t][1]) for t in cr.GRAMMAR[q].values() if t in (2, 3))]) for q in best}
        return best

    best = closing(best)
    for symbol in reversed(symbols):
        before = {}
        for q in best:
            ways = [(10**9, "")]
            for label, output, more in cr.edits(symbol):
                to = q if output is None else cr.GRAMMAR[q].get(output)
                if to is not None:
                    ways.append((best[to][0] + more, label + best[to][1]))
            before[q] = min(ways)
        best = closing(before)
    return best[0]


def segments_of(symbols, rng):
    made, current = [], cr.Segment()
    for i, s in enumerate(symbols):
        current.add(i, {"x": "tool", "d": "user"}.get(s.lower(), s.lower() + "..."), f"t{i}", s == "D", False, s.isupper() and s != "D")
        if rng.random() < 0.1:
            made.append(current)
            current = cr.Segment()
    return [*made, current]


def test_segments_compose_to_the_whole():
    rng = random.Random(4)
    for _ in range(300):
        symbols = "".join(rng.choice("suauauxDSUA") for _ in range(rng.randint(0, 60)))
        want = dijkstra(symbols)
        results = set()
        for packed in (False, True):
            repair, emitted = cr.Repair(), []
            for s in segments_of(symbols, rng):
                repair.add(*(cr.Segment.unpacked(s.packed()) if packed else (s,)))
            results.add(repair.finish())
            rows = cr.Repair(lambda *x: emitted.append(x))
            for s in segments_of(symbols, rng):
                rows.add(s)
            rows.finish()
            assert GRAMMAR.match("".join(r[1][0] for r in emitted)) and [r[0] for r in emitted] == list(range(len(emitted)))
            text = "\n".join(f"{role}:{text}" for _, role, text, _ in emitted)
            assert hashlib.sha256(text.encode()).hexdigest() == repair.digest.hexdigest()
        assert len(results) == 1 and results.pop()[5:7] == want


def test_settled_edits_leave_the_queue():
    rng, repair = random.Random(2), cr.Repair()
    for i in range(200):
        segment = cr.Segment()
        for j in range(100):
            segment.add(i * 100 + j, rng.choice(["user", "assistant", "system", "tool"]), "x.", False, False, False)
        repair.add(segment)
        assert len(repair.waiting) < 60


def brute(rows):
    """The contract, row by row; rows of one turn by role and text."""
    convs = defaultdict(list)
    for r in rows:
        told = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{told(r.conv_id)}:{told(r.turn)}".encode()) % 20
        role, text = told(r.role), told(r.text)
        conv = convs[r.conv_id]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            row = (r.turn is not None, r.turn or 0, "user" if kind == 4 else role, text)
            conv += [row] * (2 if kind == 3 else 1)
    out = {}
    for conv, damaged in convs.items():
        damaged.sort()
        seen, symbols, counts = set(), "", dict.fromkeys("bdt", 0)
        for _, _, role, text in damaged:
            shown = SHOWN.findall(text)
            fault = "b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] = counts.get(fault, 0) + 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "D" if fault in ("b", "d") else initial.upper() if fault else initial
        turns = [t for known, t, _, _ in damaged if known]
        cost, labels = dijkstra(symbols)
        queue, lines, state = list(damaged), [], 0
        for label in labels:
            row = queue.pop(0) if label != "I" else None
            if label == "D":
                continue
            output = row[2][0] if label == "K" else "a" if state == 2 else "u"
            lines.append(f"{row[2] if label == 'K' else cr.ROLES[output]}:{row[3] if row else ''}")
            state = cr.GRAMMAR[state][output]
        illegal = sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in zip(damaged, damaged[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, labels, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_rows(found):
    return {r.conv_id: tuple(r)[1:] for r in found.collect()}


def test_query_equals_row_by_row(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    found = queries.op11_conversation_repair(spark, SF)
    assert found.count() == len({r.conv_id for r in rows}) and as_rows(found) == brute(rows)


@pytest.fixture(scope="module")
def tricky(spark):
    rng = random.Random(8)
    rows = [(1, None, None, None), (1, None, "user", "Null turn."), (1, 3, "user", "a.b!?"), (1, 3, "user", "a.b!?"), (2, 0, "", "No role."), (2, 1, "tool", "?"), (None, 5, "system", "S."), (None, 6, None, " \t\n")]
    rows += [(3, t, "user" if t % 2 == 0 else "assistant", "Same words each time.") for t in range(40)] + [(4, 7, "assistant", "x" * 200_000)]
    rows += [(5, rng.randrange(4000), rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), rng.choice(["Yes.", "No", "", f"Word {i}.", f"More {i}"])) for i in range(6000)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {c} {t}.") for c in range(100, 160) for t in range(c % 7)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_nulls_ties_hot_and_long_conversations(spark, tricky):
    want = brute(tricky.collect())
    assert as_rows(cr.summarise_repairs(cr.damaged(tricky))) == want
    lines = defaultdict(list)
    for r in cr.repair_conversations(cr.damaged(tricky)).collect():
        lines[r.conv_id].append((r.position, f"{r.role}:{r.text}"))
    for conv, values in want.items():
        assert hashlib.sha256("\n".join(x for _, x in sorted(lines[conv])).encode()).hexdigest() == values[-1]


def test_edges(spark, tricky):
    empty = cr.summarise_repairs(cr.damaged(tricky.limit(0)))
    assert empty.count() == 0
    more = tricky.where("conv_id < 3").select("*", *[F.lit("x").alias(c) for c in ("kind", "copies", "part", "no", "segment", "audit")])
    assert as_rows(cr.summarise_repairs(cr.damaged(more))) == {k: v for k, v in brute(tricky.collect()).items() if k in (1, 2)}
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    alone = spark.createDataFrame([(gone, 0, "user", "Hi.")], tricky.schema)
    assert as_rows(cr.summarise_repairs(cr.damaged(alone))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
