"""Operator 12 against brute force over all orders, and with hashes that tell nothing apart."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from weftline.llm import filter_audit, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    """(part, order, step) -> the counts, each order applied to the documents one by one."""
    lowest = {}
    for r in docs:
        if r.doc_id is not None:
            lowest[r.text or ""] = min(r.doc_id, lowest.get(r.text or "", r.doc_id))
    good = {r.doc_id for r in labels if r.quality == 1}
    toxic = {r.doc_id for r in labels if r.toxic == 1}
    parts = {}
    for r in docs:
        text = r.text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": r.doc_id is not None and r.doc_id > lowest[text],
        }
        parts.setdefault(r.lang or "", []).append((r.doc_id, {k for k, v in fails.items() if v}))
    out, shapley = {}, Counter()
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                before, left = left, [x for x in left if f not in x[1]]
                failing = sum(f in x[1] for x in rows)
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(before) - len(left), failing - len(gone), sum(x[1] == {f} for x in rows), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_rows(found):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in found.collect()}


def test_query_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "labels"))
    assert as_rows(queries.op12_filter_audit(spark, SF)) == brute(docs, labels)


@pytest.fixture(scope="module")
def tricky(spark):
    long = " ".join(f"w{i}" for i in range(4000))
    rows = [(1, "same text", "en"), (2, "same text", "de"), (2, "same text", "de"), (3, "same texT", "en"), (None, "same text", "en"), (4, "", None), (5, None, None), (6, "", "")]
    rows += [(10, long + "a", "en"), (11, long + "b", "en"), (12, long + "a", "en"), (13, "x" * 64, "en"), (14, "x" * 64, "en"), (15, "x" * 63 + "y", "en")]
    rows += [(20 + i, "copied # " * 3, "en" if i % 3 else None) for i in range(300)] + [(None, None, None)]
    labels = [(2, 1, 0), (2, 0, 1), (12, 1, 1), (25, 0, 1), (26, 1, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("block_hash", [F.xxhash64, lambda block: F.lit(7).cast("long"), lambda block: F.char_length(block).cast("long")])
def test_copies_nulls_and_colliding_hashes(tricky, block_hash):
    docs, labels = tricky
    want = brute(docs.collect(), [r for r in labels.collect() if r.doc_id is not None])
    assert as_rows(filter_audit.audit(docs, labels, block_hash=block_hash)) == want


def test_refinement_drops_single_documents(tricky):
    docs, _ = tricky
    classes, n = filter_audit.refined(filter_audit.measured(docs))
    assert n == 5 and sorted(r.low for r in classes.collect()) == [1, 4, 10, 13, 20]


def test_edges(spark, docs, nothing, clashing):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert filter_audit.audit(nothing, labels).count() == 0
    want = brute(docs.collect(), labels.collect())
    assert as_rows(filter_audit.audit(docs, labels)) == want
    assert as_rows(filter_audit.audit(clashing, labels.withColumn("id", F.lit(1)))) == want
    assert as_rows(filter_audit.audit(docs, labels.limit(0))) == brute(docs.collect(), [])
