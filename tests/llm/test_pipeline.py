"""The pipeline against a brute-force version of each stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from test_table_operators import WHITE, dedup_by_hand
from test_text_operators import fingerprint, reachable
from weftline.llm import bpe, quality_rules
from weftline.llm.queries import bpe_path

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    frame = docs
    kept = quality_rules.SCHEMA.split(", ").index("kept boolean")
    rows = {d: t for d, t in rows.items() if quality_rules.measure(t)[kept]}
    frame = corpus_pipeline.quality(spark, frame, SF)
    assert {r.doc_id: r.text for r in frame.collect()} == rows and frame.columns == docs.columns

    stay = dedup_by_hand(list(rows.items()))
    cut = {d: "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip(WHITE) or (d, p) in stay) for d, t in rows.items()}
    rows = {d: t for d, t in cut.items() if t.strip(WHITE)}
    frame = corpus_pipeline.lines(spark, frame, SF)
    assert {r.doc_id: r.text for r in frame.collect()} == rows and frame.columns == docs.columns

    root = reachable({d: fingerprint(t) for d, t in rows.items()})
    rows = {d: t for d, t in rows.items() if root[d] == d}
    frame = corpus_pipeline.near_duplicates(spark, frame, SF)
    assert {r.doc_id: r.text for r in frame.collect()} == rows and frame.columns == docs.columns

    mixed = corpus_pipeline.mix(spark, frame, SF)
    out = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert mixed.columns == docs.columns and all(rows[d].startswith(t) for d, t in out)
    own = bpe.WordBpe(bpe_path())
    want = Counter((d, own.encode(t)) for (d, t), n in out.items() for _ in range(n))
    assert Counter((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.encode(spark, mixed, SF).collect()) == want
    assert Counter((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
