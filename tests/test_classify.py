"""Features of records against plain Python, and held-out accuracy of the fitted classifier."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.operators import classify

SCHEMA = "label string, sources array<struct<name:string,type:string,entropy:double,is_pk:boolean>>, target struct<name:string,type:string,entropy:double>"
NOUNS = ("customer", "order", "product", "invoice", "employee", "account", "shipment", "store")
#: How targets of a label are named after their source, and the types of both.
LABELS = {
    "lower": ("{}_name", "{}_name_lower", "string", "string"), "upper": ("{}_code", "{}_code_upper", "string", "string"), "hash": ("{}_email", "{}_email_hash", "string", "string"), "masking": ("{}_phone", "masked_{}_phone", "string", "string"),
    "extract_year": ("{}_date", "{}_year", "date", "int"), "sum_agg": ("{}_amount", "total_{}_amount", "decimal", "decimal"), "threshold_flag": ("{}_rate", "is_high_{}", "decimal", "boolean"), "direct_copy": ("{}_status", "{}_status", "string", "string"),
}


def records(rng, n):
    out = []
    for i in range(n):
        label = sorted(LABELS)[i % len(LABELS)]
        source, target, a, b = LABELS[label]
        noun, prefix = rng.choice(NOUNS), rng.choice(("", "src_", "raw_", "stg_"))
        out.append((label, [(prefix + source.format(noun), a, rng.random() * 4, False)], (target.format(noun), b, rng.random() * 4)))
    return out


def test_features_equal_plain_python(spark):
    rng = random.Random(1)
    rows = records(rng, 12) + [("x", [], (None, None, None)), ("y", [("Cust_ID", "INT ", None, True), ("full name", "string", 2.0, None)], ("Full-Name cleaned", "string", 1.0))]
    got = classify.features(spark.createDataFrame(rows, SCHEMA)).collect()
    words = lambda name: [w for w in re.split(r"\W+", (name or "").lower().replace("_", " ")) if w]
    grams = lambda name: [f"#{w}#"[i : i + 3] for w in words(name) for i in range(len(w))]
    flags = lambda ws: [float(any(w == s + e for w in ws for s in stems.split(" ") for e in ("", "d", "ed"))) for _, stems in sorted(classify.KEYWORDS.items())]
    by = {(r.label, r.target.name, tuple(s.name for s in r.sources)): r for r in got}
    for label, sources, target in rows:
        r = by[label, target[0], tuple(s[0] for s in sources)]
        own = [w for s in sources for w in words(s[0])]
        e = [s[2] or 0.0 for s in sources]
        mean = sum(e) / len(e) if e else 0.0
        assert r.grams == ["s" + g for s in sources for g in grams(s[0])] + ["t" + g for g in grams(target[0])]
        assert r.source_flags == flags(own) and r.target_flags == flags(words(target[0]))
        assert r.types == [float(classify.TYPE_NUMBERS.get(sources[0][1].strip().lower(), 0)) if sources else 0.0, float(classify.TYPE_NUMBERS.get(target[1] or "", 0))]
        if sum(x[0] == label and x[2][0] == target[0] for x in rows) == 1:
            assert r.numbers == pytest.approx([mean, max(e, default=0.0), target[2] or 0.0, len(e), float(any(s[3] for s in sources)), (target[2] or 0.0) - mean, len(set(own) & set(words(target[0])))])


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    train, held = spark.createDataFrame(records(rng, 400), SCHEMA), spark.createDataFrame(records(rng, 160), SCHEMA)
    model = classify.fit(train, size=512, rounds=25)
    predicted = classify.predict(model, held)
    accuracy = {r.k: r.accuracy for r in classify.top_accuracy(predicted).collect()}
    assert accuracy[1] >= 0.95 and accuracy[3] >= accuracy[1]
    first = predicted.first()
    assert [x.place for x in first.ranked] == [1, 2, 3] and first.ranked[0].probability >= first.ranked[1].probability and predicted.columns == [*held.columns, "ranked"]
    assert classify.predict(model, held.where(F.lit(False))).count() == 0
