"""Quality rules, BPE, SimHash and toxicity against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from weftline.llm import bpe, quality_rules, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(queries.BPE_FILE)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            inside.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    repeat = len(inside)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, repeat, len(words) < 10 or 100 * repeat > 20 * len(words)


def test_quality_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op6_quality_rules(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_quality_verdicts():
    names = [x.split()[0] for x in quality_rules.SCHEMA.split(", ")]
    judge = lambda t: dict(zip(names, quality_rules.measure(t)))
    clean = " ".join(f"w{i}" for i in range(200))
    assert judge(clean)["kept"] and not judge(None)["kept"] and not judge("")["kept"]
    line = "this is one line of some words that repeats\n"
    assert not judge(line * 20)["kept"]
    assert judge(clean + "\n" + clean.replace("w", "v"))["kept"]
    rng = random.Random(3)
    for _ in range(200):
        t = "".join(rng.choice("ab #\n\t\x0b  ") for _ in range(rng.randint(0, 120)))
        m = judge(t)
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"], m["base_failed"]) == base(t)


def test_quality_edges(docs, nothing, clashing):
    assert quality_rules.with_quality(nothing).count() == 0
    assert quality_rules.with_quality(docs).count() == docs.count()
    out = quality_rules.with_quality(clashing)
    assert out.columns.count("kept") == 1 and out.schema["kept"].dataType.simpleString() == "boolean"
    assert set(quality_rules.filter_quality(docs).columns) == set(docs.columns)
    assert quality_rules.filter_quality(clashing).count() == quality_rules.filter_quality(docs).count()


def test_bpe_equals_the_library():
    lib, own = Tokenizer.from_file(PATH), bpe.WordBpe(PATH)
    rng = random.Random(5)
    alphabet = "abcXYZ 'sre019 \t\n\x0b\x1c\x85\xa0 ßÄéΣσςİıﬁ中ठ😀<|>#*́\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a<|startoftext|>b <|endoftext|>", "x" * 3000, "ab" * 600 + "!" * 700, "don't I'LL they'RE", "", None]
    for t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        raw = own.encode(t)
        assert np.frombuffer(raw, "<u4").tolist() == ids
        assert own.decode(raw).decode() == lib.decode(ids, skip_special_tokens=False)


def test_bpe_short_and_long_words_agree():
    own = bpe.WordBpe(PATH)
    rng = random.Random(2)
    for _ in range(300):
        ids = [own.inner[b] for b in bytes(rng.choice(b"aeiorstnl") for _ in range(rng.randint(1, 80)))]
        assert own._merge_short(list(ids)) == own._merge_long(list(ids))


def test_bpe_query(spark, docs, nothing, clashing):
    lib = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op3_bpe(spark, SF).collect():
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digest_documents(nothing, PATH).count() == 0
    assert bpe.digest_documents(clashing, PATH).count() == docs.count()
    out = bpe.decode_documents(bpe.encode_documents(clashing, PATH), PATH).collect()
    assert len(out) == docs.count() and all((r.n_tokens == 0) == (not (r.text or "").strip()) for r in out)
    assert all(r.decoded == lib.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False) for r in out)


def fingerprint(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints):
    """Smallest id reachable over links of three bits or fewer, by search from each id in order."""
    root, ids = {}, sorted(prints)
    for i in ids:
        if i in root:
            continue
        root[i], todo = i, [i]
        while todo:
            x = todo.pop()
            for j in ids:
                if j not in root and (prints[x] ^ prints[j]).bit_count() <= 3:
                    root[j] = i
                    todo.append(j)
    return root


def test_simhash_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    root = reachable(prints)
    got = queries.op8_simhash(spark, SF).collect()
    assert len(got) == len(texts)
    assert all(r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == root[r.doc_id] for r in got)


def test_pigeonring_loses_no_pair(spark):
    rng = random.Random(1)
    values = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(12):  # neighbours at every distance, and chains of them
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            values.add(y)
            x = y if rng.random() < 0.3 else x
    values |= {0, 2**64 - 1, 1, 2**63, 2**63 + 1}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    got = {(r.u, r.v) for r in simhash.near_pairs(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    want = {(max(a, b), min(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and want


def test_simhash_edges(docs, nothing, clashing):
    assert simhash.near_duplicates(nothing).count() == 0
    got = simhash.near_duplicates(clashing).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[5] == 3
    assert next(r.component_id for r in got if r.doc_id is None and r.fp == 0) == 3
    assert simhash.drop_near_duplicates(clashing).count() == simhash.drop_near_duplicates(docs).count()
    kept = simhash.drop_near_duplicates(docs).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 6, 7, 8, 9]


def test_one_document_of_each_component_stays(spark):
    """Null and repeated ids do not stand for one document."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(None, text(i)) for i in range(5)] + [(None, text(0)), (7, text(1)), (8, text(6)), (8, text(7)), (8, text(7)), (9, text(6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect())
    assert got == Counter([(None, text(i)) for i in (0, 2, 3, 4)] + [(7, text(1)), (8, text(6)), (8, text(7))])


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    chain = toxicity.train(docs, train)
    got = toxicity.score(docs.join(test, "doc_id"), chain).select("toxic", "is_toxic").collect()
    clean = [r.is_toxic for r in got if r.toxic == 0]
    bad = [r.is_toxic for r in got if r.toxic == 1]
    assert sum(clean) / len(clean) < 0.05 and sum(bad) / len(bad) > 0.6
    assert chain.names == ("insult", "contempt", "toxic")
    # later models see earlier probabilities
    assert [len(w) - len(chain.features) for w in chain.weights] == [1, 2, 3]


def test_toxicity_chain_by_hand():
    """Each link is fitted beside probabilities that were made without the document's fold; the fit is a stationary point."""
    rng = np.random.default_rng(3)
    toxic = (rng.random(300) < 0.3).astype(float)
    words = []
    for t in toxic:
        own = {w for w in ("fine", "good", "mud" if t else "sun", "dull" if t else "bright") if rng.random() < 0.8}
        own |= {m for m in ("*insult", "*contempt") if rng.random() < (0.5 if t else 0.1)}
        words.append(own | {f"n{rng.integers(0, 40)}"})
    chain = toxicity.fit_chain(words, toxic)
    x = np.array([[1.0, *[f in own for f in chain.features]] for own in words])
    labels = [toxic * np.array([m in own for own in words]) for m in ("*insult", "*contempt")] + [toxic]
    early, fold = [], np.arange(300) % toxicity.FOLDS
    for y, weights in zip(labels, chain.weights):
        full = np.column_stack([x, *early])
        p = 1 / (1 + np.exp(-full @ np.array(weights)))
        shrink = np.r_[1e-6, np.full(full.shape[1] - 1, toxicity.RIDGE)]
        assert np.abs(full.T @ (y - p) - shrink * np.array(weights)).max() < 1e-3
        made = np.zeros(300)
        for f in range(toxicity.FOLDS):
            made[fold == f] = 1 / (1 + np.exp(-full[fold == f] @ toxicity._logistic(full[fold != f], y[fold != f])))
        early.append(made)
    assert 0.2 <= chain.threshold <= 0.9


def test_toxicity_edges(spark, docs, nothing, clashing):
    labels = spark.createDataFrame([(1, None), (2, 0), (None, 1)], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels)
    out = toxicity.score(clashing, chain)
    assert out.count() == docs.count() and out.columns.count("p_toxic") == 1
    assert not any(r.is_toxic for r in out.select("is_toxic").collect())
    assert toxicity.score(nothing, chain).count() == 0
    empty = toxicity.train(nothing, labels.limit(0))
    assert toxicity.score(docs, empty).count() == docs.count()


def test_bpe_remembers_rare_chunks():
    """Two hundred thousand other chunks between two of a kind do not make a worker forget the first."""
    coder = bpe.WordBpe(queries.bpe_path())
    text = " ".join(f"w{i}" for i in range(200_000))
    first = coder.encode(text)
    asked, chunk = [], coder._chunk
    coder._chunk = lambda x: asked.append(x) or chunk(x)
    assert coder.encode(text) == first and not asked
