"""Line dedup, mixing, exact dedup, HTML extraction, sharding and licence scans against brute force."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import exact_dedup, html_extract, license_scan, line_dedup, mixing, queries, sharding

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    rel = c.sql(queries.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    canon = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    at = [rel.columns.index(x) for x in cols]
    assert sorted(tuple(canon(r[x]) for x in cols) for r in df.collect()) == sorted(tuple(canon(r[i]) for i in at) for r in rel.fetchall())


def dedup_by_hand(rows):
    """Lines kept, by the true similarity of all pairs of lines."""
    first, lines = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for p, line in enumerate((t or "").split("\n")):
            if line.strip(WHITE) and line not in first:
                first[line] = (d, p)
                lines.append(line)
    sets = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {first[lines[i]] for i in range(len(lines)) if find(i) == i}


def test_line_dedup_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = dedup_by_hand(rows)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(got) == len(rows)
    wrong = 0
    for d, t in rows:
        lines = (t or "").split("\n")
        want = "\n".join(x for p, x in enumerate(lines) if not x.strip(WHITE) or (d, p) in kept)
        stay = sum((d, p) in kept for p in range(len(lines)))
        wrong += got[d].text != (want if stay else "")
    assert wrong <= 0.005 * len(rows)  # banding may miss a pair


def test_line_dedup_finds_edited_lines(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("etaoinshrdlu"), 6))
    rows = []
    for i in range(120):
        base = [word() for _ in range(50)]
        edited = list(base)
        edited[int(rng.integers(0, 50))] = word()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited))]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sum(r.n_kept == 0 for r in out if r.doc_id % 2)
    assert found >= 118 and all(r.n_kept == 1 for r in out if r.doc_id % 2 == 0)


def mixed_bands():
    """300 pairs of addresses that differ in their last character, and 300 one-word edits of one line."""
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("etaoinshrdlu"), n))
    lines = [f"https://{stem}{end}" for stem in (word(40) for _ in range(300)) for end in "ab"]
    base = [word(6) for _ in range(24)]
    for i in range(300):
        lines.append(" ".join([*base[: i % 24], word(6), *base[i % 24 + 1 :]]))
    return list(enumerate(lines))


def test_line_dedup_compares_large_mixed_bands(spark):
    rows = mixed_bands()
    kept = {d for d, _ in dedup_by_hand(rows)}
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if r.n_kept} == kept and len(kept) < 340


def test_line_dedup_of_lines_without_spaces(spark):
    """Tabs, addresses, Khmer, and lines whose distinct shingles are few."""
    rng = np.random.default_rng(9)
    word = lambda n, of="etaoinshrdlu": "".join(rng.choice(list(of), n))
    lines = ["-" * 40, "-" * 80]
    for i in range(30):
        for tail in ("\t".join(word(6) for _ in range(20)), word(120), word(120, "កខគឃងចឆជឈញ")):
            lines += [f"{i:02d}:{end}{tail}" for end in "01"]
    rows = list(enumerate(lines))
    kept = {d for d, _ in dedup_by_hand(rows)}
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in out if r.n_kept} == kept and len(kept) == 91


def test_line_dedup_edges(spark, docs, nothing, clashing):
    assert line_dedup.dedup_lines(nothing).count() == 0
    out = line_dedup.dedup_lines(clashing).collect()
    assert len(out) == docs.count()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[3].text is None and by[4].text == "" and by[5].n_lines == 0 and by[5].text == " \n\t "
    assert by[1].n_kept == 3 and by[2].text == "" or by[2].n_kept == 1
    assert sum(r.n_kept == 1 for r in out if r.doc_id == 7) == 2  # repeated rows are one document
    assert by[9].n_kept == 2 and by[6].n_kept == 1


def test_mixing(spark, docs, nothing, clashing):
    got = queries.op2_mixing(spark, SF).collect()
    again = queries.op2_mixing(spark, SF).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 2 * r.size
    # the shares by resharing the excess step by step
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    left, fixed = 1.5 * sum(size.values()), {}
    while True:
        open_ = [s for s in size if s not in fixed]
        unit = (left - sum(fixed.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > 2 * size[s]]
        if not over:
            break
        fixed |= {s: 2.0 * size[s] for s in over}
    want = fixed | {s: unit * weight[s] for s in size if s not in fixed}
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1
    assert mixing.planned(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    assert mixing.planned(clashing).count() == docs.count()
    # sources without a word have nothing to give
    blank = docs.withColumn("text", F.when(F.col("source") == "a", F.col("text")))
    for frame in (blank, docs.withColumn("text", F.lit(" "))):
        plan = mixing.planned(frame).select("source", "_mix.*").collect()
        assert len(plan) == docs.count() and all(r.taken == 0 and r.target == 0 for r in plan if r.source != "a" or frame is not blank)
        assert all(r.source == "a" for r in mixing.mixed(frame).collect())


def test_mixed_documents_follow_their_positions(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(1 + i % 7)), None, "s%d" % (i % 4), 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plan = {r.doc_id: r._mix for r in mixing.planned(docs).collect()}
    out = mixing.mixed(docs).collect()
    words = Counter()
    for r in out:
        words[r.doc_id] += len(r.text.split())
    assert all(words[i] == m.taken for i, m in plan.items())
    at = [min(c.position for c in plan[r.doc_id].copies) for r in out]
    assert all(0 <= x <= 1 for x in at)
    first = list(dict.fromkeys(r.doc_id for r in out))
    assert first == sorted(first, key=lambda i: (plan[i].position, i))


def test_binary_fuse():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 100, 3000):
        keys = np.unique(rng.integers(0, 2**60, n).astype(np.uint64))
        f = exact_dedup.BinaryFuse.build(keys)
        assert f.contains(keys).all()
        assert f.contains(rng.integers(0, 2**60, 20000).astype(np.uint64)).mean() < 0.01


def test_exact_dedup_edges(spark, docs, nothing, clashing):
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    got = exact_dedup.dedup(clashing, arrival, 3).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    for rows in by.values():
        ids = [r.doc_id for r in rows if r.doc_id is not None]
        assert {r.keep_id for r in rows} == {max(ids) if ids else None} and {r.group_size for r in rows} == {len(rows)}
        assert sum(r.kept for r in rows) == 1
    assert exact_dedup.dedup(nothing, arrival, 3).count() == 0
    assert exact_dedup.stay(docs, arrival, 3).count() == exact_dedup.stay(clashing, arrival, 3).count() == len(by)


def test_hits_of_equal_bytes_stay(spark):
    plain = spark.createDataFrame([(1, 0, "one"), (2, 1, "two")], "doc_id long, batch int, plain string")
    hits = spark.createDataFrame([(hashlib.sha256(b"one").hexdigest(), 0)], "digest string, snapshot int").withColumn("quick", F.xxhash64(F.lit("one")))
    same = plain.withColumn("plain", F.lit("one"))
    assert exact_dedup._same_bytes(same, hits, 1).count() == 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head><body class="page with-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy {0}</div><div id='cookie-notice'>We use cookies</div>
<article><h1>Head &amp; {0}</h1><p>First  par&lt;a&gt;graph
{0}<br>more <b>bold<p>Second &eacute;&#233; &copy;<div class="share">Share me</div><p>Third</p><form><input>Mail</form><section class="comments"><p>Nice!</p></section></article>
<aside><p>Related</p></aside><footer>&copy; {0}</footer></body></html>"""


def test_html_extraction(spark):
    rows = [(i, f"http://h.example.org/{i}", PAGE.format(f"n{i}")) for i in range(6)] + [(10, None, None), (11, "nonsense", ""), (12, "http://one.example/", "plain &lt; text"), (12, "http://one.example/", "plain &lt; text")]
    got = {r.page_id: r for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i].text == f"Head & n{i}\nFirst par<a>graph n{i} more bold\nSecond éé ©\nThird"
        assert got[i].n_chars == len(got[i].text)
    assert got[10].text == got[11].text == "" and got[12].text == "plain < text"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_pages(empty).count() == 0


def test_html_templates(spark):
    rows = [("h", i, PAGE.format(i) + ("<p>x</p>" * (i % 2))) for i in range(4)]
    t = html_extract.host_templates(spark.createDataFrame(rows, "host string, key long, html string")).first()
    assert {"article", "/article", "nav", "div class=ad", "footer"} <= set(t.template)
    assert "/p" not in t.template or t.template.count("/p") == 1


def test_html_own_elements_nest(spark):
    """An element that only some pages have ends itself, not the template's element of that name."""
    figure = "<div class=fig>F</div>"
    page = "<html><body><div id=page><nav class=m><i>menu</i></nav><article><p>a{0}</p>{1}<p>b{0}</p></article></div></body></html>"
    rows = [(i, f"http://h.example.org/{i}", page.format(i, figure if i == 0 else "")) for i in range(6)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join([f"a{i}", *(["F"] if i == 0 else []), f"b{i}"]) for i in range(6)}


def extracted(spark, pages, host="h.example.org"):
    rows = [(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)]
    found = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


def test_html_template_text_goes(spark):
    """A menu that no name tells is known by the host's other pages, and by nothing else."""
    page = "<html><body><div class=x9>Home | Login</div><div class=q><p>Story {0}</p><p>More</p></div></body></html>"
    other = "<html><body><div class=q><p>Home | Login</p><p>Alone</p></div></body></html>"
    pages = [page.format(i).replace("More", f"More {i}") for i in range(5)]
    assert extracted(spark, pages) == [f"Story {i}\nMore {i}" for i in range(5)]
    assert extracted(spark, pages[:2]) == [f"Home | Login\nStory {i}\nMore {i}" for i in range(2)]
    assert extracted(spark, [other]) == ["Home | Login\nAlone"]
    # pages that are all alike have no text of their own to tell from the template's
    assert extracted(spark, [pages[0]] * 4) == ["Home | Login\nStory 0\nMore 0"] * 4
    # text of an article stays, however often it occurs
    article = "<html><body><p>Menu</p><article><p>Same</p><p>{0}</p></article></body></html>"
    assert extracted(spark, [article.format(i) for i in range(5)]) == [f"Same\n{i}" for i in range(5)]


def test_html_names_inside_of_articles(spark):
    """A role word among others in a name counts inside of an article if the template has the element."""
    page = "<html><body><article><p>a{0}</p>{1}</article></body></html>"
    own = [page.format(i, f'<div class="related-research"><p>r{i}</p></div>' if i == 2 else "") for i in range(6)]
    assert extracted(spark, own) == [f"a{i}" + ("\nr2" if i == 2 else "") for i in range(6)]
    each = [page.format(i, f'<div class="ad-leaderboard">buy {i}</div>') for i in range(6)]
    assert extracted(spark, each) == [f"a{i}" for i in range(6)]
    plain = '<article><div class="entry-header"><h1>T</h1></div><p class="social-impact">s</p><div class="share-buttons">x</div><div class="ads">y</div></article>'
    assert html_extract.extract(plain, None) == "T\ns"
    side = '<div class="sidebar"><div class="u7">ad</div>LEAK</div><p>main</p>'
    assert html_extract.extract(side, {"div class=sidebar"}) == html_extract.extract(side, None) == "main"


def test_html_pages_listed_twice(spark):
    rows = [("h", i % 3, f"<html><body><i>{i % 3}</i></body></html>") for i in range(6)] + [("h", 7, "<html><body><u>1</u></body></html>")] * 2
    template = html_extract.host_templates(spark.createDataFrame(rows, "host string, key long, html string")).first().template
    assert {"html", "body", "/body", "/html", "i", "/i"} <= set(template) and "u" not in template


def test_html_pages_equal_a_plain_reading(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in queries.op7_html_extract(spark, SF).collect():
        body = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_sharding(spark, docs, nothing):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), docs):
        text = Counter((len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect())
        got = sharding.shard_documents(df, 40).collect()
        assert Counter((r.size, r.text_crc32) for r in got) == text
        n = Counter(r.shard for r in got)
        full = [n.get(s, 0) for s in range(40)]
        assert max(full) - min(full) <= 1 and sum(full) == df.count()
        for s in n:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
        assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert sharding.shard_documents(nothing, 40).count() == 0


def test_sharding_of_hot_groups(spark):
    """A third of all rows are copies, another third have no link: law, slots and groups hold."""
    rows = [(i, "same" if i % 3 == 0 else f"text {i}" if i % 3 == 1 else f"pair {i // 6}") for i in range(3000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    assert set(Counter(r.shard for r in got).values()) == {75}
    at = defaultdict(set)
    for r in got:
        at[dict(rows)[r.doc_id]].add(r.shard)
    assert len(at["same"]) <= 15 and sum(len(s) > 1 for t, s in at.items() if t.startswith("pair")) <= 15


def test_label_propagation_joins_groups(spark):
    rows = [(i, i // 4) for i in range(400)] + [(1000 + i, None) for i in range(100)]
    state = sharding.label_propagation(spark.createDataFrame(rows, "doc_id long, hub long"), 10)
    n = Counter(r.shard for r in state.collect())
    assert set(n.values()) == {50}
    assert sharding.cut_links(state) <= 9


def test_label_propagation_keeps_groups_whole(spark):
    """Groups of .6 of a shard stay whole; one of two and a half shards is cut twice."""
    sizes = [60] * 5 + [250]
    rows = [(1000 * g + i, g) for g, n in enumerate(sizes) for i in range(n)] + [(10_000 + i, None) for i in range(450)]
    state = sharding.label_propagation(spark.createDataFrame(rows, "doc_id long, hub long"), 10)
    got = state.collect()
    assert set(Counter(r.shard for r in got).values()) == {100}
    cut = sum(len({r.shard for r in got if r.doc_id // 1000 == g and r.hub is not None}) - 1 for g in range(6))
    assert sharding.cut_links(state) == cut and cut <= 4


def test_license_scan(spark, docs, nothing, clashing):
    mit = next(t for n, t in license_scan.KNOWN if n == "MIT" and t.startswith("MIT License"))
    rows = [
        (1, mit.replace("Copyright (c) holder", "Copyright (c) 2024 Jane Roe, all rights kept")), (2, mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace(".", " .")), (3, mit[:-40]),
        (4, "Text first.\nReleased under the MIT Licence!\nlast"), (5, "licensed under CC BY-NC 4.0"), (6, None), (7, ""), (4, "Text first.\nReleased under the MIT Licence!\nlast"),
    ]
    got = defaultdict(list)
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append((r.text_license, r.licenses, r.n_notices))
    assert got[1] == [("MIT", "MIT", 1)] and got[2][0][0] == "MIT" and got[3] == [(None, "", 0)]
    assert got[4] == [(None, "MIT", 1)] * 2 and got[5] == [("CC-BY-NC-4.0", "CC-BY-NC-4.0", 1)] and got[6] == got[7] == [(None, "", 0)]
    assert license_scan.scan(nothing).count() == 0 and license_scan.scan(clashing).count() == docs.count()
    assert all(any(a in license_scan.canonical_text(t) for a in ("licens", "permission", "redistribution", "public domain")) for _, t in license_scan.KNOWN)


def test_whole_licences(spark):
    """The texts whose digests are listed, where the system has them, and with other case, spaces and holders."""
    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [(name, (folder / file).read_text()) for file, name in names.items() if (folder / file).exists()]
    if not texts:
        pytest.skip("no licence texts on this system")
    rows = [(i, t) for i, (_, t) in enumerate(texts)] + [(100 + i, t.upper().replace("\n", " \n\t")) for i, (_, t) in enumerate(texts)]
    rows += [(200, texts[0][1] + " and one more word"), (201, texts[0][1][:-200])]
    got = {r.doc_id: r.text_license for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {200: None, 201: None} | {k + i: name for i, (name, _) in enumerate(texts) for k in (0, 100)}


def test_sharding_plans_stay_short(spark, monkeypatch):
    """What a round makes is written: no plan holds the plans of the rounds before it."""
    docs = spark.createDataFrame([(i, f"text {i % 90}") for i in range(400)], "doc_id long, text string")
    plans, write = [], sharding.stored
    monkeypatch.setattr(sharding, "stored", lambda df, *a: plans.append(df._jdf.queryExecution().toString()) or write(df, *a))
    assert sharding.shard_documents(docs, 4).count() == 400
    assert plans and not any("InMemoryTableScan" in x for x in plans)


@pytest.mark.parametrize("pairs", [5_000_000, 3_000])
def test_line_dedup_leaves_no_pair_of_a_large_bucket(spark, monkeypatch, pairs):
    """Every shingle is in eight lines or more, and each line is like one other: rounds of pivots end at once, and all pairs
    are found, in any number of passes."""
    for name, value in (("WHOLE", 4), ("PIVOTS_LINK", 1), ("BUCKETS_LINK", 1), ("PASS_PAIRS", pairs)):
        monkeypatch.setattr(line_dedup, name, value)
    rng = np.random.default_rng(8)
    block = lambda n: "".join(rng.choice(list("etaoinshrdlu"), n))
    heads, tails, middle = [block(14) for _ in range(8)], [block(14) for _ in range(8)], block(8)
    twins = [tuple(a + middle + b + end for end in "01") for a in heads for b in tails]
    nodes = spark.createDataFrame([(x,) for pair in twins for x in pair], "line string").withColumn("node", F.xxhash64("line"))
    named = {r.node: r.line for r in nodes.collect()}
    members = nodes.select(F.lit(1).cast("long").alias("key"), "node")
    edges = line_dedup.stored(spark.createDataFrame([], "u long, v long"), "none")
    found = line_dedup._exhausted(members, edges, nodes, 10)
    assert {frozenset((named[r.u], named[r.v])) for r in found.collect()} == set(map(frozenset, twins))
