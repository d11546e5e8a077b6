"""SQL of the matcher's scores over the columns of a catalog, written from the formulas and not from the plans."""

from __future__ import annotations

from ..operators import names

_NUMBER = "TRY_CAST(regexp_replace(replace(value, ',', ''), '%$', '') AS DOUBLE)"


def _values(pairs) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in p) + ")" for p in pairs) + ")"


def profile_ctes(cells: str) -> str:
    """CTEs after cells, norm and counts: vals (a row a cell), prof (a row a column), and scored (a row a pair of one kind)."""
    quantiles = "[" + ", ".join(f"{round(0.05 * i, 2)}" for i in range(1, 20)) + "]"
    return f"""{cells},
        vals AS (SELECT "table" AS t, "column" AS c, value, {_NUMBER} AS x FROM norm),
        kinds AS (SELECT t, c, count(*) AS total_rows, count(value) AS valid, count(x) AS xs,
                  CASE WHEN count(value) = 0 THEN 'unknown' WHEN count(x) >= 0.97 * count(value) THEN 'numeric' ELSE 'categorical' END AS kind FROM vals GROUP BY t, c),
        shares AS (SELECT "table" AS t, "column" AS c, -sum(n / valid * ln(n / valid + 1e-12)) AS entropy FROM counts JOIN kinds ON t = "table" AND c = "column" WHERE value IS NOT NULL GROUP BY 1, 2),
        quants AS (SELECT t, c, quantile_cont(x, {quantiles}) AS qs, quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.99) AS q99,
                   min(x) AS lo, max(x) AS hi FROM vals JOIN kinds USING (t, c) WHERE kind = 'numeric' GROUP BY t, c),
        prof AS (SELECT t, c, kind, any_value(total_rows) AS total_rows, any_value(valid) AS valid, any_value((total_rows - valid) / total_rows) AS nulls,
                 CASE WHEN kind = 'numeric' THEN count(DISTINCT x) ELSE count(DISTINCT value) END AS nd,
                 CASE WHEN kind = 'numeric' THEN 0.0::DOUBLE ELSE any_value(entropy) END AS entropy, any_value(lo) AS lo, any_value(hi) AS hi, any_value(qs) AS qs, any_value(q01) AS q01, any_value(q99) AS q99,
                 CASE WHEN kind = 'categorical' THEN avg(length(value)) ELSE 0.0::DOUBLE END AS al, CASE WHEN kind = 'categorical' THEN stddev_pop(length(value)) ELSE 0.0::DOUBLE END AS sl,
                 CASE WHEN kind = 'numeric' THEN avg(CASE WHEN x = floor(x) THEN 1.0::DOUBLE ELSE 0 END) FILTER (x IS NOT NULL) ELSE 0.0::DOUBLE END AS ints,
                 CASE WHEN kind = 'numeric' AND any_value(xs) >= 10 THEN avg(CASE WHEN x < q25 - 1.5 * (q75 - q25) OR x > q75 + 1.5 * (q75 - q25) THEN 1.0::DOUBLE ELSE 0 END) FILTER (value IS NOT NULL) ELSE 0.0::DOUBLE END AS outs
                 FROM vals JOIN kinds USING (t, c) LEFT JOIN quants USING (t, c) LEFT JOIN shares USING (t, c) GROUP BY t, c, kind),
        pairs AS (SELECT l.t AS lt, l.c AS lc, r.t AS rt, r.c AS rc, l.kind AS kind, l, r FROM prof l JOIN prof r ON l.t < r.t AND l.kind = r.kind AND l.kind <> 'unknown'),
        keys AS (SELECT DISTINCT t, c, CASE WHEN x IS NOT NULL THEN printf('%.6f', round(x, 6)) ELSE value END AS v FROM vals WHERE value IS NOT NULL),
        met AS (SELECT lt, lc, rt, rc, count(*) AS shared FROM pairs JOIN keys a ON a.t = lt AND a.c = lc JOIN keys b ON b.t = rt AND b.c = rc AND b.v = a.v GROUP BY ALL),
        tops AS (SELECT "table" AS t, "column" AS c, value, n / sum(n) OVER (PARTITION BY "table", "column") AS f FROM counts WHERE value IS NOT NULL
                 QUALIFY row_number() OVER (PARTITION BY "table", "column" ORDER BY n DESC, value) <= 100),
        norms AS (SELECT t, c, sqrt(sum(f * f)) AS norm, sum(f) AS mass FROM tops GROUP BY t, c),
        freqs AS (SELECT lt, lc, rt, rc, sum(a.f * b.f) AS dot, sum(least(a.f, b.f)) AS low FROM pairs JOIN tops a ON a.t = lt AND a.c = lc JOIN tops b ON b.t = rt AND b.c = rc AND b.value = a.value WHERE kind = 'categorical' GROUP BY ALL),
        cosines AS (SELECT lt, lc, rt, rc, dot / nullif(a.norm * b.norm, 0) AS mcv_cos, low / nullif(a.mass + b.mass - low, 0) AS weighted FROM freqs JOIN norms a ON a.t = lt AND a.c = lc JOIN norms b ON b.t = rt AND b.c = rc),
        ends AS (SELECT lt, lc, rt, rc, least(l.q01, r.q01) AS a, greatest(l.q99, r.q99) AS b FROM pairs WHERE kind = 'numeric'),
        sides AS (SELECT lt, lc, rt, rc, 'l' AS side, x, a, b FROM ends JOIN vals ON t = lt AND c = lc WHERE x IS NOT NULL UNION ALL SELECT lt, lc, rt, rc, 'r', x, a, b FROM ends JOIN vals ON t = rt AND c = rc WHERE x IS NOT NULL),
        bins AS (SELECT lt, lc, rt, rc, CASE WHEN b > a THEN least(floor((greatest(least(x, b), a) - a) * 40 / (b - a)), 39) ELSE 0 END AS bin, count(*) FILTER (side = 'l') AS ln, count(*) FILTER (side = 'r') AS rn FROM sides GROUP BY ALL),
        hists AS (SELECT lt, lc, rt, rc, sum(least(lp, rp)) AS hist FROM (SELECT lt, lc, rt, rc, ln / sum(ln) OVER p AS lp, rn / sum(rn) OVER p AS rp FROM bins WINDOW p AS (PARTITION BY lt, lc, rt, rc)) GROUP BY lt, lc, rt, rc),
        raw AS (SELECT lt, lc, rt, rc, kind, l, r, coalesce(shared, 0) AS s, coalesce(mcv_cos, 0.0) AS mcv_cos, coalesce(weighted, 0.0) AS weighted_jacc,
                greatest(l.hi, r.hi) - least(l.lo, r.lo) AS span, least(l.hi - l.lo, r.hi - r.lo) AS narrow, greatest(l.hi - l.lo, r.hi - r.lo) AS wide, least(l.hi, r.hi) - greatest(l.lo, r.lo) AS overlap, hist
                FROM pairs LEFT JOIN met USING (lt, lc, rt, rc) LEFT JOIN cosines USING (lt, lc, rt, rc) LEFT JOIN hists USING (lt, lc, rt, rc)),
        signals AS (SELECT lt, lc, rt, rc, kind, mcv_cos, weighted_jacc, s / least(l.nd, r.nd)::DOUBLE AS contain, s / (l.nd + r.nd - s)::DOUBLE AS jacc,
                1 - abs(ln(greatest(2, l.nd)) - ln(greatest(2, r.nd))) / greatest(ln(greatest(2, l.nd)), ln(greatest(2, r.nd))) AS n_distinct_sim, 1 - abs(l.nulls - r.nulls) AS null_sim,
                greatest(0, 1 - abs(l.entropy - r.entropy) / greatest(l.entropy, r.entropy, 1e-9)) AS entropy_sim,
                CASE WHEN l.al = 0 AND r.al = 0 THEN 0.5 ELSE greatest(0, 1 - 0.7 * abs(l.al - r.al) / greatest(l.al, r.al, 1e-9) - 0.3 * abs(l.sl - r.sl) / greatest(l.sl, r.sl, 1e-9)) END AS len_profile,
                CASE WHEN least(l.valid, r.valid) < 2 THEN 0 WHEN greatest(l.q99, r.q99) <= least(l.q01, r.q01) THEN 1 ELSE coalesce(hist, 0) END AS hist,
                CASE WHEN kind <> 'numeric' OR least(l.valid, r.valid) < 5 THEN 0 ELSE
                  greatest(0, 1 - list_sum(list_transform(range(1, 20), lambda i: abs(l.qs[i] - r.qs[i]))) / 19 / greatest(l.qs[19] - l.qs[1], r.qs[19] - r.qs[1], abs(l.qs[10] - r.qs[10]), 1e-9)) END AS cdf,
                CASE WHEN kind <> 'numeric' THEN 1 WHEN overlap < 0 THEN 0 WHEN narrow = 0 THEN 1 ELSE least(1, overlap / narrow) END AS range_sim,
                1 - abs(l.ints - r.ints) AS int_sim, 1 - abs(l.outs - r.outs) AS outlier_sim,
                CASE WHEN kind <> 'numeric' THEN 0 WHEN narrow <= 0 THEN 1 ELSE greatest(0, 1 - log10(wide / narrow) / 3) END AS scale_sim FROM raw),
        best AS (SELECT *, CASE WHEN kind = 'categorical' THEN greatest(mcv_cos, weighted_jacc, contain, jacc) ELSE greatest(hist, cdf, contain, 0.6 * hist + 0.4 * cdf) END AS ev FROM signals),
        scored AS (SELECT *, round(greatest(0, least(1, CASE WHEN ev < 0.03 THEN 0.04 * n_distinct_sim + 0.04 * null_sim
                WHEN kind = 'categorical' THEN 0.36 * ev + 0.16 * mcv_cos + 0.14 * weighted_jacc + 0.10 * contain + 0.08 * jacc + 0.07 * n_distinct_sim + 0.04 * null_sim + 0.03 * entropy_sim + 0.02 * len_profile
                ELSE 0.32 * ev + 0.16 * hist + 0.12 * cdf + 0.10 * contain + 0.08 * range_sim + 0.08 * n_distinct_sim + 0.05 * null_sim + 0.03 * int_sim + 0.02 + 0.02 * outlier_sim + 0.02 * scale_sim END)), 4) AS value_score FROM best)"""


SIGNALS = ("contain", "jacc", "mcv_cos", "weighted_jacc", "n_distinct_sim", "null_sim", "entropy_sim", "len_profile", "hist", "cdf", "range_sim", "int_sim", "outlier_sim", "scale_sim")


def value_scores(cells: str) -> str:
    return f"WITH {profile_ctes(cells)} SELECT lt, lc, rt, rc, value_score::DOUBLE AS value_score, NULL::VARCHAR AS reason, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in SIGNALS)} FROM scored"


#: Whether one name's id-less stem is part of the other's, for names x and y in lower case.
_STEM = "trim(CASE WHEN {0} LIKE '%\\_id' ESCAPE '\\' THEN left({0}, -3) WHEN {0} LIKE '%id' AND length({0}) > 2 THEN left({0}, -2) ELSE {0} END, '_')"


def join_name(x: str, y: str) -> str:
    sx, sy = _STEM.format(x), _STEM.format(y)
    tokens = [f"list_distinct(list_filter(string_split_regex({n}, '[^a-z0-9]+'), lambda t: t <> ''))" for n in (x, y)]
    shared = f"len(list_intersect({tokens[0]}, {tokens[1]}))"
    return f"""CASE WHEN {x} = {y} THEN 1.0 WHEN replace({x}, '_', '') = replace({y}, '_', '') THEN 0.95
        WHEN {x} LIKE '%id' AND {y} LIKE '%id' THEN CASE WHEN {sx} <> '' AND {sy} <> '' AND (contains({sx}, {sy}) OR contains({sy}, {sx})) THEN 0.88 ELSE 0.48 END
        ELSE {shared} / (len({tokens[0]}) + len({tokens[1]}) - {shared})::DOUBLE END"""


def name_scores(columns: list[str], held: tuple[tuple[str, str], ...] = ()) -> str:
    """All name scores of pairs of names that repeat no token, by joins of a table of tokens with tables of synonyms,
    abbreviations and conflicts."""
    synonyms = sorted({p for k, vs in names.SYNONYMS.items() for v in vs for p in ((k, v), (v, k))})
    opposites = sorted({(kind, *p) for kind, pairs in names.PAIRS.items() for x, y in pairs for p in ((x, y), (y, x))})
    jaccard = lambda sets: f"""SELECT p.a, p.b, coalesce(s, 0) / nullif(na.n + nb.n - coalesce(s, 0), 0)::DOUBLE AS j FROM pairs p JOIN (SELECT name, count(*) AS n FROM {sets} GROUP BY name) na ON na.name = a
        JOIN (SELECT name, count(*) AS n FROM {sets} GROUP BY name) nb ON nb.name = b LEFT JOIN (SELECT x.name AS a, y.name AS b, count(*) AS s FROM {sets} x JOIN {sets} y USING (t) GROUP BY ALL) USING (a, b)"""  # noqa: E731
    part = "(contains(replace(lower(a), '_', ''), replace(lower(b), '_', '')) OR contains(replace(lower(b), '_', ''), replace(lower(a), '_', '')))"
    return f"""
        WITH cols(name) AS (FROM {_values((c,) for c in columns)} {" ".join(f"UNION SELECT {c} FROM {t} WHERE {c} IS NOT NULL" for t, c in held)}), syn(k, v) AS {_values(synonyms)}, abbr(k, v) AS {_values(sorted(names.ABBREVIATIONS.items()))},
        opp(kind, x, y) AS {_values(opposites)}, units(u) AS {_values((u,) for u in names.UNITS)}, weights(kind, w) AS (VALUES {", ".join(f"('{k}', {w}::DOUBLE)" for k, w in names.PENALTIES.items())}),
        pairs AS (SELECT x.name AS a, y.name AS b FROM cols x JOIN cols y ON x.name < y.name),
        simple AS (SELECT DISTINCT name, t FROM (SELECT name, unnest(string_split_regex(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+')) AS t FROM cols) WHERE t <> ''),
        stems AS (SELECT name, t FROM simple UNION SELECT name, CASE WHEN t LIKE '%ies' THEN left(t, -3) || 'y' WHEN t LIKE '%ses' OR t LIKE '%xes' THEN left(t, -2) WHEN t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, -1) ELSE t END FROM simple),
        wide AS (SELECT name, t FROM stems UNION SELECT name, v FROM stems JOIN syn ON k = t),
        parts AS (SELECT name, lower(unnest(regexp_extract_all(regexp_replace(name, '[_-]', ' ', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'))) AS t FROM cols),
        long AS (SELECT DISTINCT name, unnest(string_split(coalesce(v, t), ' ')) AS t FROM parts LEFT JOIN abbr ON k = t),
        every AS (SELECT name, t FROM long UNION SELECT name, t FROM parts),
        plain AS ({jaccard('simple')}), meant AS ({jaccard('wide')}), spelt AS ({jaccard('long')}),
        grams AS (SELECT DISTINCT name, substr(w, i::INT, 3) AS t FROM (SELECT name, w, unnest(range(1, greatest(1, length(w) - 2) + 1)) AS i FROM (SELECT name, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS w FROM cols))),
        chars AS ({jaccard('grams')}),
        inner_share AS (SELECT a, b, (SELECT count(*) FROM simple x JOIN simple y USING (t) WHERE x.name = a AND y.name = b) / least((SELECT count(*) FROM simple WHERE name = a), (SELECT count(*) FROM simple WHERE name = b))::DOUBLE AS c FROM pairs),
        clashes AS (
          SELECT DISTINCT a, b, kind FROM pairs JOIN parts p ON p.name = a JOIN opp ON x = p.t JOIN parts q ON q.name = b AND q.t = y
          UNION SELECT a, b, 'unit' FROM pairs WHERE EXISTS (FROM parts JOIN units ON u = t WHERE name = a AND t NOT IN (SELECT t FROM parts WHERE name = b)) AND EXISTS (FROM parts JOIN units ON u = t WHERE name = b AND t NOT IN (SELECT t FROM parts WHERE name = a))),
        deep AS (
          SELECT DISTINCT a, b, kind FROM pairs JOIN every p ON p.name = a JOIN opp ON x = p.t JOIN every q ON q.name = b AND q.t = y
          UNION SELECT a, b, 'unit' FROM pairs WHERE EXISTS (FROM every JOIN units ON u = t WHERE name = a AND t NOT IN (SELECT t FROM every WHERE name = b)) AND EXISTS (FROM every JOIN units ON u = t WHERE name = b AND t NOT IN (SELECT t FROM every WHERE name = a))),
        told AS (SELECT a, b, string_agg(kind, ',' ORDER BY kind) AS conflicts FROM clashes GROUP BY a, b), fines AS (SELECT a, b, least(1, sum(w)) AS fine FROM deep JOIN weights USING (kind) GROUP BY a, b)
        SELECT a, b, round(({join_name('lower(a)', 'lower(b)')})::DOUBLE, 9) AS join_name,
               round(greatest(plain.j, 0.40 * plain.j + 0.25 * c + 0.20 * coalesce(chars.j, 0) + 0.15 * CASE WHEN contains(lower(a), lower(b)) OR contains(lower(b), lower(a)) THEN 0.15 ELSE 0 END)::DOUBLE, 9) AS lexical,
               round(least(1, greatest(plain.j, meant.j) + CASE WHEN {part} THEN 0.3 ELSE 0 END)::DOUBLE, 9) AS bridge, round((spelt.j * (1 - coalesce(fine, 0)))::DOUBLE, 9) AS name, coalesce(conflicts, '') AS conflicts
        FROM pairs JOIN plain USING (a, b) JOIN meant USING (a, b) JOIN spelt USING (a, b) JOIN chars USING (a, b) JOIN inner_share USING (a, b) LEFT JOIN told USING (a, b) LEFT JOIN fines USING (a, b)"""


def join_edges(cells: str, columns: list[tuple[str, str, str, bool, bool]], tail: str = "SELECT * FROM final") -> str:
    """Single-column edges, or what tail makes of them. columns: table, column, declared type, whether a primary and whether a foreign key."""
    cat = "(VALUES " + ", ".join(f"('{t}', '{c}', '{kind}', {pk}, {fk})" for t, c, kind, pk, fk in columns) + ")"
    number, text, date = (lambda x, f=f: f"{x} IN ({', '.join(repr(n) for n in f)})" for f in (
        ("int", "integer", "bigint", "float", "double", "decimal", "number", "numeric"), ("string", "varchar", "text", "char", "clob"), ("date", "datetime", "timestamp", "time")))
    types = f"CASE WHEN a.kind = b.kind THEN 1.0 WHEN {number('a.kind')} AND {number('b.kind')} THEN 0.95 WHEN {date('a.kind')} AND {date('b.kind')} THEN 0.93 WHEN {text('a.kind')} AND {text('b.kind')} THEN 0.90 ELSE 0 END"
    # all columns but primary keys may be null, and primary keys are unique
    limits = """0.52 + CASE WHEN a.pk AND b.fk OR b.pk AND a.fk THEN 0.34 WHEN a.pk AND b.pk THEN 0.17 WHEN a.fk AND b.fk THEN 0.09 ELSE 0 END
        + CASE WHEN a.pk AND b.pk THEN 0.08 WHEN a.pk <> b.pk THEN -0.10 ELSE -0.01 END + CASE WHEN a.pk <> b.pk THEN -0.05 ELSE 0.02 END"""
    return f"""
        WITH RECURSIVE {profile_ctes(cells)}, cat(t, c, kind, pk, fk) AS {cat},
        usable AS (SELECT cat.*, total_rows, nd / valid AS ratio FROM cat JOIN prof USING (t, c) WHERE valid > 0 AND nulls <= 0.95 AND NOT (nd <= 1 AND valid > 20)),
        typed AS (SELECT a.t AS lt, a.c AS lc, b.t AS rt, b.c AS rc, a, b, {types} AS type_score, coalesce(value_score, 0) AS value_score, {join_name('lower(a.c)', 'lower(b.c)')} AS name_score, round(least(1, {limits}), 4) AS cons,
                a.pk AND b.fk OR b.pk AND a.fk AS related FROM usable a JOIN usable b ON a.t < b.t LEFT JOIN scored s ON s.lt = a.t AND s.lc = a.c AND s.rt = b.t AND s.rc = b.c),
        gated AS (SELECT *, 0.30 * name_score + 0.36 * value_score + 0.14 * type_score + 0.20 * cons AS raw FROM typed WHERE type_score >= 0.20 AND (value_score >= 0.08 OR a.pk OR a.fk OR b.pk OR b.fk)),
        rated AS (SELECT *, round((CASE WHEN related AND value_score > 0.20 THEN greatest(raw, 0.90) ELSE raw END * least(1, 0.72 + ln(greatest(2, least(a.total_rows, b.total_rows))) / 10))::DOUBLE, 4) AS first FROM gated),
        kept AS (SELECT * FROM rated WHERE first >= 0.58),
        points AS (SELECT lt AS t, lc AS c, rt AS pt, rc AS pc FROM kept WHERE b.pk UNION SELECT rt, rc, lt, lc FROM kept WHERE a.pk),
        edges AS (SELECT *, NOT related AND EXISTS (FROM points p JOIN points q ON p.pt = q.pt AND p.pc = q.pc WHERE p.t = lt AND p.c = lc AND q.t = rt AND q.c = rc) AS clash FROM kept),
        final AS (SELECT lt AS left_table, lc AS left_cols, rt AS right_table, rc AS right_cols, CASE WHEN a.ratio >= 0.98 AND b.ratio >= 0.98 THEN '1:1' WHEN a.ratio >= 0.98 THEN '1:N' WHEN b.ratio >= 0.98 THEN 'N:1' ELSE 'N:M' END AS cardinality,
                CASE WHEN a.pk AND b.fk AND NOT (b.pk AND a.fk) THEN 'left_parent' WHEN b.pk AND a.fk AND NOT (a.pk AND b.fk) THEN 'right_parent' WHEN a.ratio >= 0.98 AND b.ratio < 0.98 THEN 'left_parent' WHEN b.ratio >= 0.98 AND a.ratio < 0.98 THEN 'right_parent' ELSE 'undirected' END AS direction,
                CASE WHEN clash THEN round(first * 0.80, 4) ELSE first END AS confidence,
                concat_ws(',', CASE WHEN related THEN 'pk_fk_relation' END, CASE WHEN a.pk AND b.pk THEN 'pk_pk' END, CASE WHEN a.pk <> b.pk THEN 'unique_mismatch' END, CASE WHEN a.pk <> b.pk THEN 'nullable_mismatch' END, CASE WHEN clash THEN 'sibling_fk_collision' END) AS reasons, 'single' AS kind FROM edges
                QUALIFY row_number() OVER (PARTITION BY lt, rt ORDER BY CASE WHEN clash THEN round(first * 0.80, 4) ELSE first END DESC, lc, rc) <= 5)
        {tail}"""


def composite_ctes(columns: list[tuple[str, str, str, bool, bool]], sources: dict[str, str] | None = None) -> str:
    """Edges of two and three column pairs (composites), by counting every combination's tuples. Needs join_edges' CTEs."""
    names: dict[str, list[str]] = {}
    for t, c, *_ in columns:
        names.setdefault(t, []).append(c)
    source = lambda t: (sources or {}).get(t, t)
    wide = "\n          UNION ALL ".join(
        f"SELECT '{t}' AS t, rid, '{c}' AS c, nullif(lower(trim(CAST({c} AS VARCHAR))), '') AS v FROM (SELECT row_number() OVER () AS rid, * FROM {source(t)})" for t, cs in names.items() for c in cs)
    parent = lambda xs, one, two: " AND ".join(f"{x}.{one}.pk" for x in xs) + " AND (" + " OR ".join(f"{x}.{two}.fk" for x in xs) + ")"

    def made(xs: str) -> str:
        mean = lambda c: "(" + " + ".join(f"{x}.{c}" for x in xs) + f") / {len(xs)}"
        joins = " ".join(f"JOIN ranked_pairs {x} ON {x}.lt = x.lt AND {x}.rt = x.rt AND {x}.place > {w}.place" for w, x in zip(xs, xs[1:]))
        apart = " AND ".join(f"{x}.{c} <> {w}.{c}" for i, x in enumerate(xs) for w in xs[:i] for c in ("lc", "rc"))
        lists = ", ".join("[" + ", ".join(f"{x}.{c}" for x in xs) + f"] AS {c}s" for c in ("lc", "rc"))
        return f"SELECT x.lt, x.rt, {lists}, {mean('first')} AS pm, {mean('type_score')} AS tm, {mean('cons')} AS cm, {parent(xs, 'a', 'b')} AS lp, {parent(xs, 'b', 'a')} AS rp FROM ranked_pairs x {joins} WHERE {apart}"

    def tuples(side: str) -> str:
        return f"""SELECT combo, key, count(*) AS n FROM (
            SELECT combo, rid, list(v ORDER BY i) AS key
            FROM (SELECT combo, {side}t AS t, unnest({side}cs) AS c, unnest(range(len({side}cs))) AS i, len({side}cs) AS size FROM combos) JOIN wide_cells USING (t, c)
            GROUP BY combo, rid, size HAVING count(v) = size) GROUP BY combo, key"""

    return f"""
        ranked_pairs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lt, rt ORDER BY first DESC, lc, rc) AS place FROM kept) WHERE place <= 24),
        combos AS (SELECT row_number() OVER () AS combo, * FROM ({made('xy')} UNION ALL {made('xyz')})),
        wide_cells AS (
          {wide}),
        left_tuples AS ({tuples('l')}),
        right_tuples AS ({tuples('r')}),
        tuple_shares AS (
          SELECT combo, ld, rd, ld / lall AS lu, rd / rall AS ru, shared / least(ld, rd)::DOUBLE AS contain, shared / (ld + rd - shared)::DOUBLE AS jacc, low / (lall + rall - low)::DOUBLE AS freq
          FROM (SELECT combo, count(*) AS shared, sum(least(l.n, r.n)) AS low FROM left_tuples l JOIN right_tuples r USING (combo, key) GROUP BY combo)
          JOIN (SELECT combo, count(*) AS ld, sum(n) AS lall FROM left_tuples GROUP BY combo) USING (combo)
          JOIN (SELECT combo, count(*) AS rd, sum(n) AS rall FROM right_tuples GROUP BY combo) USING (combo)),
        composites AS (
          SELECT lt AS left_table, array_to_string(lcs, ',') AS left_cols, rt AS right_table, array_to_string(rcs, ',') AS right_cols,
                 CASE WHEN lu >= 0.98 AND ru >= 0.98 THEN '1:1' WHEN lu >= 0.98 THEN '1:N' WHEN ru >= 0.98 THEN 'N:1' ELSE 'N:M' END AS cardinality,
                 CASE WHEN lp AND NOT rp THEN 'left_parent' WHEN rp AND NOT lp THEN 'right_parent' WHEN lu >= 0.98 AND ru < 0.98 THEN 'left_parent' WHEN ru >= 0.98 AND lu < 0.98 THEN 'right_parent' ELSE 'undirected' END AS direction,
                 round(least(1, 0.42 * pm + 0.26 * contain + 0.10 * jacc + 0.10 * freq + 0.06 * tm + 0.06 * cm + CASE WHEN (lu > 0.98) <> (ru > 0.98) THEN 0.02 ELSE 0 END)::DOUBLE, 4) AS confidence,
                 'composite' AS reasons, 'composite' AS kind
          FROM combos JOIN tuple_shares USING (combo) WHERE (contain >= 0.25 OR jacc >= 0.15) AND confidence >= 0.72
          QUALIFY row_number() OVER (PARTITION BY lt, rt ORDER BY confidence DESC, lcs, rcs) <= 3)"""


def best_paths(cells: str, columns: list[tuple[str, str, str, bool, bool]], start: str, target: str, k: int = 3) -> str:
    """The k cheapest simple paths of at most six hops over the single-column edges."""
    turn = lambda ahead, behind: f"0.03 * CASE direction WHEN '{ahead}' THEN 1.0 WHEN '{behind}' THEN 0.4 ELSE 0 END"
    grade = "CASE cardinality WHEN '1:1' THEN 1.0 WHEN 'N:M' THEN 0.88 ELSE 0.985 END"
    return join_edges(cells, columns, f""", steps AS (
          SELECT left_table AS f, right_table AS g, concat_ws('.', left_table, left_cols, right_table, right_cols) AS step, least(1, confidence * {grade} + {turn('right_parent', 'left_parent')}) AS p FROM final
          UNION ALL SELECT right_table, left_table, concat_ws('.', right_table, right_cols, left_table, left_cols), least(1, confidence * {grade} + {turn('left_parent', 'right_parent')}) FROM final),
        walks AS (
          SELECT g, [f, g] AS tables, [step] AS steps, [p] AS ps FROM steps WHERE f = '{start}' AND p >= 0.55
          UNION ALL SELECT s.g, list_append(tables, s.g), list_append(w.steps, s.step), list_append(ps, s.p) FROM walks w JOIN steps s ON s.f = w.g
          WHERE s.p >= 0.55 AND w.g <> '{target}' AND NOT list_contains(tables, s.g) AND len(ps) < 6),
        found AS (SELECT *, list_sum(list_transform(ps, lambda x: -ln(x * 0.97))) AS cost FROM walks WHERE g = '{target}')
        SELECT row_number() OVER (ORDER BY cost, len(ps), steps)::INT AS place, round(cost, 6) AS cost, round(exp(-cost), 6) AS probability, round(exp(list_avg(list_transform(ps, lambda x: ln(x)))), 6) AS confidence, len(ps)::INT AS hops,
               array_to_string(tables, '>') AS tables, array_to_string(steps, ' ') AS steps FROM found QUALIFY place <= {k}""")


# What each template gives in SQL: a and b are trimmed cells that are not empty, m the median of a's numbers.
_TEMPLATES = {
    "identity": "a", "lower": "lower(a)", "upper": "upper(a)", "trim": "trim(a)", "substring": "CASE WHEN length(a) >= 4 THEN right(a, 4) END", "parse_date": "left(a, 10)",
    "split": "nullif(trim(string_split_regex(a, '[_\\-\\s/]+')[1], '.'), '')", "regex_extract": "nullif(lower(regexp_extract(a, '\\.([A-Za-z0-9]{1,8})$', 1)), '')",
    "round": "round(a::DOUBLE, 2)::VARCHAR", "scale": "(a::DOUBLE / 100)::VARCHAR", "date_part": "left(a, 4)", "concat": "concat_ws(' ', a, b)", "format": "concat_ws('-', a, b)",
    "arithmetic": "(a::DOUBLE + b::DOUBLE)::VARCHAR", "ratio": "CASE WHEN b::DOUBLE <> 0 THEN (a::DOUBLE / b::DOUBLE)::VARCHAR END", "currency_convert": "(a::DOUBLE * b::DOUBLE)::VARCHAR",
}


def execution_scores(targets: tuple, singles: dict, several: dict, rows: int) -> str:
    """All templates over a sample of orders joined to customers, against samples of the targets."""
    cell = lambda r: f"nullif(trim({r.split('.')[1]}::VARCHAR), '')"
    each = []
    for refs, families in [*(((r,), f) for r, f in singles.items()), *several.items()]:
        name, a, b = "+".join(refs), cell(refs[0]), cell(refs[-1])
        for family in families:
            made = _TEMPLATES.get(family)
            if family == "conditional" and len(refs) > 1:
                made = "(a::DOUBLE > b::DOUBLE)::VARCHAR"
            elif family == "conditional":
                number = refs[0] in ("orders.o_totalprice", "customer.c_acctbal", "customer.c_nationkey")
                made = f"(a::DOUBLE >= (SELECT quantile_cont({refs[0].split('.')[1]}::DOUBLE, 0.5) FROM drawn))::VARCHAR" if number else "(lower(a) IN ('active', 'open', 'yes', 'true', '1'))::VARCHAR"
            each.append(f"SELECT '{name}' AS refs, '{family}' AS family, pos, {made} AS value FROM (SELECT pos, {a} AS a, {b} AS b FROM drawn) WHERE a IS NOT NULL AND b IS NOT NULL")
    made = "\n          UNION ALL ".join(each)
    listed = ", ".join(f"('{t}')" for t in targets)
    draw = lambda t, k, salt: f"SELECT *, row_number() OVER (ORDER BY md5('{salt}|' || {k}), {k}) AS pos FROM {t} QUALIFY pos <= {rows}"
    bag = "target, refs, family"
    return f"""
        WITH drawn AS (SELECT * FROM ({draw('orders', 'o_orderkey', '')}) LEFT JOIN customer ON o_custkey = c_custkey),
        o AS ({draw('orders', 'o_orderkey', 'target')}),
        c AS ({draw('customer', 'c_custkey', 'target')}),
        expected AS (
          SELECT 'order_year' AS target, pos, year(o_orderdate)::VARCHAR AS value FROM o
          UNION ALL SELECT 'segment_lower', pos, lower(c_mktsegment) FROM c
          UNION ALL SELECT 'price_hundredth', pos, (o_totalprice / 100)::VARCHAR FROM o
          UNION ALL SELECT 'customer_label', pos, concat_ws(' ', c_name, c_mktsegment) FROM c
          UNION ALL SELECT 'priority_end', pos, right(o_orderpriority, 4) FROM o
          UNION ALL SELECT 'price_total', pos, o_totalprice::VARCHAR FROM o),
        made AS (
          {made}),
        told AS (SELECT * FROM made, (VALUES {listed}) v(target) WHERE value IS NOT NULL),
        bags AS (
          SELECT *, TRY_CAST(regexp_replace(replace(value, ',', ''), '%$', '') AS DOUBLE) AS x FROM (
            SELECT {bag}, pos, lower(trim(value)) AS value, 0 AS side FROM told
            UNION ALL SELECT {bag}, e.pos, lower(trim(e.value)), 1 FROM (SELECT DISTINCT {bag} FROM told) JOIN expected e USING (target))
          WHERE value <> ''),
        sides AS (
          SELECT {bag}, count(*) FILTER (side = 0) AS pn, count(x) FILTER (side = 0) AS px, count(*) FILTER (side = 1) AS tn, count(x) FILTER (side = 1) AS tx
          FROM bags GROUP BY ALL HAVING pn > 0 AND tn > 0),
        kinds AS (SELECT *, px >= 0.8 * pn AND tx >= 0.8 * tn AS is_number, least(px, tx) AS n FROM sides),
        early AS (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {bag}, side ORDER BY pos, x) AS early FROM bags WHERE x IS NOT NULL)
          JOIN (SELECT {bag}, n FROM kinds WHERE is_number) USING ({bag}) WHERE early <= n),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY {bag}, side ORDER BY x) AS rank FROM early),
        near AS (
          SELECT {bag}, greatest(0, 1 - avg(abs(p.x - t.x)) / greatest(max(t.x) - min(t.x), max(p.x) - min(p.x), 1e-9::DOUBLE)) AS near
          FROM (SELECT * FROM ranked WHERE side = 0) p JOIN (SELECT * FROM ranked WHERE side = 1) t USING ({bag}, rank) GROUP BY ALL),
        units AS (
          SELECT 'exact' AS unit, {bag}, side, round(x, 6)::VARCHAR AS v FROM early
          UNION ALL SELECT 'texts', {bag}, side, value FROM bags
          UNION ALL SELECT 'words', {bag}, side, unnest(string_split_regex(value, '[^a-z0-9]+')) FROM bags),
        counted AS (SELECT unit, {bag}, v, count(*) FILTER (side = 0) AS p, count(*) FILTER (side = 1) AS t FROM units WHERE v <> '' GROUP BY ALL),
        shared AS (SELECT unit, {bag}, coalesce(sum(least(p, t)) / nullif(least(sum(p), sum(t)), 0), 0)::DOUBLE AS share FROM counted GROUP BY ALL),
        wide AS (
          SELECT {bag}, max(share) FILTER (unit = 'exact') AS exact, max(share) FILTER (unit = 'texts') AS texts, max(share) FILTER (unit = 'words') AS words
          FROM shared GROUP BY ALL)
        SELECT {bag}, pn AS n,
               round(CASE WHEN is_number THEN 0.75::DOUBLE * coalesce(near, 0) + 0.25::DOUBLE * coalesce(exact, 0) ELSE 0.6::DOUBLE * coalesce(texts, 0) + 0.4::DOUBLE * coalesce(words, 0) END, 6) AS score
        FROM kinds LEFT JOIN near USING ({bag}) LEFT JOIN wide USING ({bag})"""


def semantic_roles(concepts: tuple[str, ...]) -> str:
    """Concept scores by list functions, a column for each concept, and the rules over them."""
    n = len(concepts)
    listed = ", ".join(f"({i}, '{c}')" for i, c in enumerate(concepts))
    wide = ", ".join(f"max(score) FILTER (concept = '{c}') AS {c}" for c in concepts)
    near = lambda share, t, s: f"CASE WHEN t.{t} > 0.38 AND s.{s} > 0.38 THEN {share}::DOUBLE * least(t.{t}, s.{s}) / 0.5 ELSE 0 END"
    text = "greatest(s.text_description, s.email, s.file_resource)"
    roles = ", ".join(f"CASE WHEN {c} > {x} THEN '{r}' END" for r, c, x in sorted([
        ("amount_like", "monetary", 0.42), ("date_part_like", "date_extraction", 0.40), ("duration_like", "duration_span", 0.40), ("email_like", "email", 0.42), ("full_name_like", "full_name", 0.42),
        ("identifier_like", "identifier", 0.42), ("username_like", "username", 0.42)]))
    roles = roles.replace("CASE WHEN date_extraction", "CASE WHEN currency > 0.42 OR monetary > 0.45 AND exchange_rate > 0.30 THEN 'currency_like' END, CASE WHEN date_extraction")
    return f"""
        WITH names(i, concept) AS (VALUES {listed}),
        rows AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        seeds AS (SELECT vec_id AS i, concept, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS c FROM rows JOIN names ON i = vec_id),
        drawn AS (
          SELECT vec_id, CASE WHEN c IS NULL THEN v ELSE list_transform(list_zip(v, c), lambda p: p[1] + 1.5::DOUBLE * p[2]) END AS v
          FROM rows LEFT JOIN seeds ON i = vec_id * (vec_id + 3) % {n}),
        units AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM drawn),
        scores AS (SELECT vec_id, concept, list_dot_product(v, c) AS score FROM units, seeds),
        best AS (SELECT vec_id, concept, score FROM scores QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, concept) = 1),
        w AS (SELECT vec_id, {wide} FROM scores GROUP BY vec_id),
        met AS (
          SELECT t.vec_id, list_dot_product(a.v, b.v) AS similarity, s.monetary > 0.40 AS is_money, s.exchange_rate > 0.35 AS is_rate, s.name_component > 0.40 AS is_part, s.email > 0.40 AS is_email, s.date_temporal > 0.40 AS is_date,
                 least(1, greatest(0, {near(0.35, 'date_extraction', 'date_temporal')}, {near(0.30, 'duration_span', 'date_temporal')}, {near(0.35, 'username', 'email')},
                   CASE WHEN t.monetary > 0.38 AND s.exchange_rate > 0.35 THEN 0.30 ELSE 0 END, CASE WHEN t.full_name > 0.38 AND s.name_component > 0.38 THEN 0.30 ELSE 0 END,
                   CASE WHEN t.parsing_extraction > 0.35 AND {text} > 0.35 THEN 0.20 ELSE 0 END,
                   CASE WHEN list_dot_product(a.v, b.v) > 0.55 THEN 0.10::DOUBLE * list_dot_product(a.v, b.v) ELSE 0 END))::DOUBLE AS affinity
          FROM w t JOIN w s ON s.vec_id IN (t.vec_id + 1, t.vec_id + 2) JOIN units a ON a.vec_id = t.vec_id JOIN units b ON b.vec_id = s.vec_id),
        told AS (
          SELECT vec_id, max(affinity) AS affinity, max(similarity) AS similarity, bool_or(is_money) AS money, bool_or(is_rate) AS rate, count(*) FILTER (is_part) AS parts, bool_or(is_email) AS mail, bool_or(is_date) AS day
          FROM met GROUP BY vec_id),
        summed AS (
          SELECT *, CASE WHEN affinity > 0.1 THEN affinity ELSE 0 END + CASE WHEN (monetary > 0.40 OR currency > 0.40) AND money THEN 0.25 ELSE 0 END + CASE WHEN (monetary > 0.40 OR currency > 0.40) AND rate THEN 0.30 ELSE 0 END
                 + CASE WHEN full_name > 0.40 OR concatenation > 0.35 THEN CASE WHEN parts >= 2 THEN 0.60 WHEN parts = 1 THEN 0.25 ELSE 0 END ELSE 0 END
                 + CASE WHEN username > 0.40 AND mail THEN 0.50 ELSE 0 END + CASE WHEN (date_extraction > 0.40 OR duration_span > 0.40) AND day THEN 0.40 ELSE 0 END AS gain
          FROM w JOIN told USING (vec_id))
        SELECT vec_id, concept, round(score, 6) AS score, concat_ws(',', {roles}) AS roles, round(affinity, 6) AS affinity,
               round(greatest(0, least(1, CASE WHEN gain < 0.1 THEN 0.20::DOUBLE * similarity ELSE gain END))::DOUBLE, 6) AS role_score
        FROM summed JOIN best USING (vec_id)"""
