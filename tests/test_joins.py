from __future__ import annotations

from fixtures import RETAIL, RETAIL_EDGES, json_tables
from weftline.operators import joins, paths
from weftline.sources import catalog


def test_retail_edges_are_all_found(spark):
    tables = json_tables(RETAIL)
    columns = catalog.from_json_tables(catalog.json_tables(spark, tables))
    edges = joins.discover(catalog.sample_frames(spark, tables), columns, composites=False)
    found = {tuple(sorted((f"{e.left_table}.{e.left_cols[0]}", f"{e.right_table}.{e.right_cols[0]}"))) for e in edges.collect()}
    assert RETAIL_EDGES <= found
    best = paths.best_paths(spark, edges, "order_lines", "regions", k=1).first()
    assert best.tables == ["order_lines", "orders", "stores", "regions"]


def test_composite_join_is_found_whatever_the_order_of_rows(spark):
    items = [(o, n, f"sku{o}-{n}") for o in range(1, 31) for n in (1, 2, 3)]
    events = [(o, n, f"E{o % 4}") for o, n, _ in reversed(items)]
    tables = {
        "order_items": spark.createDataFrame(items, "order_id int, line_no int, sku string"),
        "fulfillment_events": spark.createDataFrame(events, "ord_id int, line_number int, event_code string"),
    }
    edges = joins.discover(tables, catalog.from_frames(spark, tables)).where("kind = 'composite'").collect()
    pairs = [set(zip(e.left_cols, e.right_cols)) for e in edges]
    assert {("ord_id", "order_id"), ("line_number", "line_no")} in pairs
    e = edges[pairs.index({("ord_id", "order_id"), ("line_number", "line_no")})]
    assert e.cardinality == "1:1"


def test_paths_equal_brute_force(spark):
    from itertools import permutations

    rows = [("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.7), ("c", "d", 0.95), ("b", "d", 0.6), ("d", "e", 0.9)]
    edges = spark.createDataFrame([(x, ["k"], y, ["k"], "1:1", "undirected", c, [], "single") for x, y, c in rows], joins.EDGE)
    graph = paths.JoinGraph(edges, 0.0)
    weight = {}
    for x, y, c in rows:
        weight[x, y] = weight[y, x] = -__import__("math").log(c * paths.HOP)
    for start in "abcde":
        for target in "abcde":
            if start == target:
                continue
            costs = []
            for n in range(0, 4):
                for middle in permutations([t for t in "abcde" if t not in (start, target)], n):
                    nodes = [start, *middle, target]
                    if all(p in weight for p in zip(nodes, nodes[1:])):
                        costs.append(sum(weight[p] for p in zip(nodes, nodes[1:])))
            got = [sum(s.cost for s in p) for p in graph.paths(start, target, k=3)]
            assert [round(x, 9) for x in got] == [round(x, 9) for x in sorted(costs)[:3]]
    spread = spark.createDataFrame([(x, y, c) for x, y, c in rows] + [(y, x, c) for x, y, c in rows], "source string, target string, confidence double")
    best = {(r.start, r.target): r.cost for r in paths.enumerate_paths(spread, 4).where("place = 1").collect()}
    assert round(best["a", "e"], 9) == round(sum(s.cost for s in graph.paths("a", "e", k=1)[0]), 9)
    assert graph.paths("a", "e", k=1, required={"b"})[0][0].target == "b"
    assert all("c" not in {s.target for s in p} for p in graph.paths("a", "e", banned={"c"}))


def _graph(spark, rows):
    return paths.JoinGraph(spark.createDataFrame([(x, ["k"], y, ["k"], "N:M", "undirected", c, [], "single") for x, y, c in rows], joins.EDGE), 0.0)


def test_trees_equal_brute_force(spark):
    """The cheapest tree over all sets of middle tables: each is a minimum spanning tree of its tables."""
    import random
    from itertools import combinations

    rng = random.Random(3)
    names = "abcdefg"
    for _ in range(25):
        rows = [(x, y, round(rng.uniform(0.3, 0.95), 3)) for x, y in combinations(names, 2) if rng.random() < 0.4]
        graph = _graph(spark, rows)
        cost = {(s.source, s.target): s.cost for steps in graph.next.values() for s in steps}
        needed = set(rng.sample(names, 3))
        best = None
        for n in range(len(names)):
            for middle in combinations([t for t in names if t not in needed | {"a"}], n):
                nodes = {"a", *needed, *middle}
                seen, total = {"a"}, 0.0
                while seen != nodes:
                    grow = min(((c, y) for (x, y), c in cost.items() if x in seen and y in nodes - seen), default=None)
                    if grow is None:
                        break
                    total += grow[0]
                    seen.add(grow[1])
                else:
                    best = total if best is None else min(best, total)
        tree = graph.tree("a", needed)
        if best is None:
            assert not needed - {"a"} <= {s.target for s in tree}
            continue
        assert round(sum(s.cost for s in tree), 9) == round(best, 9)
        reached = {"a"}
        for s in tree:
            assert s.source in reached and s.target not in reached
            reached.add(s.target)
        greedy = graph.tree("a", needed, exact=0)
        assert needed <= {"a", *(s.target for s in greedy)} and sum(s.cost for s in greedy) <= 2 * best + 1e-9
        for t in needed - {"a"}:
            way = paths.branch(tree, t)
            assert way[0].source == "a" and way[-1].target == t and all(p.target == q.source for p, q in zip(way, way[1:]))


def test_primary_tables_and_load(spark):
    from pyspark.sql import functions as F

    from weftline.operators import candidates, execute

    columns = spark.createDataFrame([("employees", "id"), ("departments", "id"), ("sales_orders", "id"), ("vendors", "id")], "table string, column string")
    targets = spark.createDataFrame([("dim_employee", "x"), ("fact_order", "x"), ("stg_supplier", "x"), ("staff_list", "x"), ("fact_weather", "x")], "table string, column string")
    found = {r.tt: (r.primary, r.votes) for r in candidates.primary_tables(targets, columns).collect()}
    # sales votes for order as well: both are words for a purchase
    assert found == {"dim_employee": ("employees", 2.0), "fact_order": ("sales_orders", 3.5), "stg_supplier": ("vendors", 1.5), "staff_list": ("employees", 1.5)}

    tables = {
        "lines": spark.createDataFrame([(1, 5, 2, 1.5), (2, 6, 1, 7.0), (3, 9, 1, 1.0)], "line_id int, order_id int, quantity int, price double"),
        "orders": spark.createDataFrame([(5, 70, "2024-02-03"), (6, None, "bad")], "order_id int, customer_id int, day string"),
        "people": spark.createDataFrame([(70, "Ann", "Lee")], "customer_id int, first string, last string"),
    }
    rows = [("lines", ["order_id"], "orders", ["order_id"], "N:1", "right_parent", 0.9, [], "single"), ("orders", ["customer_id"], "people", ["customer_id"], "N:1", "right_parent", 0.9, [], "single")]
    mapped = spark.createDataFrame(
        [("fact_lines", "total", ["lines.quantity", "lines.price"], "arithmetic"), ("fact_lines", "name", ["people.first", "people.last"], "concat"), ("fact_lines", "day", ["orders.day"], "date_parse"), ("fact_lines", "gone", ["nowhere.x"], "rename")],
        "tt string, tc string, refs array<string>, transform string")
    primary = spark.createDataFrame([("fact_lines", "lines")], "tt string, primary string")
    ways = candidates.join_ways(mapped, primary, spark.createDataFrame(rows, joins.EDGE))
    plan = mapped.join(ways, ["tt", "tc"]).collect()
    by = {r.tc: r for r in plan}
    assert [p["to"] for p in by["name"].join_path] == ["orders", "people"] and by["total"].join_path is None and by["gone"].join_path is None
    kinds = {"total": "double", "name": "string", "day": "date", "gone": "string", "unplanned": "int"}
    out = execute.load(tables, plan, "fact_lines", kinds).orderBy(F.col("total")).collect()
    assert [(r.total, r.name, str(r.day), r.gone, r.unplanned) for r in out] == [(1.0, "", "None", None, None), (3.0, "Ann Lee", "2024-02-03", None, None), (7.0, "", "None", None, None)]


def test_k_best_paths_equal_brute_force_with_required_and_banned_tables(spark):
    import random
    from itertools import combinations

    rng = random.Random(9)
    for _ in range(12):
        rows = [(x, y, round(rng.uniform(0.3, 0.95), 3)) for x, y in combinations("abcdefg", 2) if rng.random() < 0.6]
        graph = _graph(spark, rows)

        def walk(steps, seen, hops):
            node = steps[-1].target if steps else "a"
            if node == "g":
                yield steps
            elif hops:
                for s in graph.next.get(node, ()):
                    if s.target not in seen:
                        yield from walk([*steps, s], seen | {s.target}, hops - 1)

        for required, banned in ((set(), set()), ({"c"}, set()), ({"b", "d"}, {"e"})):
            every = [p for p in walk([], {"a"}, 4) if required <= {s.target for s in p} and not banned & {s.target for s in p}]
            want = sorted(round(sum(s.cost for s in p), 9) for p in every)[:6]
            got = graph.paths("a", "g", 6, 4, required, banned)
            assert [round(sum(s.cost for s in p), 9) for p in got] == want
        fewest = graph.first_hops("a", 4)
        for t, way in fewest.items():
            ways = [p for p in graph.paths("a", t, 1000, 4)]
            least = min(map(len, ways))
            assert len(way) == least and round(sum(s.cost for s in way), 9) == min(round(sum(s.cost for s in p), 9) for p in ways if len(p) == least)


def test_k_best_paths_of_a_dense_graph_are_quick():
    import random
    import time

    rng = random.Random(1)
    graph = paths.JoinGraph.__new__(paths.JoinGraph)
    graph.next = {f"t{i}": [paths.Step(f"t{i}", f"t{j}", ("k",), ("k",), rng.uniform(0.55, 0.99), "N:1") for j in range(300) if j != i] for i in range(300)}
    began = time.perf_counter()
    found = graph.paths("t0", "t299", k=10, max_hops=6)
    assert time.perf_counter() - began < 10
    costs = [sum(s.cost for s in p) for p in found]
    assert len(found) == 10 and costs == sorted(costs) and len({tuple(p) for p in found}) == 10
    middle = graph.paths("t0", "t299", k=3, max_hops=6, required={"t7", "t8"})
    assert len(middle) == 3 and all({"t7", "t8"} <= {s.target for s in p} for p in middle) and time.perf_counter() - began < 20
