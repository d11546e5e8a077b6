"""Join paths over discovered edges.

A graph has as many nodes as the schema has tables, so the search itself runs on the collected edges; its result is a
frame again. For the SQL-checkable form, simple paths are also enumerated by self-joins of the edges.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a join's cardinality leaves of its confidence.
CARDINALITY = {"1:1": 1.0, "1:N": 0.985, "N:1": 0.985, "N:M": 0.88}
HOP = 0.97
PATHS = "place int, cost double, probability double, confidence double, hops int, tables array<string>, steps array<struct<from:string,to:string,left_cols:array<string>,right_cols:array<string>,confidence:double,cardinality:string>>"


@dataclass(frozen=True)
class Step:
    source: str
    target: str
    left: tuple[str, ...]
    right: tuple[str, ...]
    confidence: float
    cardinality: str
    #: The edge's own confidence, before cardinality and direction weigh in.
    edge: float | None = None

    @property
    def cost(self) -> float:
        return -math.log(max(1e-9, self.confidence * HOP))


class JoinGraph:
    """Adjacency of tables, both ways, with at most keep edges of a pair of tables: the best single and composite first."""

    def __init__(self, edges: DataFrame, min_confidence: float = 0.55, keep: int = 5):
        self.next: dict[str, list[Step]] = {}
        best: dict[tuple, object] = {}
        for e in edges.collect():
            pairs = tuple(sorted(zip(e.left_cols, e.right_cols)))
            key = (e.left_table, e.right_table, pairs) if e.left_table <= e.right_table else (e.right_table, e.left_table, tuple(sorted((b, a) for a, b in pairs)))
            if key not in best or e.confidence > best[key].confidence:
                best[key] = e
        of_pair: dict[tuple, list] = {}
        for key, e in best.items():
            of_pair.setdefault(key[:2], []).append(e)
        for found in of_pair.values():
            found.sort(key=lambda e: (-e.confidence, tuple(e.left_cols), tuple(e.right_cols)))
            first = [next((e for e in found if len(e.left_cols) > 1), None), next((e for e in found if len(e.left_cols) == 1), None)]
            chosen = [e for e in first if e is not None]
            chosen += [e for e in found if e not in chosen]
            for e in chosen[:keep]:
                for back in (False, True):
                    s = self._step(e, back)
                    if s.confidence >= min_confidence:
                        self.next.setdefault(s.source, []).append(s)

    @staticmethod
    def _step(e, back: bool) -> Step:
        gain = 0.05 if len(e.left_cols) > 1 else 0.0
        toward = {"left_parent": -1, "right_parent": 1}.get(e.direction, 0) * (-1 if back else 1)
        turn = 0.03 * (1.0 if toward > 0 else 0.4 if toward < 0 else 0.0)
        confidence = min(1.0, max(1e-6, (e.confidence + gain) * CARDINALITY.get(e.cardinality, 0.88) + turn))
        kind = e.cardinality if not back else {"1:N": "N:1", "N:1": "1:N"}.get(e.cardinality, e.cardinality)
        sides = (e.right_table, e.left_table, tuple(e.right_cols), tuple(e.left_cols)) if back else (e.left_table, e.right_table, tuple(e.left_cols), tuple(e.right_cols))
        return Step(*sides, confidence, kind, e.confidence)

    def paths(self, start: str, target: str, k: int = 3, max_hops: int = 6, required: set[str] = frozenset(), banned: set[str] = frozenset()) -> list[list[Step]]:
        """The k cheapest simple paths that pass all required tables and no banned one; of equal costs the fewest joins.

        Partial paths leave a queue in order of their cost and the least that is still to come: the distance to the
        target within the hops left, and by way of each required table not yet passed. Such bounds are never too high,
        so each path that ends at the target is the next best, and few partial paths besides those of the k best are
        ever taken up, however dense the graph.
        """
        if start in banned or target in banned:
            return []
        to_target = self._within(target, max_hops, banned)
        to_required = {r: self._within(r, max_hops, banned) for r in sorted(required)}
        nothing = math.inf

        def ahead(node: str, left: int, seen: frozenset[str]) -> float:
            least = to_target[left].get(node, nothing)
            for r, reach in to_required.items():
                if r not in seen:
                    least = max(least, reach[left].get(node, nothing) + to_target[left].get(r, nothing))
            return least

        out: list[list[Step]] = []
        seen = frozenset({start})
        queue: list[tuple] = [(round(ahead(start, max_hops, seen), 12), 0, (), 0.0, seen, ())]
        while queue and len(out) < k:
            _, hops, names, cost, seen, steps = heapq.heappop(queue)
            node = steps[-1].target if steps else start
            if node == target and (steps or start == target):
                if required <= seen:
                    out.append(list(steps))
                continue
            for s in self.next.get(node, ()):
                if s.target in seen or s.target in banned:
                    continue
                after = seen | {s.target}
                least = ahead(s.target, max_hops - hops - 1, after)
                if least < nothing:
                    told = (*names, (s.source, s.target, s.left, s.right))
                    heapq.heappush(queue, (round(cost + s.cost + least, 12), hops + 1, told, cost + s.cost, after, (*steps, s)))
        return out

    def _within(self, target: str, hops: int, banned: set[str]) -> list[dict[str, float]]:
        """For each number of hops up to hops: the least cost of a walk of no more hops from each table to target."""
        levels = [{target: 0.0}]
        for _ in range(hops):
            last, level = levels[-1], dict(levels[-1])
            for node, steps in self.next.items():
                if node in banned:
                    continue
                for s in steps:
                    if s.target in last and s.target not in banned and s.cost + last[s.target] < level.get(node, math.inf):
                        level[node] = s.cost + last[s.target]
            levels.append(level)
        return levels

    def first_hops(self, start: str, max_hops: int = 6) -> dict[str, list[Step]]:
        """A way to each table within reach, of the fewest hops and of those the cheapest."""
        best: dict[str, tuple[float, list[Step]]] = {start: (0.0, [])}
        level = {start: (0.0, [])}
        for _ in range(max_hops):
            after: dict[str, tuple[float, list[Step]]] = {}
            for node, (cost, way) in sorted(level.items()):
                for s in self.next.get(node, ()):
                    if s.target not in best and (s.target not in after or cost + s.cost < after[s.target][0] - 1e-12):
                        after[s.target] = (cost + s.cost, [*way, s])
            best |= after
            level = after
        return {t: way for t, (_, way) in best.items() if t != start}

    def tree(self, root: str, needed: set[str], exact: int = 7) -> list[Step]:
        """The cheapest set of joins, all leading away from root, that reaches every needed table that can be reached.

        A directed Steiner tree by dynamic programming over subsets of the needed tables, each grown by a shortest-path
        search; of equal costs the fewest joins, then the first names. Beyond exact needed tables (the programme grows
        with 3 to that power) the nearest table not yet reached is joined again and again.
        """
        first = self._distances(root)
        wanted = sorted(t for t in needed if t != root and t in first)
        if not wanted:
            return []
        if len(wanted) > exact:
            return self._nearest_first(root, wanted)
        back: dict[str, list[Step]] = {}
        for steps in self.next.values():
            for s in steps:
                back.setdefault(s.target, []).append(s)
        full = (1 << len(wanted)) - 1
        best: list[dict[str, tuple]] = [{} for _ in range(full + 1)]
        for mask in range(1, full + 1):
            here = best[mask]
            if mask & (mask - 1) == 0:
                here[wanted[mask.bit_length() - 1]] = (0.0, 0, ())
            part = (mask - 1) & mask
            while part > mask - part:
                for node, one in best[part].items():
                    other = best[mask - part].get(node)
                    if other is not None:
                        self._better(here, node, (one[0] + other[0], one[1] + other[1], one[2] + other[2]))
                part = (part - 1) & mask
            queue = [(*v[:2], self._names(v), node) for node, v in here.items()]
            heapq.heapify(queue)
            while queue:
                cost, hops, _, node = heapq.heappop(queue)
                value = here[node]
                if (cost, hops) != value[:2]:
                    continue
                for s in back.get(node, ()):
                    grown = (cost + s.cost, hops + 1, (s, *value[2]))
                    if self._better(here, s.source, grown):
                        heapq.heappush(queue, (*grown[:2], self._names(grown), s.source))
        return self._ordered(root, best[full][root][2])

    @staticmethod
    def _names(value: tuple) -> tuple:
        return tuple((s.source, s.target, s.left, s.right) for s in value[2])

    def _better(self, known: dict[str, tuple], node: str, value: tuple) -> bool:
        rank = lambda v: (round(v[0], 9), v[1], self._names(v))
        if node in known and rank(known[node]) <= rank(value):
            return False
        known[node] = value
        return True

    def _distances(self, *sources: str) -> dict[str, tuple[float, Step | None]]:
        """Each table that the sources reach: its distance, and the last step of a shortest path."""
        found: dict[str, tuple[float, Step | None]] = {}
        queue = [(0.0, s, 0, None) for s in sources]
        turn = 0
        while queue:
            cost, node, _, step = heapq.heappop(queue)
            if node in found:
                continue
            found[node] = (cost, step)
            for s in self.next.get(node, ()):
                turn += 1
                heapq.heappush(queue, (cost + s.cost, s.target, turn, s))
        return found

    def _nearest_first(self, root: str, wanted: list[str]) -> list[Step]:
        reached, steps = {root}, []
        while left := [t for t in wanted if t not in reached]:
            found = self._distances(*sorted(reached))
            node = min(left, key=lambda t: (found[t][0], t))
            while node not in reached:
                step = found[node][1]
                steps.append(step)
                reached.add(node)
                node = step.source
        return self._ordered(root, steps)

    @staticmethod
    def _ordered(root: str, steps) -> list[Step]:
        """Each join after the one that brings its source; of two joins to one table the first."""
        out, reached, left = [], {root}, sorted(set(steps), key=lambda s: (s.cost, s.source, s.target, s.left, s.right))
        while ready := next((s for s in left if s.source in reached), None):
            left.remove(ready)
            if ready.target not in reached:
                out.append(ready)
                reached.add(ready.target)
        return out


def branch(tree: list[Step], table: str) -> list[Step]:
    """The way from a tree's root to one of its tables."""
    to = {s.target: s for s in tree}
    way: list[Step] = []
    while table in to:
        way.append(to[table])
        table = to[table].source
    return way[::-1]


def best_paths(spark: SparkSession, edges: DataFrame, start: str, target: str, k: int = 3, **options) -> DataFrame:
    """The k best paths as rows: oriented steps, cost, the product and the geometric mean of confidences."""
    rows = []
    for place, steps in enumerate(JoinGraph(edges, options.pop("min_confidence", 0.55)).paths(start, target, k, **options), 1):
        p = math.prod(s.confidence * HOP for s in steps)
        mean = math.exp(sum(math.log(s.confidence) for s in steps) / len(steps)) if steps else 1.0
        told = [(s.source, s.target, list(s.left), list(s.right), s.confidence, s.cardinality) for s in steps]
        rows.append((place, sum(s.cost for s in steps), p, mean, len(steps), [start, *(s.target for s in steps)], told))
    return spark.createDataFrame(rows, PATHS)


def enumerate_paths(edges: DataFrame, max_hops: int = 3) -> DataFrame:
    """(start, target, tables, cost, hops, place) for all simple paths, by one self-join of the edges a hop.

    edges: source, target, confidence. The number of tables bounds the result, not the data.
    """
    steps = edges.select("source", "target", (-F.ln(F.greatest(F.lit(1e-9), F.col("confidence") * HOP))).alias("step"))
    level = steps.select(F.col("source").alias("start"), "target", F.array("source", "target").alias("tables"), F.col("step").alias("cost"))
    every = level
    for _ in range(max_hops - 1):
        met = level.join(steps.withColumnsRenamed({"source": "at", "target": "then"}), (F.col("target") == F.col("at")) & ~F.array_contains("tables", F.col("then")))
        level = met.select("start", F.col("then").alias("target"), F.array_append("tables", F.col("then")).alias("tables"), (F.col("cost") + F.col("step")).alias("cost"))
        every = every.unionByName(level)
    place = F.row_number().over(Window.partitionBy("start", "target").orderBy(F.round("cost", 9), "tables"))
    return every.withColumn("hops", F.size("tables") - 1).withColumn("place", place)
