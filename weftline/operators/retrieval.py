"""Nearest vectors: exact search in blocks, and an index of cells with exact re-ranking and calibrated probes.

Items lie in buckets (of types, say); a query names the buckets that it accepts, and the best k of each are merged by
maximum. Cells are k-means centres fitted on a bounded sample; every item is in the cell of its nearest centre, and a
query looks into the cells nearest to it. How many is calibrated on a bounded sample, as the fewest that reach the
wanted recall there. Items and queries meet by equi-joins on (bucket, cell, part): a cell of any size is cut into parts
of PART_ROWS items, so one task holds one part and the queries' vectors of a block, and a matrix product ranks them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut

#: Items of a part, and queries of a block: what one task multiplies.
PART_ROWS = 20_000
BLOCK_ROWS = 2_000
#: Queries that are multiplied with a part's items at once: some 40 MB of products.
STEP_ROWS = 256
#: Vectors on which cells are fitted and probes are calibrated, at most, and queries of the calibration.
FIT_ROWS = 20_000
FIT_QUERIES = 400

_FOUND = "query long, bucket string, id long, similarity double"


def unit(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """rows with vector as doubles of length one; rows of null, empty or zero vectors go."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(F.col("_v"), F.lit(0.0), lambda s, x: s + x * x))
    out = rows.withColumn("_v", v).where(F.size("_v") > 0).withColumn("_n", norm).where("_n > 0")
    return out.withColumn(vector, F.transform("_v", lambda x: x / F.col("_n"))).drop("_v", "_n")


@dataclass(frozen=True)
class Index:
    """Centres of cells and how many of them a query looks into."""

    centres: np.ndarray
    probes: int

    @staticmethod
    def fit(items: DataFrame, k: int, recall: float = 0.97, cells: int | None = None, seed: int = 7) -> Index:
        """On FIT_ROWS items at most, those of the smallest digests of their ids. items: id, vector (unit)."""
        few = items.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)
        few = cut(few, "fit")
        n = few.count()
        if n == 0:
            return Index(np.zeros((0, 0)), 0)
        cells = max(1, min(n, cells or int(np.sqrt(n))))
        model = KMeans(k=cells, seed=seed, maxIter=15, featuresCol="features").fit(few.select(array_to_vector("vector").alias("features")))
        centres = np.array(sorted(map(tuple, model.clusterCenters())))
        rows = np.array([r.vector for r in few.orderBy("id").collect()])
        return Index(centres, _calibrated(rows, centres, k, recall))


def _order(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cells of each vector, nearest first."""
    distance = (centres**2).sum(axis=1) - 2 * vectors @ centres.T
    return np.argsort(distance, axis=1, kind="stable")


def _calibrated(rows: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The fewest probes that find, on average, the wanted share of the best k of sampled queries."""
    queries = rows[:: max(1, len(rows) // FIT_QUERIES)]
    order, home = _order(queries, centres), _order(rows, centres)[:, 0]
    best = np.argsort(-(queries @ rows.T), axis=1, kind="stable")[:, :k]
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    need = np.take_along_axis(place, home[best], axis=1)  # the probe that finds each true neighbour
    shares = [(need < p).mean() for p in range(1, len(centres) + 1)]
    return next((p for p, s in enumerate(shares, 1) if s >= recall), len(centres))


def _celled(rows: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """rows with cells: the n nearest cells of each vector."""

    @F.pandas_udf("array<int>")
    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in parts:
            yield pd.Series(_order(np.stack(vectors.to_list()), centres)[:, :n].tolist(), index=vectors.index, dtype=object)

    return rows.withColumn("cells", nearest("vector"))


def search(queries: DataFrame, items: DataFrame, k: int, index: Index | None = None) -> DataFrame:
    """(query, bucket, id, similarity): the best k items of each accepted bucket, ties by id; exact without an index.

    queries: query, buckets (array), vector; items: id, bucket, vector; vectors of any length above zero.
    """
    q, i = unit(queries), unit(items)
    if index is None or not len(index.centres):
        q, i = q.withColumn("cells", F.array(F.lit(0))), i.withColumn("cell", F.lit(0))
    else:
        q, i = _celled(q, index.centres, index.probes), _celled(i, index.centres, 1).withColumn("cell", F.col("cells")[0]).drop("cells")
    i = i.select("id", "bucket", "vector", "cell")
    sizes = i.groupBy("bucket", "cell").agg((F.floor((F.count("*") - 1) / PART_ROWS) + 1).cast("int").alias("parts"))
    sizes = cut(sizes, "cells")
    n_queries = q.count()
    blocks = n_queries // BLOCK_ROWS + 1
    dealt = i.join(sizes, ["bucket", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.select("bucket", "cell", "part", "id", "vector", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = q.select("query", "vector", F.explode("buckets").alias("bucket"), "cells").withColumn("cell", F.explode("cells"))
    asked = asked.join(sizes, ["bucket", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.select("bucket", "cell", "part", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), "query", "vector")
    group = ["bucket", "cell", "part", "block"]

    def ranked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({n: pd.Series([], dtype=kind) for n, kind in (("query", "int64"), ("bucket", "object"), ("id", "int64"), ("similarity", "float64"))})
        ids = right["id"].to_numpy()
        right = right.iloc[np.argsort(ids, kind="stable")]
        asked, held, best = np.stack(left["vector"].to_list()), np.stack(right["vector"].to_list()).T, []
        for at in range(0, len(asked), STEP_ROWS):  # in steps, so that no task holds all products of its block and part
            near = asked[at : at + STEP_ROWS] @ held
            top = np.argsort(-near.round(12), axis=1, kind="stable")[:, :k]
            best.append((top, np.take_along_axis(near, top, axis=1)))
        top, near = (np.concatenate(x) for x in zip(*best))
        bucket = pd.Series([left["bucket"].iloc[0]] * top.size, dtype=object)
        return pd.DataFrame({"query": np.repeat(left["query"].to_numpy(), top.shape[1]), "bucket": bucket, "id": right["id"].to_numpy()[top.ravel()], "similarity": near.ravel()})

    found = asked.groupBy(*group).cogroup(dealt.groupBy(*group)).applyInPandas(ranked, _FOUND)
    place = F.row_number().over(Window.partitionBy("query", "bucket").orderBy(F.desc(F.round("similarity", 12)), "id"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def merged(found: DataFrame, top: int) -> DataFrame:
    """(query, id, similarity, place): the best of all buckets, an item of several buckets by its largest similarity."""
    best = found.groupBy("query", "id").agg(F.max("similarity").alias("similarity"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 12)), "id"))
    return best.withColumn("place", place).where(F.col("place") <= top)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact's (query, id) that found has."""
    both = exact.select("query", "id").join(found.select("query", "id").distinct().withColumn("hit", F.lit(1)), ["query", "id"], "left")
    return both.agg((F.count("hit") / F.greatest(F.count("*"), F.lit(1))).alias("r")).first().r
