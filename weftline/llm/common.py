"""What the operators share: reading tables, tables written to the shared folder, and distributed union-find."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Tables of at most this many rows of two numbers may be broadcast (some 16 MB); larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Rows of a few numbers in a file of a written table.
FILE_ROWS = 500_000
#: Spark's setting to drop shuffle files at the end of a query.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Whole texts in a batch that a Python worker holds.
BATCH_ROWS = 1000

_own_dirs: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where all run in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_dirs.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="weftline-"))


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors.

    rows, when known, bounds the number of rows from above and so the number of files that are worth writing.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    path = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    # what a write shuffled is not read again; else its files stay until the driver happens to collect its garbage
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._weftline_path = path
    return back


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches to BATCH_ROWS rows: whole texts in batches of the default size fill a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def held(df: DataFrame) -> DataFrame:
    """Keep df in the executors' memory or on their disks; what a lost executor held is computed again.

    For intermediate rows of a few numbers that are read more than once, outside of loops. Writing them would cost a
    file, and a local file system's permission call, for each of their many small partitions.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def discard(df: DataFrame) -> None:
    """Drop what held() or stored() made, once nothing reads it any more."""
    spark, path = df.sparkSession, getattr(df, "_weftline_path", None)
    df.unpersist()
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of names that df does not have."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark df for broadcast when its counted rows are within the bound; beyond it the join shuffles, also where Spark
    takes df for small: a file of few different numbers holds many more rows than its bytes tell."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many rows: Spark chooses its join within the bound of small(), beyond it the join shuffles."""
    return df if rows <= BROADCAST_ROWS else df.hint("merge")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find: (node, root) for every node of edges (u, v), root being the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round is a partial aggregate for the
    smallest neighbour and an equi-join back, so a hub of any degree is split by adaptive execution. Rounds end when
    the set of edges no longer changes; each round's edges are written to the shared folder, which cuts the lineage.
    The result is written too, for the caller to discard.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    pairs = stored(pairs, "edges")
    mark = _mark(pairs)
    while mark[0]:
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(_bounded(low, 2 * mark[0]), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        joined = large.join(_bounded(low, 2 * mark[0]), F.col("u") == F.col("k")).select("u", "v", "m")
        smaller = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(low.select("k", "m"))
        after = stored(smaller.distinct(), "edges", mark[0])
        pairs_before, pairs, before = pairs, after, mark
        mark = _mark(pairs)
        discard(pairs_before)
        if mark == before:
            break
    roots = pairs.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    found = stored(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), "roots", 2 * mark[0])
    discard(pairs)
    return found


def _mark(pairs: DataFrame) -> tuple:
    """A count and an order-free digest: equal for equal sets of edges."""
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())
