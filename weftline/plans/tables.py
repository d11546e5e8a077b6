"""Intermediate tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to spark.checkpoint.dir and read it back: later plans start at a scan with known statistics.

    Plans over the catalog join many small frames; without a cut their analysis costs more than their rows.
    """
    path = own_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; in a temporary folder only where all run on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = named or _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="weftline-"))
    return f"{folder}/weftline-{name}-{uuid.uuid4().hex}"
