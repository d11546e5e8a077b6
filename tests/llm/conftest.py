from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} and{i % 89}" for i in range(60_000))
    rows = [
        (1, "Alpha beta gamma delta.\nSecond line of the text here.\nReleased under the MIT License.", "en", "a", 80),
        (2, "alpha BETA gamma delta.\nSecond line of the text here.\nReleased under the MIT License.", "en", "a", 80),
        (3, None, "en", "b", None), (4, "", None, None, 0), (5, " \n\t ", "de", "b", 4), (6, long, "en", "c", len(long)),
        (7, "Ein kurzer Text über Füße und Straßen.", "de", None, 38), (7, "Ein kurzer Text über Füße und Straßen.", "de", None, 38),
        (None, "Nobody numbered this one line of words at all here today.", "en", "c", 50), (None, None, None, None, None),
        (8, "x", "en", "b", 1), (9, "中文文本没有空格也应该可以处理。\n第二行也是一样的内容没有空格。", "zh", "d", 30),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns named as results and helpers are."""
    from pyspark.sql import functions as F

    names = ("size", "taken", "fp", "kept", "n_words", "ids", "shard", "hub", "cell", "key", "bucket", "digest", "u", "v", "node", "root", "pos", "line", "n_lines", "batch", "plain", "p_toxic", "license", "target", "_id", "_gone", "_bpe", "_tox", "_quality", "_key", "_keep", "__id", "_all", "_sha")
    return docs.select("*", *[F.lit("x").alias(n) for n in names])


def small_table(spark, name="documents"):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
