"""Rows that every operator must handle."""

import pytest
from pyspark.sql import types as T

SF01 = "/root/testdata/sf0.01"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
#: Columns whose names the operators use themselves.
CLASHING = ["h", "row", "fp", "u", "v", "size", "n", "words", "start", "score", "__row", "__sha", "__split", "bucket"]


@pytest.fixture(scope="session")
def llm(spark):
    """The session, with the package sent to its workers."""
    from fieldlink.session import ship_package

    ship_package(spark)
    return spark


def table(spark, rows, parts=3):
    """(doc_id, text) rows with extra columns of clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def words(n, seed=0):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(["ta", "ro", "li", "me", "sun", "ka"]) for _ in range(r.randint(1, 4))) for _ in range(n))


#: Nulls, empty and blank texts, ties, repeated rows, a null id, a long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one TWO"), (6, "é É Ünï"), (7, "One two"), (7, "One two"),
       (None, "One two"), (None, None), (8, words(30_000, 5)), (9, words(30_000, 5)), (10, "a" * 200_000)]
