"""Exact dedup: group by a 128-bit content hash, compare the bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlink.llm.common import ascii_lower, id_and_text, staged, unused


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
           normalise: Callable[[Column], Column] = lambda c: c,
           content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows are grouped by ``content_hash`` of the normalised text. Bytes are
    compared inside every group by its smallest and largest text, which one
    map-side combined aggregate finds without bringing a group together: all
    texts of a group are equal exactly when the two are. Groups that hold
    different texts (collisions) are grouped again by the text itself. The
    row with the smallest (``keep='min'``, the default stable id) or largest
    id of each group stays.

    A null text counts as empty. Rows that repeat an id and text are each
    counted and each returned; all copies of the id that stays are marked
    ``kept`` (``deduplicate`` leaves one). Null ids rank below all others for
    ``max`` and above for ``min``; a group of null ids only keeps its rows.
    An empty table gives an empty result; other columns are ignored.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = id_and_text(docs, id_col, text_col).select("doc_id", normalise(F.col("text")).alias("norm"))
    rows = rows.withColumn("h", content_hash(F.col("norm")))
    groups = rows.groupBy("h").agg(F.count("*").alias("group_size"), pick("doc_id").alias("keep_id"),
                                   F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    groups = staged(groups.select("h", "group_size", "keep_id", F.sha2("lo", 256).alias("text_sha256"),
                                  (F.col("lo") == F.col("hi")).alias("same")), "exact-groups")
    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    clean = rows.select("doc_id", "h").join(groups.where("same"), "h").select(*out)
    clashing = groups.where(~F.col("same")).select("h")
    if clashing.isEmpty():
        return clean
    split = rows.join(clashing, "h", "left_semi").drop("h")
    parts = split.groupBy("norm").agg(F.count("*").alias("group_size"), pick("doc_id").alias("keep_id"))
    parts = parts.withColumn("text_sha256", F.sha2("norm", 256))
    return clean.unionByName(split.join(parts, "norm").select(*out))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one per distinct normalised text."""
    marks = staged(assign(docs, id_col, text_col, **how).where("kept"), "exact-kept")
    keys = marks.select(marks["doc_id"].alias("__keep"), "text_sha256").distinct()
    sha = unused(docs, "__sha")
    hashed = docs.withColumn(sha, F.sha2(how.get("normalise", lambda c: c)(F.coalesce(docs[text_col], F.lit(""))), 256))
    stay = hashed.join(keys, (hashed[id_col].eqNullSafe(keys["__keep"])) & (hashed[sha] == keys["text_sha256"]),
                       "left_semi")
    repeated = marks.groupBy("doc_id", "text_sha256").count().where("count > 1")
    if not repeated.isEmpty():  # rows that repeat an id and its text
        stay = stay.dropDuplicates([id_col, sha])
    return stay.select(docs.columns)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: texts equal after lower-casing A-Z, the largest doc_id stays."""
    from fieldlink.llm.common import documents

    return assign(documents(spark, sf_dir), keep="max", normalise=ascii_lower)


OP9_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
