"""A training corpus from raw documents: quality, exact dedup, near dedup, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before kept; all but the last return the columns of ``docs``. ``run`` writes
every stage's result and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlink.llm import exact_dedup, packing, pii, quality, simhash
from fieldlink.llm.common import ascii_lower, documents, staged, unused
from fieldlink.session import ship_package

#: Documents scored below this are rejected.
QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the line classifier scores below QUALITY; learnt from the labels outside the held-out fold."""
    ship_package(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "__score")
    scored = docs.withColumn(score, quality.scorer(model)(F.coalesce(docs["text"], F.lit(""))))
    return scored.where(F.col(score) >= QUALITY).select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, whatever the case of A-Z: the smallest id."""
    ship_package(spark)
    return exact_dedup.deduplicate(docs, normalise=ascii_lower)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 4-word shingles, at most 4 differing bits; the smallest id."""
    ship_package(spark)
    return simhash.deduplicate(docs, words=4, distance=4)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in every text; ``n_chars`` follows the text."""
    ship_package(spark)
    clean = docs.withColumn("text", pii.masker(pii.fit(docs))("text"))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))
    return clean.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; a row per piece."""
    ship_package(spark)
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]

#: The classifier, the spans and the packing are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; the last one's rows."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
