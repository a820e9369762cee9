"""Defined results for ties and clashing names; hot components are split."""

import pytest
from llm_fixtures import llm, table, words  # noqa: F401
from pyspark.sql import functions as F

from fieldlink.llm import quality, sharding, simhash
from fieldlink.llm.common import components


def test_a_document_labelled_both_ways_counts_as_bad_whatever_the_order(llm):
    docs = table(llm, [(i, words(40, i) + "\n" + words(30, i + 99)) for i in range(60)] + [(3, "aa"), (3, "zz")])
    rows = [(i, i % 2) for i in range(60)]
    models = []
    for both in ([(3, 0), (3, 1)], [(3, 1), (3, 0)], []):
        known = [(i, 0 if i == 3 and not both else q) for i, q in rows if i != 3 or not both] + both
        for parts in (1, 4):
            labels = llm.createDataFrame(known, "doc_id long, quality int").repartition(parts)
            model = quality.fit(docs.repartition(parts), labels)
            models.append([r[0] for r in docs.where("doc_id < 3").orderBy("doc_id").select(
                quality.scorer(model)(F.col("text"))).collect()])
    assert all(m == pytest.approx(models[0], abs=1e-9) for m in models)


def test_placing_keeps_all_other_columns(llm):
    tree = sharding.even_tree(16)
    plain = table(llm, [(i, "x") for i in range(50)])
    odd = plain.withColumn("__region", F.lit("r")).withColumn("__RACK", F.lit("k")).withColumn("Shard", F.lit("old")).withColumn("a.b", F.lit(1))
    got = sharding.place(odd, "doc_id", tree)
    assert set(got.columns) == (set(odd.columns) - {"Shard"}) | {"shard"}
    want = {r["doc_id"]: r["shard"] for r in sharding.place(plain, "doc_id", tree).collect()}
    assert {r["doc_id"]: r["shard"] for r in got.collect()} == want
    assert {(r["__region"], r["__RACK"], r["a.b"]) for r in got.collect()} == {("r", "k", 1)}


def test_a_component_with_most_fingerprints_is_split(llm):
    """Two thirds of all rows have one root; the join of the smallest ids splits it."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: llm.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        llm.conf.set(k, v)
    try:
        roots = llm.range(60_000).select(F.col("id").alias("fp"), (F.col("id") + 7).alias("first_id"),
                                         F.when(F.col("id") % 3 != 0, 1).otherwise(F.col("id")).alias("root")).repartition(8)
        got = simhash.smallest_ids(roots)
        assert got.where("component_id <> CASE WHEN root = 1 THEN 8 ELSE fp + 7 END").count() == 0
        rows = got.withColumn("p", F.spark_partition_id()).groupBy("p").agg(
            F.count("*").alias("count"), F.max("fp"), F.max("component_id")).collect()
        assert sum(r["count"] for r in rows) == 60_000
        assert max(r["count"] for r in rows) < 30_000  # not all 40,000 in one task
    finally:
        for k, v in before.items():
            llm.conf.unset(k) if v is None else llm.conf.set(k, v)


def test_components_of_a_star_and_a_chain(llm):
    star = [(0, i) for i in range(1, 3000)]
    chain = [(10_000 + i, 10_001 + i) for i in range(300)]
    got = {r["node"]: r["root"] for r in components(llm.createDataFrame(star + chain, "u long, v long")).collect()}
    want = {i: 0 for i in range(1, 3000)} | {10_001 + i: 10_000 for i in range(300)}
    assert {k: v for k, v in got.items() if k != v} == want
