"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlink.llm.common import documents, id_and_text, staged, unused


@dataclasses.dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int  # the number that rows get
    weight: float = 1.0


def even_tree(shards: int = 16, regions: int = 4, racks: int = 2) -> list[Shard]:
    """``shards`` equal shards dealt to ``regions`` x ``racks`` in order."""
    per = -(-shards // (regions * racks))
    return [Shard(s // (per * racks), s // per % racks, s) for s in range(shards)]


def grown_tree(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, as a region of its own.

    The draws of all older regions stay as they were, so a row either stays
    where it is or goes to the new shard.
    """
    return [*tree, Shard(max(s.region for s in tree) + 1, 0, max(s.shard for s in tree) + 1, weight)]


def _pick(key: Column, level: int, names: list[int], weights: list[float]) -> Column:
    """The child that wins the weighted draw: smallest -ln(u) / weight over u = hash(key, level, child)."""
    def draw(name: int, weight: float) -> Column:
        h = F.xxhash64(key, F.lit(level).cast("long"), F.lit(name).cast("long"))
        u = (F.shiftrightunsigned(h, 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(name).alias("child"))
    if len(names) == 1:
        return F.lit(names[0])
    return F.array_min(F.array(*[draw(n, w) for n, w in zip(names, weights, strict=True)]))["child"]


def _switch(on: Column, cases: list[tuple[int, Column]]) -> Column:
    out = None
    for value, result in cases:
        out = F.when(on == value, result) if out is None else out.when(on == value, result)
    return out


def place(df: DataFrame, key: str, tree: list[Shard], name: str = "shard") -> DataFrame:
    """``df`` with the shard of each row as column ``name`` (int), in place of a column of that name; all others stay.

    Every level draws among the children of the node that won the level above;
    a node weighs what its shards weigh together. A draw depends on the key,
    the node's number and its weight alone, so a changed weight moves rows
    only into, out of or within the subtrees that hold it. The expression has
    one hash per child of the nodes passed through.
    """
    col, regions, columns = df[key], sorted({s.region for s in tree}), df.columns
    region, rack = unused(df, "__region"), unused(df, "__rack")
    weigh = lambda **at: sum(s.weight for s in tree if all(getattr(s, k) == v for k, v in at.items()))
    df = df.withColumn(region, _pick(col, 1, regions, [weigh(region=r) for r in regions]))
    racks = {r: sorted({s.rack for s in tree if s.region == r}) for r in regions}
    df = df.withColumn(rack, _switch(F.col(region), [
        (r, _pick(col, 1000 + r, racks[r], [weigh(region=r, rack=k) for k in racks[r]])) for r in regions]))
    leaf = []
    for r in regions:
        own = []
        for k in racks[r]:
            shards = [s for s in tree if (s.region, s.rack) == (r, k)]
            own.append((k, _pick(col, 1_000_000 + r * 1000 + k, [s.shard for s in shards], [s.weight for s in shards])))
        leaf.append((r, _switch(F.col(rack), own)))
    placed = _switch(F.col(region), leaf).cast("int").alias(name)
    return df.select(*[F.col(f"`{c}`") for c in columns if c.lower() != name.lower()], placed)


def assign(docs: DataFrame, tree: list[Shard], grown: list[Shard], id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row per input row.

    Law ``key``: the id and the tree alone decide the shard. ``size`` is the
    text's UTF-8 bytes plus one (a null text has none). ``slot`` numbers each
    shard's rows from 0 without gaps: rows are numbered within (shard, input
    split) and offset by the splits before, so no shard has to fit one task.
    All null ids share a shard; rows that repeat an id share it too and get
    slots of their own. An empty table gives an empty result.
    """
    rows = id_and_text(docs, id_col, text_col)
    raw = F.col("text").cast("binary")
    rows = rows.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
                       F.spark_partition_id().alias("__split"), F.monotonically_increasing_id().alias("__at"))
    placed = place(place(rows, "doc_id", tree), "doc_id", grown, "grown_shard")
    placed = staged(placed, "placed")
    counts = placed.groupBy("shard", "__split").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    order = Window.partitionBy("shard", "__split").orderBy("doc_id", "__at")
    numbered = placed.withColumn("__nth", F.row_number().over(order) - 1).join(offsets, ["shard", "__split"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                           (F.col("__before") + F.col("__nth")).cast("long").alias("slot"),
                           F.col("grown_shard").cast(T.IntegerType()).alias("grown_shard"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """Contract query: all documents into shards 0 to 15, and where they go with one more shard."""
    tree = even_tree(16)
    return assign(documents(spark, sf_dir), tree, grown_tree(tree))
