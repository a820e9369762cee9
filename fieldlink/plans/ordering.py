"""Order-dependent helpers that stay distributed under skew.

A window ``row_number() OVER (ORDER BY ..)`` moves every row into one task,
and ``lag() OVER (PARTITION BY key ..)`` puts a hot key into one task. Both
helpers here range-partition on the full sort key instead (Spark samples the
bounds, so one key with a third of the rows is split over many tasks), cut the
lineage with a reliable checkpoint so the partitions are fixed, and repair the
partition boundaries with a per-partition summary whose size is bounded by the
number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlink.session import ensure_checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id = partition << 33 | row index


def _ranged(df: DataFrame, order: list[Column], partitions: int | None) -> DataFrame:
    """Range-partition and sort, then checkpoint.

    Without ``partitions`` the count is left to AQE, which coalesces the range
    shuffle to its advisory partition size (neighbouring ranges merge, so the
    order across partitions holds).
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order).checkpoint(eager=True)


def with_position(df: DataFrame, order: list[Column], out: str = "pos",
                  partitions: int | None = None) -> DataFrame:
    """Add a 1-based position in ``order`` (like ``row_number()`` over the whole frame)."""
    ck = _ranged(df, order, partitions)
    tagged = (ck.withColumn("_pid", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # Summary has one row per partition: a bounded broadcast.
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_off") + F.col("_local") + F.lit(1))
            .drop("_pid", "_local", "_off"))


def with_previous(df: DataFrame, key: str, order: str, value: str, out: str | None = None,
                  partitions: int | None = None) -> DataFrame:
    """Add ``out`` = ``value`` of the previous row of the same ``key`` in ``order``.

    Equal to ``lag(value) OVER (PARTITION BY key ORDER BY order)``, but a hot
    key is spread over several tasks: ``lag`` runs inside the range partitions,
    and the first row of each takes the last row of the one before. Rows with a
    null key have no previous row.
    """
    out = out or f"prev_{value}"
    ensure_checkpoint_dir(df.sparkSession)
    by = [F.col(key), F.col(order)]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    # The range partition's number travels with the row, so the partitions stay as they are from here on.
    ck = ranged.withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    pair = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    inside = ck.withColumn("_prev", F.lag(pair).over(Window.partitionBy("_pid").orderBy(*by)))
    # One row per partition: a bounded broadcast.
    last = ck.groupBy("_pid").agg(F.max_by(pair, F.struct(*by)).alias("_last"))
    carry = last.select("_pid", F.lag("_last").over(Window.orderBy("_pid")).alias("_carry"))
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    return (inside.join(F.broadcast(carry), "_pid")
            .withColumn(out, F.when(prev["k"] == F.col(key), prev["v"]))
            .drop("_pid", "_prev", "_carry"))
