"""Replication monitoring and counters: audit, replica state, mirror lag, service counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlink.config import (
    AUDIT_UPSTREAM_ADD,
    DEFAULT_SITES,
    LAG_SUFFIX,
    NOT_A_VALID_STREAM,
    REPLICA_ERROR,
    REPLICA_NO_STREAM,
    REPLICA_PAUSED,
    REPLICA_SYNCED,
    REPLICA_UNKNOWN,
    SERVICES,
    STATUS_OK,
    Sites,
)
from fieldlink.functions.text import ms_to_seconds, timedelta_text
from fieldlink.plans.ordering import with_previous


def audit_replication(audit: DataFrame, sites: Sites = DEFAULT_SITES) -> DataFrame:
    """Flag audit records that show upstream replication being set up."""
    est = (F.col("operation") == AUDIT_UPSTREAM_ADD) & (F.col("upstreamPath") == sites.hq_replicated_stream)
    return audit.select("seq", "operation", "upstreamPath", F.coalesce(est, F.lit(False)).alias("established"))


def replica_state_expr(sites: Sites = DEFAULT_SITES) -> Column:
    """Derived state of one replica observation (E3); null when it changes nothing."""
    needle = sites.edge_replicated_stream + NOT_A_VALID_STREAM
    no_stream = F.exists(F.coalesce(F.col("errors"), F.array()), lambda e: e["desc"].contains(needle))
    last = F.try_element_at(F.col("data"), F.lit(-1))
    ok_state = (F.when(last.isNull(), F.lit(None).cast("string"))
                .when(F.coalesce(last["paused"], F.lit(False)), F.lit(REPLICA_PAUSED))
                .when(F.coalesce(last["isUptodate"], F.lit(False)), F.lit(REPLICA_SYNCED))
                .otherwise(F.lit(REPLICA_UNKNOWN)))
    return (F.when(F.col("status") == REPLICA_ERROR,
                   F.when(no_stream, F.lit(REPLICA_NO_STREAM)).otherwise(F.lit(REPLICA_ERROR)))
            .when(F.col("status") == STATUS_OK, ok_state))


def replica_observations(replica_info: DataFrame, sites: Sites = DEFAULT_SITES) -> DataFrame:
    """``replica, seq, ts, state`` for observations that carry a state."""
    return (replica_info.select(F.col("key").alias("replica"), "seq", "ts",
                                replica_state_expr(sites).alias("state"))
            .filter(F.col("state").isNotNull()))


def replica_state(observations: DataFrame) -> DataFrame:
    """Latest state per replica (map-side combined ``max_by``)."""
    return (observations.groupBy("replica")
            .agg(F.max_by(F.struct("seq", "state"), F.col("seq")).alias("_l"))
            .select("replica", F.col("_l.seq").alias("seq"), F.col("_l.state").alias("state")))


def replica_state_changes(observations: DataFrame) -> DataFrame:
    """Observations whose state differs from the previous one of the same replica."""
    prev = with_previous(observations.select("replica", "seq", "state"), "replica", "seq", "state",
                         out="prev_state")
    return prev.filter(F.col("prev_state").isNull() | (F.col("prev_state") != F.col("state")))


def mirror_lag(volume_info: DataFrame) -> DataFrame:
    """Lag of the latest volume observation per replica.

    ``lag_s`` = whole seconds between the observation time and the last
    successful mirror (missing time counts as 0); an observation without a
    data entry gives ``ERROR``.
    """
    latest = (volume_info.groupBy(F.col("key").alias("replica"))
              .agg(F.max_by(F.struct("timestamp", "data"), F.col("seq")).alias("_v")))
    first = F.try_element_at(F.col("_v.data"), F.lit(1))
    lag = ms_to_seconds(F.coalesce(F.col("_v.timestamp"), F.lit(0))
                        - F.coalesce(first["lastSuccessfulMirrorTime"], F.lit(0)))
    lag = F.when(first.isNotNull(), lag)
    return latest.select(
        "replica", lag.alias("lag_s"),
        F.when(lag.isNull(), F.lit(REPLICA_ERROR))
        .otherwise(F.concat(timedelta_text(lag), F.lit(LAG_SUFFIX))).alias("lag_text"))


def service_counters(spark: SparkSession, counted: dict[str, DataFrame]) -> DataFrame:
    """``service, n``: rows each service emitted; services with none show 0.

    ``counted`` maps a service name to the DataFrame of what it emitted or
    read. The tagged rows are unioned and counted in one aggregate (partial
    counts per task, one small shuffle); the service list is a fixed
    nine-row table.
    """
    parts = None
    for name, df in counted.items():
        tagged = df.select(F.lit(name).alias("service"))
        parts = tagged if parts is None else parts.unionByName(tagged)
    counts = parts.groupBy("service").agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([(n,) for _, n in SERVICES], "service string")
    return (names.join(counts, "service", "left")
            .select("service", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))
