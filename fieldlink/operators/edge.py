"""EDGE stages: broadcast listener, request lifecycle, request publish, viewer.

The reference keeps a mutable in-memory list of assets per site. Here the
asset list is derived: one aggregate per ``assetID`` over the union of the
broadcast, click and publication events, then a closed-form status:

    no broadcast                -> no row
    last click before broadcast -> '!'
    no publication since click  -> 'requesting...'
    file not in the mirror      -> 'requested'
    otherwise                   -> 'received'

``min``/``max`` are combined map-side, so a hot asset is pre-aggregated in
every task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlink.config import (
    DEFAULT_SITES,
    STATUS_LISTED,
    STATUS_RECEIVED,
    STATUS_REQUESTED,
    STATUS_REQUESTING,
    Sites,
)
from fieldlink.functions.paths import asset_path
from fieldlink.plans.ordering import with_position
from fieldlink.sources.volumes import file_present


def broadcast_listener(broadcasts: DataFrame) -> DataFrame:
    """First broadcast per asset, status replaced by ``!``."""
    first = F.min(F.struct("seq", "ts", "title", "description", "filename"))
    return (broadcasts.groupBy("assetID").agg(first.alias("_b"))
            .select("assetID", "_b.*", F.lit(STATUS_LISTED).alias("status")))


def lifecycle_events(broadcasts: DataFrame, clicks: DataFrame, published: DataFrame) -> DataFrame:
    """The three event kinds as one stream: ``assetID, kind, seq, rec``."""
    rt = rec_type(broadcasts)
    b = broadcasts.select("assetID", F.lit("b").alias("kind"), "seq",
                          F.struct("seq", "ts", "title", "description", "filename").alias("rec"))
    c = clicks.select("assetID", F.lit("c").alias("kind"), "seq", F.lit(None).cast(rt).alias("rec"))
    p = published.select("assetID", F.lit("p").alias("kind"), "seq", _seq_ts_rec(rt).alias("rec"))
    return b.unionByName(c).unionByName(p)


def lifecycle_fold(events: DataFrame) -> DataFrame:
    """Per asset: first broadcast record, last click, last publication (E5 aggregate)."""
    return events.groupBy("assetID").agg(
        F.min(F.when(F.col("kind") == "b", F.col("rec"))).alias("_b"),
        F.max(F.when(F.col("kind") == "c", F.col("seq"))).alias("c_seq"),
        F.max(F.when(F.col("kind") == "p", F.col("rec"))).alias("_p"))


def lifecycle_merge(states: DataFrame) -> DataFrame:
    """Combine partial per-asset states (``min``/``max`` are associative)."""
    return states.groupBy("assetID").agg(F.min("_b").alias("_b"), F.max("c_seq").alias("c_seq"),
                                         F.max("_p").alias("_p"))


def lifecycle_state(broadcasts: DataFrame, clicks: DataFrame, published: DataFrame) -> DataFrame:
    """Per asset: first broadcast record, last click, last publication (E5 aggregate)."""
    return lifecycle_fold(lifecycle_events(broadcasts, clicks, published))


def lifecycle_status(state: DataFrame, mirror_listing: DataFrame, sites: Sites = DEFAULT_SITES) -> DataFrame:
    """Closed-form status of each broadcast asset, given the mirror listing (D3)."""
    st = state.filter(F.col("_b").isNotNull()).select(
        "assetID",
        F.col("_b.seq").alias("b_seq"), "c_seq", F.col("_p.seq").alias("p_seq"), F.col("_p.ts").alias("p_ts"),
        F.col("_b.title").alias("title"), F.col("_b.description").alias("description"),
        F.col("_b.filename").alias("filename"),
        asset_path(sites.edge_files, F.col("assetID"), F.col("_b.filename"), sites.layout).alias("path"),
    )
    st = file_present(st, mirror_listing, "path", "present")
    status = (F.when(F.col("c_seq").isNull() | (F.col("c_seq") < F.col("b_seq")), F.lit(STATUS_LISTED))
              .when(F.col("p_seq").isNull() | (F.col("p_seq") < F.col("c_seq")), F.lit(STATUS_REQUESTING))
              .when(~F.col("present"), F.lit(STATUS_REQUESTED))
              .otherwise(F.lit(STATUS_RECEIVED)))
    return st.withColumn("status", status)


def asset_lifecycle(broadcasts: DataFrame, clicks: DataFrame, published: DataFrame,
                    mirror_listing: DataFrame, sites: Sites = DEFAULT_SITES) -> DataFrame:
    """Status of every broadcast asset.

    ``broadcasts``: ASSET_BROADCAST records; ``clicks``: row clicks
    ``(seq, ts, assetID)``; ``published``: ASSET_REQUEST publications
    ``(seq, ts, assetID)``; ``mirror_listing``: the edge mirror volume.
    """
    return lifecycle_status(lifecycle_state(broadcasts, clicks, published), mirror_listing, sites)


def _seq_ts_rec(rt):
    return F.struct(*[F.col(f.name) if f.name in ("seq", "ts") else F.lit(None).cast(f.dataType).alias(f.name)
                      for f in rt.fields])


def rec_type(broadcasts: DataFrame):
    """Struct type of a lifecycle record (publication rows fill only seq and ts)."""
    from pyspark.sql import types as T

    f = {x.name: x.dataType for x in broadcasts.schema.fields}
    return T.StructType([T.StructField(n, f[n], True) for n in ("seq", "ts", "title", "description", "filename")])


def status_counts(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def request_publish(lifecycle: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Assets waiting to be requested (C4): published with status ``requesting...``."""
    return lifecycle.filter(F.col("status") == STATUS_REQUESTING).select("assetID", "title", "status", *extra)


def viewer(lifecycle: DataFrame) -> DataFrame:
    """Assets whose file arrived in the mirror (C4, D3)."""
    return lifecycle.filter(F.col("status") == STATUS_RECEIVED)


def published_assets(lifecycle: DataFrame) -> DataFrame:
    """Asset table newest first (B7, G1): ``pos, assetID, title, status``."""
    ranked = with_position(lifecycle.select("assetID", "title", "status", "b_seq"),
                           [F.col("b_seq").desc(), F.col("assetID")])
    return ranked.select("pos", "assetID", "title", "status")
