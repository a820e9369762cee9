"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Every query reads the driver's tables through the stand-ins in
:mod:`fieldlink.plans.fixtures` and runs the stage code from
:mod:`fieldlink.operators` on them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlink.config import (
    DEFAULT_SITES,
    TOPIC_ASSET_BROADCAST,
    TOPIC_ASSET_REQUEST,
    TOPIC_AUDIT,
    TOPIC_IMAGE_DOWNLOAD,
    TOPIC_IMAGEFEED,
    TOPIC_REPLICA_INFO,
    TOPIC_TTL_SECONDS,
    TOPIC_VOLUME_INFO,
)
from fieldlink import functions as fx
from fieldlink.functions.paths import relative_to
from fieldlink.operators import activity, edge, hq, monitor
from fieldlink.plans import fixtures as fix
from fieldlink.schemas import (
    ASSET_MSG,
    AUDIT_MSG,
    IMAGEFEED_MSG,
    REPLICA_INFO_MSG,
    VOLUME_INFO_MSG,
)
from fieldlink.sources import documents as docs
from fieldlink.sources import feed as feedsrc
from fieldlink.sources import topics
from fieldlink.sources.volumes import copy_files, file_digests, list_volume
from fieldlink.sources.volumes import mirror_diff as _mirror_diff
from fieldlink.sources.volumes import volume_usage as _volume_usage

SITES = DEFAULT_SITES
SAMPLE_SEED = "42"
SAMPLE_N = 5
ACTIVITY_N = 20
ACTIVITY_TTL_S = 86400  # one day on the stand-in data (20 s would leave nearly nothing)

TOPIC_SCHEMAS = {
    TOPIC_IMAGEFEED: IMAGEFEED_MSG,
    TOPIC_IMAGE_DOWNLOAD: ASSET_MSG,
    TOPIC_ASSET_BROADCAST: ASSET_MSG,
    TOPIC_ASSET_REQUEST: ASSET_MSG,
    TOPIC_AUDIT: AUDIT_MSG,
    TOPIC_REPLICA_INFO: REPLICA_INFO_MSG,
    TOPIC_VOLUME_INFO: VOLUME_INFO_MSG,
}


# --- shared building blocks ---------------------------------------------------

def _log(spark, d):
    """The whole topic log (stored stand-in archive)."""
    return topics.read_topic_log(spark, fix.stored_topic_log(spark, d, SITES))


def _raw(spark, d, topic):
    """One topic read from the stored log (only its partition is listed)."""
    return topics.read_topic(spark, fix.stored_topic_log(spark, d, SITES), topic, partitioned=True)


def _consume(spark, d, topic, only=None):
    """One topic read from the stored log and decoded; ``only``: a condition that spares the rest the decoding."""
    raw = _raw(spark, d, topic)
    return topics.consume(raw if only is None else raw.filter(only), topic, TOPIC_SCHEMAS[topic])


def _documents(spark, d, ids=None):
    """The document table (stored stand-in changelog), newest version per id; with
    ``ids``, only those documents are aggregated."""
    return docs.read_current(spark, fix.stored_documents(spark, d, SITES), ids=ids)


def _normalized_feed(spark, d):
    """Feed files read as JSON (declared schema), items exploded and normalized."""
    files = feedsrc.read_feed_files(spark, fix.stored_feed_files(spark, d, SITES))
    return hq.normalize_feed(feedsrc.explode_items(files))


def _download_outcomes(spark, d, only=None):
    msgs = _consume(spark, d, TOPIC_IMAGEFEED, only)
    return hq.image_download(msgs, _documents(spark, d, msgs), fix.stored_listing(spark, d, "images", SITES),
                             fix.stored_actions(spark, d, "store", SITES), SITES)


def _responses(spark, d, only=None):
    msgs = _consume(spark, d, TOPIC_ASSET_REQUEST, only)
    return hq.asset_response(msgs, _documents(spark, d, msgs), SITES)


def _lifecycle(spark, d, assets=None):
    """State of all assets, or of those in ``assets``."""
    events = [_consume(spark, d, TOPIC_ASSET_BROADCAST), fix.stored_actions(spark, d, "click", SITES),
              fix.stored_actions(spark, d, "publication", SITES)]
    if assets is not None:
        events = [e.join(assets, "assetID", "left_semi") for e in events]
    return edge.asset_lifecycle(*events, fix.stored_listing(spark, d, "mirror", SITES), SITES)


def _replica_obs(spark, d):
    return monitor.replica_observations(_consume(spark, d, TOPIC_REPLICA_INFO), SITES)


#: The services whose tiles follow messages: their topic, and their tiles from the messages that meet a condition.
MESSAGE_TILES = [
    (TOPIC_IMAGEFEED, lambda spark, d, only: activity.feed_tiles(_consume(spark, d, TOPIC_IMAGEFEED, only))),
    (TOPIC_IMAGEFEED, lambda spark, d, only: activity.download_tiles(hq.download_published(_download_outcomes(spark, d, only)))),
    (TOPIC_IMAGE_DOWNLOAD, lambda spark, d, only: activity.broadcast_tiles(
        hq.asset_broadcast(_consume(spark, d, TOPIC_IMAGE_DOWNLOAD, only)))),
    (TOPIC_ASSET_REQUEST, lambda spark, d, only: activity.response_tiles(_responses(spark, d, only))),
]


# --- A: sources and sinks -----------------------------------------------------

def feed_normalize(spark: SparkSession, d: str) -> DataFrame:
    """A3/B2: feed files exploded from ``collection.items``; id, title, description, link, file name."""
    return _normalized_feed(spark, d).select("assetID", "title", "description", "href", "filename")


def feed_message(spark, d):
    """B1: IMAGEFEED message bodies for the valid feed items."""
    return hq.feed_messages(_normalized_feed(spark, d), SITES)


def assign_asset_ids(spark, d):
    """B2: stable 12-hex asset id from ``page_id:url``."""
    p = fix.table(spark, d, "pages")
    return p.select("page_id", fx.asset_id(F.col("page_id"), F.col("url")).alias("asset_id"))


def feed_sample(spark, d):
    """Five feed items without replacement in a seeded hash order."""
    return hq.sample_items(_normalized_feed(spark, d), SAMPLE_N, SAMPLE_SEED).select("assetID", "title")


def topic_consume(spark, d):
    """Well-formed IMAGEFEED messages decoded from the topic log."""
    return _consume(spark, d, TOPIC_IMAGEFEED).select("seq", "assetID", "title", "origin")


def document_upsert(spark, d):
    """A4: every event as a whole-document write; newest version per id, with its raw JSON."""
    cur = docs.current(fix.stored_document_changes(spark, d, SITES))
    return cur.select(F.col("_id").alias("assetID"), "seq", F.col("extra").alias("raw"),
                      F.get_json_object("extra", "$.k").cast("int").alias("k"))


def document_lookup(spark, d):
    """A5: stored documents whose id appears in an IMAGEFEED message."""
    found = docs.lookup(_documents(spark, d), _consume(spark, d, TOPIC_IMAGEFEED))
    return found.select(F.col("_id").alias("assetID"), F.get(F.col("data"), 0)["title"].alias("title"))


# --- HQ stages ----------------------------------------------------------------

def image_download(spark, d):
    """IMAGEFEED messages looked up in the documents, checked against the source
    listing, given a download location, and settled with the copy job's result table
    (``store_results``; the byte copy itself runs in the streaming service). Published rows."""
    return hq.download_published(_download_outcomes(spark, d)).select(
        "seq", "assetID", "title", "description", "filename", "location", "status")


def image_download_deadletter(spark, d):
    """Messages with no document (``not_found``) or no source file (``file_missing``)."""
    return hq.download_deadletter(_download_outcomes(spark, d))


def filename_collisions(spark, d):
    """M: file names shared by several stored documents (flat storage would overwrite them)."""
    return hq.filename_collisions(_documents(spark, d))


def download_outcomes(spark, d):
    """Message count per download outcome."""
    return hq.download_outcome_counts(_download_outcomes(spark, d))


def asset_broadcast(spark, d):
    """IMAGE_DOWNLOAD records forwarded unless failed."""
    return hq.asset_broadcast(_consume(spark, d, TOPIC_IMAGE_DOWNLOAD)).select("seq", "assetID", "status")


def asset_response(spark, d):
    """ASSET_REQUEST messages looked up; copy manifest per asset with request counts."""
    return hq.response_copies(_responses(spark, d)).select("assetID", "filename", "src", "dst", "n_requests")


def _copied(spark, d, manifest, root):
    """Real copies of ``manifest`` (``src, dst`` as in SITES) from the stored volumes to a run's own folder.

    The copy job runs once, in the write of its results; returns ``dst, ok, n_bytes, sha256``.
    """
    volumes_at, run = fix.stored_volumes(spark, d, SITES), fix.blocked_run(spark, d, root, SITES)
    copies = copy_files(manifest.select(F.concat(F.lit(volumes_at), "src").alias("src"), F.concat(F.lit(run), "dst").alias("dst")))
    copies.write.parquet(f"{run}/_results")
    done = spark.read.schema(copies.schema).parquet(f"{run}/_results")
    return done.select(F.expr(f"substr(dst, {len(run) + 1})").alias("dst"), "ok", F.col("length").alias("n_bytes"), "sha256")


def _listed(spark, d, root):
    """Listing of a real volume, with the paths it has in SITES."""
    at = fix.stored_volumes(spark, d, SITES)
    return list_volume(spark, at + root).withColumn("path", F.expr(f"substr(path, {len('file:' + at) + 1})"))


def image_download_copies(spark, d):
    """The download stage with real files: the source volume is listed, the planned
    copies run (checked by length and digest, published whole), and their outcomes settle the messages."""
    msgs = _consume(spark, d, TOPIC_IMAGEFEED)
    planned = hq.plan_downloads(msgs, _documents(spark, d, msgs), _listed(spark, d, SITES.source_images), SITES)
    manifest = hq.store_manifest(planned)
    done = _copied(spark, d, manifest, SITES.download_dir)
    outcomes = hq.resolve_downloads(planned, manifest.join(done, "dst").select("seq", "ok"))
    return hq.download_published(outcomes).join(done.withColumnRenamed("dst", "location"), "location", "left").select(
        "seq", "assetID", "title", "description", "filename", "location", "status", "n_bytes", "sha256")


def asset_response_copies(spark, d):
    """Requested assets really copied from the download volume to the HQ files, with each copy's outcome."""
    manifest = hq.response_copies(_responses(spark, d))
    return manifest.join(_copied(spark, d, manifest, SITES.hq_files), "dst").select(
        "assetID", "filename", "src", "dst", "n_requests", "ok", "n_bytes", "sha256")


def volume_files(spark, d):
    """The real files of the HQ files and mirror volumes, found by the walk."""
    parts = [_listed(spark, d, root).select(F.lit(root).alias("volume"), relative_to("path", root).alias("rel_path"), "length")
             for root in (SITES.hq_files, SITES.edge_files)]
    return parts[0].unionByName(parts[1])


def asset_digests(spark, d):
    """Length and SHA-256 of every stored document's file, read in executors; nulls where there is none."""
    at = fix.stored_volumes(spark, d, SITES)
    wanted = _documents(spark, d).filter("imageDownloadLocation IS NOT NULL").select(
        F.col("_id").alias("assetID"), F.col("imageDownloadLocation").alias("location"))
    read = file_digests(wanted.select(F.concat(F.lit(at), "location").alias("path")))
    read = read.select(F.expr(f"substr(path, {len(at) + 1})").alias("location"), F.col("length").alias("n_bytes"), "sha256")
    return wanted.join(read, "location", "left").select("assetID", "location", "n_bytes", "sha256")


def asset_response_deadletter(spark, d):
    """Requests whose document is missing or has no location."""
    return hq.response_deadletter(_responses(spark, d))


# --- EDGE stages --------------------------------------------------------------

def broadcast_listener(spark, d):
    """First broadcast per asset, status ``!``."""
    return edge.broadcast_listener(_consume(spark, d, TOPIC_ASSET_BROADCAST)).select("assetID", "seq", "status")


def asset_lifecycle(spark, d):
    """Closed-form status per broadcast asset from broadcasts, clicks, publications and the mirror listing."""
    return _lifecycle(spark, d).select("assetID", "status")


def asset_status_counts(spark, d):
    """E5: assets per status."""
    return edge.status_counts(_lifecycle(spark, d))


def asset_request_publish(spark, d):
    """C4: assets waiting in ``requesting...``."""
    return edge.request_publish(_lifecycle(spark, d))


def asset_viewer(spark, d):
    """C4/D3: assets whose file is in the mirror, with its path."""
    return edge.viewer(_lifecycle(spark, d)).select("assetID", "path")


def published_assets(spark, d):
    """The asset table newest first with a 1-based position."""
    return edge.published_assets(_lifecycle(spark, d))


# --- monitoring ---------------------------------------------------------------

def audit_replication(spark, d):
    """Audit records flagged when they show the upstream replication being added."""
    return monitor.audit_replication(_consume(spark, d, TOPIC_AUDIT), SITES)


def replica_state(spark, d):
    """Latest derived replica state per replica."""
    return monitor.replica_state(_replica_obs(spark, d))


def replica_state_changes(spark, d):
    """E3/F: observations whose derived state differs from the replica's previous one."""
    return monitor.replica_state_changes(_replica_obs(spark, d)).select("replica", "seq", "state", "prev_state")


def mirror_lag(spark, d):
    """Lag of the latest volume observation per replica, as seconds and text."""
    return monitor.mirror_lag(_consume(spark, d, TOPIC_VOLUME_INFO))


def service_counters(spark, d):
    """Rows each service emitted (or read), zero for services with none."""
    outcomes = _download_outcomes(spark, d)
    responses = _responses(spark, d)
    counted = {
        "IMAGE Feed": _consume(spark, d, TOPIC_IMAGEFEED),
        "Image Download": hq.download_published(outcomes),
        "Asset Broadcast": hq.asset_broadcast(_consume(spark, d, TOPIC_IMAGE_DOWNLOAD)),
        "Asset Response": responses.filter(F.col("reason").isNull()),
        "Audit Listener": _consume(spark, d, TOPIC_AUDIT),
        "Broadcast Listener": _consume(spark, d, TOPIC_ASSET_BROADCAST),
        "Asset Request": fix.stored_actions(spark, d, "publication", SITES),
        "Asset Viewer": edge.viewer(_lifecycle(spark, d)),
    }
    return monitor.service_counters(spark, counted)


# --- volumes and topics -------------------------------------------------------

def mirror_diff(spark, d):
    """Mirror plan between the HQ files listing and the edge mirror listing."""
    plan = _mirror_diff(fix.stored_listing(spark, d, "hq_files", SITES), SITES.hq_files,
                        fix.stored_listing(spark, d, "mirror", SITES), SITES.edge_files)
    return plan.select("rel_path", "action")


def volume_usage(spark, d):
    """Files and bytes per volume listing."""
    return _volume_usage({SITES.hq_files: fix.stored_listing(spark, d, "hq_files", SITES),
                          SITES.edge_files: fix.stored_listing(spark, d, "mirror", SITES)})


def topic_replicate(spark, d):
    """The log split by origin site, replicated both ways; each site's view."""
    log = _log(spark, d)
    sites = {s: log.filter(F.col("origin") == s) for s in ("HQ", "EDGE")}
    return topics.replicate(sites).select("site", "origin", "topic", "seq")


def topic_retention(spark, d):
    """Messages within 38400 s of the newest."""
    return topics.expire(_log(spark, d), TOPIC_TTL_SECONDS).select("seq", "topic", "ts")


def malformed_messages(spark, d):
    """Messages whose JSON does not decode."""
    return topics.malformed(_log(spark, d), TOPIC_SCHEMAS).select("seq", "topic")


# --- activity -----------------------------------------------------------------

def activity_feed(spark, d):
    """The five services' tiles, newest 20, texts shortened; each service's from its newest messages."""
    parts = [activity.newest_of(_raw(spark, d, topic), lambda seq, make=make: make(spark, d, F.col("seq") >= seq), ACTIVITY_N)
             for topic, make in MESSAGE_TILES]
    published = fix.stored_actions(spark, d, "publication", SITES)
    # A viewer tile has the seq of its asset's last publication: only assets published from there on can have one.
    recent = lambda seq: published.filter(F.col("seq") >= seq).select("assetID").distinct()
    parts.append(activity.newest_of(published, lambda seq: activity.viewer_tiles(edge.viewer(_lifecycle(spark, d, recent(seq)))),
                                    ACTIVITY_N))
    return activity.newest(activity.all_tiles(*parts), ACTIVITY_N)


def activity_visible(spark, d):
    """Tiles still shown after a one-day time-to-live (viewer tiles never expire).

    Every decodable feed message gives a tile, so the newest tile is no older
    than the newest of them; messages more than the time-to-live before that
    can't show, and their days are not read.
    """
    last = _consume(spark, d, TOPIC_IMAGEFEED).agg(F.max("ts")).first()[0]
    only = None
    if last is not None:
        since = last - dt.timedelta(seconds=ACTIVITY_TTL_S)
        only = (F.col("dt") >= F.lit(since.date())) & (F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    recent = [make(spark, d, only) for _, make in MESSAGE_TILES]
    tiles = activity.all_tiles(*recent, activity.viewer_tiles(edge.viewer(_lifecycle(spark, d))))
    return activity.visible(tiles.select("seq", "ts", "service"), ACTIVITY_TTL_S).select("seq", "service")


# --- scalar functions ---------------------------------------------------------

def path_and_text_functions(spark, d):
    """I: the scalar functions over page URLs and titles."""
    p = fix.page_info(spark, d)
    secs = F.col("html_len") * 97 - 400000
    return p.select(
        "page_id",
        fx.last_segment("url").alias("last_segment"),
        fx.basename("url").alias("basename"),
        fx.basename_normpath("url").alias("basename_normpath"),
        fx.asset_id(F.col("page_id"), F.col("url")).alias("asset_id"),
        F.to_json(F.struct(F.col("url"))).alias("json_text"),
        F.get_json_object(F.to_json(F.struct(F.col("url"))), "$.url").alias("json_roundtrip"),
        fx.utf8_roundtrip("title").alias("utf8_title"),
        fx.topic_address(F.lit(SITES.hq_stream), F.lit(TOPIC_IMAGEFEED)).alias("topic_address"),
        fx.quote_plus("url").alias("quoted_url"),
        fx.shorten("title", 32).alias("title_32"),
        fx.shorten("title", 64).alias("title_64"),
        secs.alias("seconds"),
        fx.timedelta_text(secs).alias("timedelta_text"),
        fx.ms_to_seconds(secs * 7 + 3).alias("ms_to_s"),
        F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit("untitled")).alias("title_or_default"),
        F.col("url").contains("example.com").alias("has_example"),
        fx.second_word("title").alias("second_word"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "feed_normalize": feed_normalize,
    "feed_message": feed_message,
    "assign_asset_ids": assign_asset_ids,
    "feed_sample": feed_sample,
    "topic_consume": topic_consume,
    "document_upsert": document_upsert,
    "document_lookup": document_lookup,
    "image_download": image_download,
    "image_download_deadletter": image_download_deadletter,
    "download_outcomes": download_outcomes,
    "filename_collisions": filename_collisions,
    "image_download_copies": image_download_copies,
    "asset_response_copies": asset_response_copies,
    "volume_files": volume_files,
    "asset_digests": asset_digests,
    "asset_broadcast": asset_broadcast,
    "broadcast_listener": broadcast_listener,
    "asset_lifecycle": asset_lifecycle,
    "asset_status_counts": asset_status_counts,
    "asset_request_publish": asset_request_publish,
    "asset_response": asset_response,
    "asset_response_deadletter": asset_response_deadletter,
    "asset_viewer": asset_viewer,
    "published_assets": published_assets,
    "audit_replication": audit_replication,
    "replica_state": replica_state,
    "replica_state_changes": replica_state_changes,
    "mirror_lag": mirror_lag,
    "mirror_diff": mirror_diff,
    "volume_usage": volume_usage,
    "topic_replicate": topic_replicate,
    "topic_retention": topic_retention,
    "activity_feed": activity_feed,
    "activity_visible": activity_visible,
    "service_counters": service_counters,
    "malformed_messages": malformed_messages,
    "path_and_text_functions": path_and_text_functions,
}
