"""HQ stages: feed, download, broadcast, response.

Each stage is ``DataFrame -> DataFrame`` and works the same on a batch read of
the topic log and inside ``foreachBatch`` of a stream. Per-message lookups of
the reference become one hash join per batch; failures become a ``reason``
column routed to a dead letter instead of ending the consumer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlink.config import (
    DEFAULT_SITES,
    MESSAGE_CREATOR_ID,
    STATUS_FAILED,
    STATUS_SUCCESS,
    Sites,
)
from fieldlink.functions.paths import asset_path, basename, last_segment
from fieldlink.functions.text import asset_id
from fieldlink.sources.volumes import file_present


def _first(arr: str) -> Column:
    return F.get(F.col(arr), 0)


def normalize_feed(items: DataFrame, id_fields: tuple[str, ...] = ("item_id", "href")) -> DataFrame:
    """Feed items (column ``item``) to ``assetID, title, description, href, filename, reason``.

    ``assetID`` is a stable hash of the item's id fields (B2). Items without a
    ``data`` or ``links`` entry keep a ``reason`` (``no_data``/``no_link``).
    """
    d = F.get(F.col("item.data"), 0)
    ln = F.get(F.col("item.links"), 0)
    fields = {"item_id": d["item_id"], "href": ln["href"], "title": d["title"]}
    passthrough = [c for c in ("file", "item_pos", "raw") if c in items.columns]
    return items.select(
        *passthrough,
        asset_id(*[fields[f] for f in id_fields]).alias("assetID"),
        d["title"].alias("title"),
        d["description"].alias("description"),
        ln["href"].alias("href"),
        last_segment(ln["href"]).alias("filename"),
        F.when(d.isNull(), F.lit("no_data")).when(ln["href"].isNull(), F.lit("no_link")).alias("reason"),
        F.col("item"),
    )


def feed_messages(normalized: DataFrame, sites: Sites = DEFAULT_SITES, keep: tuple[str, ...] = ()) -> DataFrame:
    """IMAGEFEED message bodies for valid items (B1); ``keep`` columns pass through."""
    return normalized.filter(F.col("reason").isNull()).select(
        "title", "description",
        last_segment(F.lit(sites.image_table)).alias("tablename"),
        "assetID",
        F.lit(MESSAGE_CREATOR_ID).alias("messageCreatorID"),
        *keep,
    )


def sample_items(df: DataFrame, n: int, seed: str, id_col: str = "assetID") -> DataFrame:
    """``n`` items without replacement in a seeded hash order (top-k, no global sort)."""
    key = F.sha2(F.concat(F.lit(seed), F.col(id_col)), 256)
    return df.withColumn("_k", key).orderBy("_k").limit(n).drop("_k")


def document_fields(documents: DataFrame) -> DataFrame:
    """Flatten stored documents to the columns stages join on."""
    return documents.select(
        F.col("_id").alias("assetID"),
        _first("data")["title"].alias("doc_title"),
        _first("data")["description"].alias("doc_description"),
        _first("links")["href"].alias("doc_href"),
        F.col("imageDownloadLocation").alias("doc_location"),
        F.lit(True).alias("doc_found"),
    )


def plan_downloads(feed_msgs: DataFrame, documents: DataFrame, source_listing: DataFrame,
                   sites: Sites = DEFAULT_SITES) -> DataFrame:
    """IMAGEFEED messages looked up and checked against the source volume.

    ``outcome`` is ``not_found`` (no document), ``file_missing`` (no source
    file) or ``pending`` (to be stored from ``src`` to ``location``).
    """
    m = feed_msgs.select("seq", "ts", "assetID")
    j = m.join(document_fields(documents), "assetID", "left")
    j = j.withColumn("filename", last_segment("doc_href"))
    j = j.withColumn("src", asset_path(sites.source_images, F.col("assetID"), F.col("filename"), sites.layout))
    j = file_present(j, source_listing, "src", "src_present")
    outcome = (F.when(F.col("doc_found").isNull(), F.lit("not_found"))
               .when(~F.col("src_present"), F.lit("file_missing"))
               .otherwise(F.lit("pending")))
    location = asset_path(sites.download_dir, F.col("assetID"), F.col("filename"), sites.layout)
    return j.select(
        "seq", "ts", "assetID",
        F.col("doc_title").alias("title"),
        F.col("doc_description").alias("description"),
        "filename", "src",
        location.alias("location"),
        outcome.alias("outcome"),
    )


def resolve_downloads(planned: DataFrame, store_results: DataFrame) -> DataFrame:
    """Settle ``pending`` rows with the copy job's ``(seq, ok)``: success or failed."""
    j = planned.join(store_results.select("seq", F.col("ok").alias("_stored")), "seq", "left")
    outcome = (F.when(F.col("outcome") != "pending", F.col("outcome"))
               .when(F.coalesce(F.col("_stored"), F.lit(False)), F.lit(STATUS_SUCCESS))
               .otherwise(F.lit(STATUS_FAILED)))
    return j.withColumn("outcome", outcome).drop("_stored")


def image_download(feed_msgs: DataFrame, documents: DataFrame, source_listing: DataFrame,
                   store_results: DataFrame, sites: Sites = DEFAULT_SITES) -> DataFrame:
    """All IMAGEFEED messages with their download outcome.

    ``outcome``: ``not_found``, ``file_missing``, ``failed`` (storing or the
    document update failed) or ``success``; ``store_results`` is ``(seq, ok)``
    from the copy job (:func:`store_manifest` feeds it).
    """
    return resolve_downloads(plan_downloads(feed_msgs, documents, source_listing, sites), store_results)


def store_manifest(planned: DataFrame) -> DataFrame:
    """Copies to make for pending downloads: ``seq, src, dst``."""
    return planned.filter(F.col("outcome") == "pending").select(
        "seq", "src", F.col("location").alias("dst"))


def download_published(outcomes: DataFrame) -> DataFrame:
    """IMAGE_DOWNLOAD messages: success and failed rows, ``status`` set."""
    return (outcomes.filter(F.col("outcome").isin(STATUS_SUCCESS, STATUS_FAILED))
            .withColumnRenamed("outcome", "status"))


def download_deadletter(outcomes: DataFrame) -> DataFrame:
    """Messages that produce no IMAGE_DOWNLOAD event: ``seq, assetID, reason``."""
    return (outcomes.filter(F.col("outcome").isin("not_found", "file_missing"))
            .select("seq", "assetID", F.col("outcome").alias("reason")))


def download_document_updates(outcomes: DataFrame, documents: DataFrame) -> DataFrame:
    """Whole documents with ``imageDownloadLocation`` set, for successful downloads.

    One update per document: many successful messages for one asset fold into
    the newest (combined map-side), so a popular asset does not write a
    version per message.
    """
    ok = (outcomes.filter(F.col("outcome") == STATUS_SUCCESS)
          .groupBy(F.col("assetID").alias("_id"))
          .agg(F.max_by("location", "seq").alias("location"), F.max("seq").alias("seq")))
    return (documents.drop("seq", "rev").join(ok, "_id")
            .withColumn("imageDownloadLocation", F.col("location"))
            .withColumn("rev", F.lit(1))
            .drop("location"))


def download_outcome_counts(outcomes: DataFrame) -> DataFrame:
    """``outcome, n`` over all messages."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def asset_broadcast(download_msgs: DataFrame) -> DataFrame:
    """Forward IMAGE_DOWNLOAD records unchanged unless they failed.

    A record without a status is not forwarded either (it goes to the dead
    letter via :func:`broadcast_deadletter`).
    """
    return download_msgs.filter(F.col("status").isNotNull() & (F.col("status") != STATUS_FAILED))


def broadcast_deadletter(download_msgs: DataFrame) -> DataFrame:
    return download_msgs.filter(F.col("status").isNull()).select(
        "seq", "assetID", F.lit("no_status").alias("reason"))


def asset_response(requests: DataFrame, documents: DataFrame, sites: Sites = DEFAULT_SITES) -> DataFrame:
    """Every ASSET_REQUEST message with its lookup result.

    ``reason`` is null when the asset can be copied, else ``not_found`` or
    ``no_location``; ``src``/``dst`` are the copy's paths.
    """
    r = requests.select("seq", "ts", "assetID", F.col("title").alias("msg_title"))
    j = r.join(document_fields(documents).select("assetID", "doc_location", "doc_found"), "assetID", "left")
    reason = (F.when(F.col("doc_found").isNull(), F.lit("not_found"))
              .when(F.col("doc_location").isNull(), F.lit("no_location")))
    fname = basename("doc_location")
    return j.select(
        "seq", "ts", "assetID", "msg_title",
        fname.alias("filename"),
        F.col("doc_location").alias("src"),
        asset_path(sites.hq_files, F.col("assetID"), fname, sites.layout).alias("dst"),
        reason.alias("reason"),
    )


def response_copies(responses: DataFrame) -> DataFrame:
    """Copy manifest: one row per asset (``n_requests`` folded), partial-aggregated."""
    return (responses.filter(F.col("reason").isNull())
            .groupBy("assetID", "filename", "src", "dst")
            .agg(F.count(F.lit(1)).alias("n_requests")))


def response_deadletter(responses: DataFrame) -> DataFrame:
    return responses.filter(F.col("reason").isNotNull()).select("seq", "assetID", "reason")


def filename_collisions(documents: DataFrame) -> DataFrame:
    """File names shared by more than one asset: ``filename, n_assets`` (SURVEY M).

    With flat storage these assets would overwrite each other's file; the
    default layout keeps them apart, and this report shows where it matters.
    The distinct count is two-phase (partial per task first), so one very
    common name does not gather all its rows in one task.
    """
    named = document_fields(documents).select("assetID", last_segment("doc_href").alias("filename"))
    return (named.filter(F.col("filename").isNotNull())
            .groupBy("filename").agg(F.countDistinct("assetID").alias("n_assets"))
            .filter(F.col("n_assets") > 1))
