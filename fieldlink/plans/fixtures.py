"""Stand-in inputs built from the driver's test tables.

These functions only reshape ``pages`` and ``events`` into the record shapes
the stages read (feed files, stored documents, the topic log, volume
listings, click and publication logs, copy results). Their one join (events
to pages) fills in a message's own fields (title, URL, file name), as its
producer would have. They do none of a stage's work: the lookups, routing,
aggregation and state decisions are done by ``fieldlink.operators`` on top of
them. The topic log, documents, change log, listings, action logs and the
feed (as JSON files) are written once per session under
``spark.checkpoint.dir`` (``stored_*``) and read back through the library's
own sources.

Mapping (one row of ``events`` is one message):

* ``signup`` -> IMAGEFEED, ``view`` -> IMAGE_DOWNLOAD (status ``failed`` when
  ``k < 10``) and a VOLUME_INFO observation, ``purchase`` -> ASSET_BROADCAST,
  ``click`` -> ASSET_REQUEST and a row click, ``error`` -> AUDIT and
  REPLICA_INFO observations. ``view`` rows are also the edge's request
  publications.
* the asset of a message is ``event_id % (pages * 6 div 5)``, so about one
  asset in six has no document.
* ``k = 99``: the JSON text is cut short (malformed message).
* source volume: pages with ``page_id % 10 <> 0``; mirror: a third of those
  plus a few already gone from the source, some with a different length.
* real files (``stored_volumes``): the same volumes with each page's HTML as
  the file, for pages whose URL does not end in ``/`` (those have no file
  name). In a real run (``blocked_run``) the target folder of assets with
  ``page_id % 13 = 0`` is taken by a file, so that their copies fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlink.functions.paths import asset_path
from fieldlink.functions.text import epoch_millis
from fieldlink.config import (
    DEFAULT_SITES,
    HQ,
    EDGE,
    IMAGE_TABLE_NAME,
    MESSAGE_CREATOR_ID,
    NOT_A_VALID_STREAM,
    STATUS_FAILED,
    STATUS_REQUESTING,
    STATUS_SUCCESS,
    TOPIC_ASSET_BROADCAST,
    TOPIC_ASSET_REQUEST,
    TOPIC_AUDIT,
    TOPIC_IMAGE_DOWNLOAD,
    TOPIC_IMAGEFEED,
    TOPIC_REPLICA_INFO,
    TOPIC_VOLUME_INFO,
    Sites,
)

LISTING_MTIME = "2024-01-01 00:00:00"
# Which event type carries each topic (a log partitioned by topic prunes the
# rest at the scan; the stand-in does the same with a pushed-down filter).
TOPIC_EVENT_TYPE = {
    TOPIC_IMAGEFEED: "signup",
    TOPIC_IMAGE_DOWNLOAD: "view",
    TOPIC_VOLUME_INFO: "view",
    TOPIC_ASSET_BROADCAST: "purchase",
    TOPIC_ASSET_REQUEST: "click",
    TOPIC_AUDIT: "error",
    TOPIC_REPLICA_INFO: "error",
}
FEED_FILE_ITEMS = 50  # items per stand-in feed file


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _aid(c: Column) -> Column:
    return F.lpad(c.cast("string"), 12, "0")


def _url_tail(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def page_info(spark: SparkSession, d: str) -> DataFrame:
    """``page_id, assetID, url, title, html_len, filename`` per page."""
    p = table(spark, d, "pages")
    return p.select(
        "page_id", _aid(F.col("page_id")).alias("assetID"), "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.length("html").cast("bigint").alias("html_len"),
        _url_tail(F.col("url")).alias("filename"))


def feed_files(spark: SparkSession, d: str) -> DataFrame:
    """Feed files: ``collection.items`` with up to 50 items each."""
    p = page_info(spark, d)
    item = F.struct(
        F.array(F.struct(F.col("title"), F.col("url").alias("description"),
                         F.col("page_id").cast("string").alias("item_id"))).alias("data"),
        F.array(F.struct(F.col("url").alias("href"))).alias("links"))
    return (p.groupBy((F.col("page_id") / FEED_FILE_ITEMS).cast("bigint").alias("file_no"))
            .agg(F.collect_list(item).alias("items"))
            .select(F.struct("items").alias("collection")))


def documents(spark: SparkSession, d: str, sites: Sites = DEFAULT_SITES) -> DataFrame:
    """Stored documents: one per page; those with a source file have a location."""
    p = page_info(spark, d)
    loc = F.when(F.col("page_id") % 10 != 0,
                 asset_path(sites.download_dir, F.col("assetID"), F.col("filename"), sites.layout))
    return p.select(
        F.col("assetID").alias("_id"),
        F.array(F.struct(F.col("title"), F.col("url").alias("description"),
                         F.col("page_id").cast("string").alias("item_id"))).alias("data"),
        F.array(F.struct(F.col("url").alias("href"))).alias("links"),
        loc.alias("imageDownloadLocation"),
        F.lit(None).cast("string").alias("extra"))


def event_rows(spark: SparkSession, d: str, event_types: list[str] | None = None,
               with_pages: bool = True) -> DataFrame:
    """Events with asset, ``k`` and (optionally) page fields: the base of every message."""
    ev = table(spark, d, "events")
    if event_types is not None:
        ev = ev.filter(F.col("event_type").isin(*event_types))
    pages = table(spark, d, "pages")
    n_assets = pages.select((F.count(F.lit(1)) * 6 / 5).cast("bigint")).scalar()
    e = ev.select(
        F.col("event_id").alias("seq"), "ts", "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("event_id") % n_assets).alias("asset_no"),
        F.col("props"))
    if with_pages:
        p = page_info(spark, d).select(F.col("page_id").alias("asset_no"), "title", "url", "filename")
        e = e.join(p, "asset_no", "left")
    return (e.withColumn("assetID", _aid(F.col("asset_no")))
            .withColumn("origin", F.when(F.col("user_id") % 2 == 0, F.lit(HQ)).otherwise(F.lit(EDGE))))


def topic_log(spark: SparkSession, d: str, sites: Sites = DEFAULT_SITES,
              topics: list[str] | None = None) -> DataFrame:
    """The topic log ``(seq, ts, origin, topic, key, value)``, optionally only some topics."""
    e = event_rows(spark, d, None if topics is None else sorted({TOPIC_EVENT_TYPE[t] for t in topics}))
    max_ms = table(spark, d, "events").select(epoch_millis(F.max("ts"))).scalar()
    k = F.col("k")
    asset_body = lambda status: F.to_json(F.struct(
        "title", F.col("url").alias("description"), "filename", "assetID", status.alias("status")))
    feed = F.to_json(F.struct("title", F.col("url").alias("description"),
                              F.lit(IMAGE_TABLE_NAME).alias("tablename"), "assetID",
                              F.lit(MESSAGE_CREATOR_ID).alias("messageCreatorID")))
    download = asset_body(F.when(k < 10, F.lit(STATUS_FAILED)).otherwise(F.lit(STATUS_SUCCESS)))
    volume = F.to_json(F.struct(
        F.lit(max_ms).alias("timestamp"),
        F.when(k % 7 == 0, F.array().cast("array<struct<lastSuccessfulMirrorTime:bigint>>"))
        .otherwise(F.array(F.struct(epoch_millis(F.col("ts"))
                                    .alias("lastSuccessfulMirrorTime")))).alias("data")))
    audit = F.to_json(F.struct(
        F.when(k % 4 == 0, F.lit("DB_UPSTREAMADD")).when(k % 4 == 1, F.lit("DB_UPSTREAMREMOVE"))
        .otherwise(F.lit("DB_GET")).alias("operation"),
        F.when(F.col("user_id") % 2 == 0, F.lit(sites.hq_replicated_stream))
        .otherwise(F.lit(sites.hq_stream)).alias("upstreamPath")))
    err_desc = F.when(k % 2 == 0, F.lit(sites.edge_replicated_stream + NOT_A_VALID_STREAM)) \
        .otherwise(F.lit("replica " + sites.edge_replicated_stream + " unreachable"))
    replica = F.to_json(F.struct(
        F.when(k % 7 == 0, F.lit("ERROR")).otherwise(F.lit("OK")).alias("status"),
        F.when(k % 7 == 0, F.array(F.struct(err_desc.alias("desc"))))
        .otherwise(F.array().cast("array<struct<desc:string>>")).alias("errors"),
        F.array(F.struct(F.lit("REPLICA_STATE_REPLICATING").alias("replicaState"),
                         (k % 5 == 0).alias("paused"), (k % 2 == 0).alias("isUptodate"))).alias("data")))
    ak, uk = F.col("assetID"), F.col("user_id").cast("string")

    def one(topic: str, key: Column, value: Column) -> Column:
        return F.struct(F.lit(topic).alias("topic"), key.alias("key"), value.alias("value"))

    by_type = {
        "signup": [(TOPIC_IMAGEFEED, ak, feed)],
        "view": [(TOPIC_IMAGE_DOWNLOAD, ak, download), (TOPIC_VOLUME_INFO, uk, volume)],
        "purchase": [(TOPIC_ASSET_BROADCAST, ak, asset_body(F.lit(STATUS_SUCCESS)))],
        "click": [(TOPIC_ASSET_REQUEST, ak, asset_body(F.lit(STATUS_REQUESTING)))],
        "error": [(TOPIC_AUDIT, uk, audit), (TOPIC_REPLICA_INFO, uk, replica)],
    }
    msgs = None
    for etype, outs in by_type.items():
        outs = [o for o in outs if topics is None or o[0] in topics]
        if not outs:
            continue
        arr = F.array(*[one(*o) for o in outs])
        cond = F.col("event_type") == etype
        msgs = F.when(cond, arr) if msgs is None else msgs.when(cond, arr)
    rows = e.select("seq", "ts", "origin", "k", F.explode(msgs).alias("m"))
    value = F.when(F.col("k") == 99, F.expr("substring(m.value, 1, length(m.value) - 1)")) \
        .otherwise(F.col("m.value"))
    return rows.select("seq", "ts", "origin", F.col("m.topic").alias("topic"),
                       F.col("m.key").alias("key"), value.alias("value"))


def document_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a whole-document write for its asset (``extra`` = the props)."""
    e = event_rows(spark, d)
    data = F.when(F.col("title").isNotNull(), F.array(F.struct(
        F.col("title"), F.col("url").alias("description"),
        F.col("asset_no").cast("string").alias("item_id"))))
    links = F.when(F.col("url").isNotNull(), F.array(F.struct(F.col("url").alias("href"))))
    return e.select(F.col("assetID").alias("_id"), data.alias("data"), links.alias("links"),
                    F.lit(None).cast("string").alias("imageDownloadLocation"),
                    F.col("props").alias("extra"), "seq", F.lit(0).alias("rev"))


def actions(spark: SparkSession, d: str, event_type: str) -> DataFrame:
    """An action log ``(seq, ts, assetID)`` from one event type."""
    return event_rows(spark, d, [event_type], with_pages=False).select("seq", "ts", "assetID")


def clicks(spark: SparkSession, d: str) -> DataFrame:
    """Row clicks on the edge asset table."""
    return actions(spark, d, "click")


def request_publications(spark: SparkSession, d: str) -> DataFrame:
    """ASSET_REQUEST publications by the edge's request service."""
    return actions(spark, d, "view")


def store_results(spark: SparkSession, d: str) -> DataFrame:
    """Copy-job outcome per IMAGEFEED message: ``ok`` is false when ``k < 10``."""
    return event_rows(spark, d, ["signup"], with_pages=False).select("seq", (F.col("k") >= 10).alias("ok"))


def listing(spark: SparkSession, d: str, which: str, sites: Sites = DEFAULT_SITES) -> DataFrame:
    """Volume listing ``(path, modificationTime, length)``.

    ``images`` and ``hq_files`` hold pages with ``page_id % 10 <> 0``;
    ``mirror`` holds a third of those plus some gone from the source, with a
    changed length where ``page_id % 9 = 0``.
    """
    p = page_info(spark, d)
    pid = F.col("page_id")
    if which in ("images", "hq_files"):
        root = sites.source_images if which == "images" else sites.hq_files
        rows = p.filter(pid % 10 != 0).select("assetID", "filename", F.col("html_len").alias("length"))
    elif which == "mirror":
        root = sites.edge_files
        rows = p.filter(((pid % 10 != 0) & (pid % 3 == 0)) | (pid % 20 == 0)).select(
            "assetID", "filename",
            (F.col("html_len") + F.when(pid % 9 == 0, 1).otherwise(0)).alias("length"))
    else:
        raise ValueError(which)
    return rows.select(
        F.concat(F.lit("file:"), asset_path(root, F.col("assetID"), F.col("filename"), sites.layout)).alias("path"),
        F.lit(LISTING_MTIME).cast("timestamp").alias("modificationTime"),
        F.col("length").cast("bigint").alias("length"))


STANDIN_VERSION = "7"


def _stored(spark: SparkSession, d: str, sites: Sites, name: str, write) -> str:
    """Write a stand-in once under the shared ``spark.checkpoint.dir``.

    Keyed by the input files, the site roots and this module's version, so
    every query of a session reads the same stored data, as a deployment
    would. Written to a temporary folder and renamed, so concurrent sessions
    never see a half-written table.
    """
    import hashlib
    import uuid

    from fieldlink.session import ensure_checkpoint_dir
    from fieldlink.sources import fs

    stamp = [STANDIN_VERSION, name, d, sites.hq_root, sites.edge_root, sites.source_images, sites.layout]
    for t in ("events", "pages"):
        stamp += [str(x) for x in fs.file_size_and_mtime(f"{d}/{t}.parquet")]
    key = hashlib.sha256("|".join(stamp).encode()).hexdigest()[:16]
    root = f"{ensure_checkpoint_dir(spark)}/fieldlink-standins"
    final = f"{root}/{name}_{key}"
    if not fs.exists(final):
        tmp = f"{root}/_tmp_{name}_{key}_{uuid.uuid4().hex}"
        write(tmp)
        if not fs.rename(tmp, final) and not fs.exists(final):
            raise RuntimeError(f"could not publish stand-in {final}")
    return final


def stored_topic_log(spark: SparkSession, d: str, sites: Sites = DEFAULT_SITES) -> str:
    """The stand-in topic log, stored once as an archive partitioned by topic and day."""
    from fieldlink.sources.topics import write_topic_log

    return _stored(spark, d, sites, "topic_log", lambda path: write_topic_log(topic_log(spark, d, sites), path))


def stored_documents(spark: SparkSession, d: str, sites: Sites = DEFAULT_SITES) -> str:
    """The stand-in documents, stored once as a document changelog (one version each)."""
    from fieldlink.sources.documents import upsert

    def write(path: str) -> None:
        upsert(path, documents(spark, d, sites).withColumn("seq", F.lit(0).cast("bigint"))
               .withColumn("rev", F.lit(0)), producer="standin")

    return _stored(spark, d, sites, "documents", write)


def stored_listing(spark: SparkSession, d: str, which: str, sites: Sites = DEFAULT_SITES) -> DataFrame:
    """A stand-in volume listing, stored once like the other stand-ins."""
    from fieldlink.schemas import LISTING

    path = _stored(spark, d, sites, f"listing_{which}",
                   lambda p: listing(spark, d, which, sites).write.parquet(p))
    return spark.read.schema(LISTING).parquet(path)


ACTION_KINDS = {"click": "click", "publication": "view", "store": "signup"}


def stored_actions(spark: SparkSession, d: str, kind: str, sites: Sites = DEFAULT_SITES) -> DataFrame:
    """Click, publication and copy-result logs, stored once (partitioned by kind).

    ``kind``: ``click`` -> ``(seq, ts, assetID)`` row clicks; ``publication``
    -> request publications; ``store`` -> ``(seq, ok)`` copy outcomes.
    """
    def write(path: str) -> None:
        e = event_rows(spark, d, list(ACTION_KINDS.values()), with_pages=False)
        kinds = F.create_map(*[x for k, v in ACTION_KINDS.items() for x in (F.lit(v), F.lit(k))])
        (e.select("seq", "ts", "assetID", (F.col("k") >= 10).alias("ok"),
                  kinds[F.col("event_type")].alias("kind"))
         .write.partitionBy("kind").parquet(path))

    path = _stored(spark, d, sites, "actions", write)
    rows = spark.read.option("basePath", path).parquet(f"{path}/kind={kind}")
    if kind == "store":
        return rows.select("seq", "ok")
    return rows.select("seq", "ts", "assetID")


def stored_feed_files(spark: SparkSession, d: str, sites: Sites = DEFAULT_SITES) -> str:
    """The stand-in feed written as JSON feed files (one ``collection`` per file),
    to be read back by :func:`fieldlink.sources.feed.read_feed_files`."""
    return _stored(spark, d, sites, "feed_files",
                   lambda p: feed_files(spark, d).write.option("maxRecordsPerFile", 1).json(p))


def stored_document_changes(spark: SparkSession, d: str, sites: Sites = DEFAULT_SITES) -> DataFrame:
    """The stand-in document change log, stored once."""
    from fieldlink.schemas import DOCUMENT_CHANGE

    path = _stored(spark, d, sites, "document_changes",
                   lambda p: document_changes(spark, d).write.parquet(p))
    return spark.read.schema(DOCUMENT_CHANGE).parquet(path)


def stored_volumes(spark: SparkSession, d: str, sites: Sites = DEFAULT_SITES) -> str:
    """Real files written from ``pages``; a volume's path on disk is the returned folder plus its path in ``sites``."""
    from fieldlink.sources.volumes import store_files

    def write(path: str) -> None:
        p = page_info(spark, d).join(table(spark, d, "pages").select("page_id", "html"), "page_id").filter("filename <> ''")
        pid, present = F.col("page_id"), F.col("page_id") % 10 != 0
        # Each volume's root, the pages in it and what its files hold.
        held = [(sites.source_images, present, F.col("html")), (sites.download_dir, present, F.col("html")),
                (sites.hq_files, present, F.col("html")),
                (sites.edge_files, (present & (pid % 3 == 0)) | (pid % 20 == 0),
                 F.when(pid % 9 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")))]
        files = p.select(F.explode(F.array(*[F.when(where, F.struct(
            F.concat(F.lit(path), asset_path(root, F.col("assetID"), F.col("filename"), sites.layout)).alias("path"),
            content.alias("content"))) for root, where, content in held])).alias("f")).filter("f IS NOT NULL").select("f.*")
        failed = store_files(files).filter("NOT ok")
        if not failed.isEmpty():
            raise RuntimeError(f"stand-in files could not be written: {failed.first()}")

    return _stored(spark, d, sites, "volumes", write)


BLOCKED = 13


def blocked_run(spark: SparkSession, d: str, root: str, sites: Sites = DEFAULT_SITES) -> str:
    """A new folder for one run's copies, where files take the place of some assets' folders below ``root``."""
    import uuid

    from fieldlink.session import ensure_checkpoint_dir
    from fieldlink.sources.volumes import store_files

    run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fieldlink-runs/{uuid.uuid4().hex}"
    taken = page_info(spark, d).filter(F.col("page_id") % BLOCKED == 0).select(
        F.concat(F.lit(run), F.regexp_replace(asset_path(root, F.col("assetID"), F.lit(""), sites.layout), "/+$", "")).alias("path"),
        F.lit(b"taken").alias("content"))
    store_files(taken).write.parquet(f"{run}/_taken")
    return run
