"""The nine services as Structured Streaming queries.

Each topic has its own folder and a single producer. Pure map stages
(broadcast, replication) write through the parquet file sink, which is
exactly-once with its commit log. Stages that must see fresh document state,
run copies, or keep the "document before message" order run in
``foreachBatch``: every write there replaces ``batch=<id>/`` so a retried
micro-batch leaves the same files. The two kinds never share a folder.

``trigger`` defaults to ``availableNow`` (drain what is there, then stop);
:func:`start_hq` and :func:`start_edge` use the services' periods (2 s at HQ,
3 s at the edge). Checkpoints live under ``<checkpoint root>/<service>``; the
root defaults to a folder below the site's own base, so positions live as long
as the site's data. A service that ran before refuses to start without them.

``seq`` is one logical clock per deployment: new feed items get
``batch_id << 32 | position`` (position in the micro-batch by file and item), derived
messages keep the seq of the message that caused them, and the edge stamps
clicks and publications from the same clock, so that "click after broadcast"
and "published after click" can be compared across topics.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlink.config import (
    DEFAULT_SITES,
    EDGE,
    HQ,
    SERVICES,
    STATUS_FAILED,
    TOPIC_ASSET_BROADCAST,
    TOPIC_ASSET_REQUEST,
    TOPIC_IMAGE_DOWNLOAD,
    TOPIC_IMAGEFEED,
    TOPIC_TTL_SECONDS,
    Sites,
)
from fieldlink.operators import edge, hq
from fieldlink.schemas import ASSET_ACTION, ASSET_MSG, IMAGEFEED_MSG, STORE_RESULT, TOPIC_LOG
from fieldlink.session import ensure_checkpoint_dir
from fieldlink.sources import documents as docs
from fieldlink.sources import feed as feedsrc
from fieldlink.sources import fs, topics, volumes
from fieldlink.streaming import counters, retention

ASSET_FIELDS = ["title", "description", "filename", "assetID", "status"]
FEED_FIELDS = ["title", "description", "tablename", "assetID", "messageCreatorID"]
_SEQ_SHIFT = 32  # seq of a new feed item = batch_id << 32 | its 1-based position in the batch


@dataclass(frozen=True)
class Layout:
    """Where one site keeps its pipeline tables (all shared storage)."""

    base: str
    sites: Sites = field(default_factory=lambda: DEFAULT_SITES)
    checkpoint_root: str | None = None

    @property
    def topics(self) -> str:
        return f"{self.base}/topics"

    @property
    def replica(self) -> str:
        return f"{self.base}/replica"

    @property
    def documents(self) -> str:
        return f"{self.base}/documents"

    @property
    def deadletter(self) -> str:
        return f"{self.base}/deadletter"

    @property
    def asset_state(self) -> str:
        return f"{self.base}/asset_state"

    @property
    def clicks(self) -> str:
        return f"{self.base}/clicks"

    @property
    def publications(self) -> str:
        return f"{self.base}/publications"

    @property
    def copies(self) -> str:
        return f"{self.base}/copies"

    @property
    def positions(self) -> str:
        """Folder of the positions of the site's services."""
        root = self.checkpoint_root or f"{self.base}/_positions"
        return f"{root}/{self.base.strip('/').replace('/', '_')}"

    def checkpoint(self, spark: SparkSession, name: str) -> str:
        """The service's position folder; an error if it is lost while its output is still there.

        From an empty checkpoint a service would count its batches from 0 again
        and overwrite, skip or repeat what it wrote before.
        """
        path = f"{self.positions}/{name}"
        ran = f"{self.base}/_ran/{name}"
        if fs.exists(ran) and not fs.exists(path):
            raise RuntimeError(f"{name} ran on {self.base} before, but its checkpoint {path} is gone")
        fs.mkdirs(path, ran)
        return path


def _start(df: DataFrame, name: str, layout: Layout, spark: SparkSession, batch_fn=None,
           trigger: dict | None = None, output_mode: str = "append"):
    w = df.writeStream.queryName(name).option("checkpointLocation", layout.checkpoint(spark, name))
    w = w.trigger(**(trigger or {"availableNow": True})).outputMode(output_mode)
    return w.foreachBatch(batch_fn).start()


def ensure_dirs(spark: SparkSession, *paths: str) -> None:
    """Create folders on the shared store (``spark`` kept for call symmetry)."""
    fs.mkdirs(*paths)


#: What each site's services read, and how; undecodable rows of these topics are dead letters.
def _consumed(site: str) -> dict[str, T.StructType]:
    from fieldlink.config import TOPIC_AUDIT, TOPIC_REPLICA_INFO, TOPIC_VOLUME_INFO
    from fieldlink.schemas import AUDIT_MSG, REPLICA_INFO_MSG, VOLUME_INFO_MSG

    if site == HQ:
        return {TOPIC_IMAGEFEED: IMAGEFEED_MSG, TOPIC_IMAGE_DOWNLOAD: ASSET_MSG, TOPIC_ASSET_REQUEST: ASSET_MSG}
    return {TOPIC_ASSET_BROADCAST: ASSET_MSG, TOPIC_AUDIT: AUDIT_MSG, TOPIC_REPLICA_INFO: REPLICA_INFO_MSG,
            TOPIC_VOLUME_INFO: VOLUME_INFO_MSG}


def start_deadletter_service(spark: SparkSession, layout: Layout, site: str, trigger: dict | None = None,
                             replicated: str | None = None) -> dict:
    """Streaming queries that keep what the services can't use, one per topic the site consumes.

    ``<deadletter>/messages/<topic>`` gets ``seq, topic, origin, raw, reason``:
    rows whose JSON does not decode (``malformed``) and, of IMAGE_DOWNLOAD,
    records without a status (``no_status``). ``replicated`` is the folder of
    the topic that comes from the other site. Exactly-once through the file
    sink; with the services' own outputs every row in is a row out or a dead
    letter.
    """
    queries = {}
    for topic, schema in _consumed(site).items():
        foreign = topic == (TOPIC_ASSET_REQUEST if site == HQ else TOPIC_ASSET_BROADCAST)
        base = replicated if foreign and replicated else layout.topics
        name = f"deadletter_{topic.lower()}"
        src = _topic_stream(spark, layout, name, base, topic)
        bad = topics.unusable(src, topic, schema, needs="status" if topic == TOPIC_IMAGE_DOWNLOAD else None)
        queries[name] = (bad.writeStream.format("parquet").queryName(name).outputMode("append")
                         .option("checkpointLocation", layout.checkpoint(spark, name))
                         .trigger(**(trigger or {"availableNow": True}))
                         .start(f"{layout.deadletter}/messages/{topic}"))
    return queries


def _publish(rows: DataFrame, layout: Layout, topic: str, batch_id: int, service: str) -> None:
    """Write a batch's messages, once, and record how many the service emitted."""
    out, emitted = counters.observed(rows, service)
    if not topics.write_topic(out, layout.topics, topic, batch_id):  # an earlier attempt did
        emitted = rows.sparkSession.read.schema(TOPIC_LOG).parquet(f"{layout.topics}/{topic}/batch={batch_id}").count()
    counters.record(layout.base, service, batch_id, emitted)


def _topic_stream(spark: SparkSession, layout: Layout, name: str, base: str, topic: str) -> DataFrame:
    """Stream of a topic's folder; the query ``name`` is noted as its consumer, for retention."""
    ensure_dirs(spark, f"{base}/{topic}")
    retention.note_consumer(layout.base, name, layout.checkpoint(spark, name), [f"{base}/{topic}"])
    return topics.read_topic(spark, base, topic, streaming=True)


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


# --- HQ ------------------------------------------------------------------------

def feed_batch(spark: SparkSession, layout: Layout, files: DataFrame, batch_id: int) -> None:
    """One micro-batch of the feed service (idempotent: a retry rewrites the same folders)."""
    from fieldlink.plans.ordering import with_position

    files = files.persist()
    _write_batch(feedsrc.bad_feed_files(files), f"{layout.deadletter}/feed_files", batch_id)
    # Consecutive, retry-stable numbering: items ordered by (file, position in file).
    df = with_position(hq.normalize_feed(feedsrc.explode_items(files)), [F.col("file"), F.col("item_pos")])
    df = (df.withColumn("seq", F.lit(batch_id).cast("bigint") * F.lit(1 << _SEQ_SHIFT) + F.col("pos"))
          .withColumn("ts", F.current_timestamp().cast("timestamp_ntz"))
          .persist())
    valid = df.filter(F.col("reason").isNull())
    # An item that comes again unchanged keeps the location its file is already stored at.
    # Checkpointed, as a retry overwrites this batch's own folder of the changelog.
    ensure_checkpoint_dir(spark)
    earlier = docs.read_versions(spark, layout.documents, valid).filter(F.col("seq") < F.lit(batch_id << _SEQ_SHIFT))
    stored = docs.current(earlier).select(
        F.col("_id").alias("assetID"), F.col("data").alias("_data"), F.col("links").alias("_links"),
        F.col("imageDownloadLocation").alias("_location")).checkpoint(eager=True)
    same = F.col("item.data").eqNullSafe(F.col("_data")) & F.col("item.links").eqNullSafe(F.col("_links"))
    changes = valid.join(stored, "assetID", "left").select(
        F.col("assetID").alias("_id"), F.col("item.data").alias("data"), F.col("item.links").alias("links"),
        F.when(same, F.col("_location")).alias("imageDownloadLocation"), F.col("raw").alias("extra"),
        "seq", F.lit(0).alias("rev"))
    # Documents first: if the upsert fails the batch fails and nothing is published.
    docs.upsert(layout.documents, changes, batch_id, producer="feed")
    msgs = hq.feed_messages(valid, layout.sites, keep=("seq", "ts"))
    _publish(topics.encode(msgs, TOPIC_IMAGEFEED, FEED_FIELDS, HQ), layout, TOPIC_IMAGEFEED, batch_id, "IMAGE Feed")
    _write_batch(df.filter(F.col("reason").isNotNull()).select(
        "seq", F.lit("feed").alias("stage"), "reason"), f"{layout.deadletter}/feed", batch_id)
    df.unpersist()
    files.unpersist()


def start_feed_service(spark: SparkSession, layout: Layout, feed_dir: str, trigger: dict | None = None):
    """IMAGE Feed: new feed files -> documents (first) -> IMAGEFEED messages."""
    src = feedsrc.read_feed_files(spark, feed_dir, streaming=True)
    return _start(src, "image_feed", layout, spark, lambda df, bid: feed_batch(spark, layout, df, bid), trigger)


def download_batch(spark: SparkSession, layout: Layout, df: DataFrame, batch_id: int) -> None:
    """One micro-batch of the download service (idempotent: a retry rewrites the same folders)."""
    s = layout.sites
    msgs = topics.consume(df, TOPIC_IMAGEFEED, IMAGEFEED_MSG).persist()
    # Re-read per batch (fresh state), only the ids this batch needs.
    current = docs.read_current(spark, layout.documents, ids=msgs).persist()
    # Presence of just this batch's source files (not a listing of the whole volume).
    wanted = hq.plan_downloads(msgs, current, spark.createDataFrame([], volumes.LISTING_SCHEMA), s)
    present = volumes.stat_files(wanted.filter(F.col("outcome") != "not_found"), "src")
    planned = hq.plan_downloads(msgs, current, present, s).persist()
    manifest = hq.store_manifest(planned)
    copied = volumes.copy_files(manifest.select("src", "dst"))
    results = manifest.join(copied.select("src", "dst", "ok"), ["src", "dst"], "left") \
        .select("seq", F.coalesce(F.col("ok"), F.lit(False)).alias("ok"))
    _write_batch(results, layout.copies + "/download", batch_id)
    stored = _read_batches(spark, f"{layout.copies}/download/batch={batch_id}", STORE_RESULT)
    outcomes = hq.resolve_downloads(planned, stored).persist()
    docs.upsert(layout.documents, hq.download_document_updates(outcomes, current), batch_id,
                producer="download")
    # A failed copy publishes nothing: there is no file to announce. Its dead letter says why.
    pub = hq.download_published(outcomes.filter(F.col("outcome") != STATUS_FAILED))
    _publish(topics.encode(pub, TOPIC_IMAGE_DOWNLOAD, ASSET_FIELDS, HQ), layout, TOPIC_IMAGE_DOWNLOAD, batch_id, "Image Download")
    unstored = outcomes.filter(F.col("outcome") == STATUS_FAILED).select(
        "seq", "assetID", F.lit("store_failed").alias("reason"))
    _write_batch(hq.download_deadletter(outcomes).unionByName(unstored), f"{layout.deadletter}/download", batch_id)
    outcomes.unpersist()
    planned.unpersist()
    current.unpersist()
    msgs.unpersist()


def start_download_service(spark: SparkSession, layout: Layout, trigger: dict | None = None):
    """Image Download: IMAGEFEED -> lookup, copy, document update -> IMAGE_DOWNLOAD."""
    s = layout.sites
    ensure_dirs(spark, s.source_images)
    src = _topic_stream(spark, layout, "image_download", layout.topics, TOPIC_IMAGEFEED)
    return _start(src, "image_download", layout, spark, lambda d, bid: download_batch(spark, layout, d, bid), trigger)


def start_broadcast_service(spark: SparkSession, layout: Layout, trigger: dict | None = None):
    """Asset Broadcast: IMAGE_DOWNLOAD minus failed -> ASSET_BROADCAST (file sink, exactly-once)."""
    src = _topic_stream(spark, layout, "asset_broadcast", layout.topics, TOPIC_IMAGE_DOWNLOAD)
    out = hq.asset_broadcast(topics.consume(src, TOPIC_IMAGE_DOWNLOAD, ASSET_MSG))
    rows = topics.encode(out, TOPIC_ASSET_BROADCAST, ASSET_FIELDS, HQ)
    return topics.write_topic_stream(rows, layout.topics, TOPIC_ASSET_BROADCAST,
                                     layout.checkpoint(spark, "asset_broadcast"), trigger, "asset_broadcast")


def start_response_service(spark: SparkSession, layout: Layout, trigger: dict | None = None,
                           request_topics: str | None = None):
    """Asset Response: ASSET_REQUEST -> lookup -> copy into the mission volume."""
    src = _topic_stream(spark, layout, "asset_response", request_topics or layout.topics, TOPIC_ASSET_REQUEST)
    s = layout.sites

    def batch(df: DataFrame, batch_id: int) -> None:
        msgs = topics.consume(df, TOPIC_ASSET_REQUEST, ASSET_MSG)
        current = docs.read_current(spark, layout.documents, ids=msgs)
        responses = hq.asset_response(msgs, current, s).persist()
        manifest = hq.response_copies(responses)
        copied = volumes.copy_files(manifest.select("src", "dst"))
        results = manifest.join(copied.select("src", "dst", "ok", "error"), ["src", "dst"], "left")
        _write_batch(results, f"{layout.copies}/response", batch_id)
        # The copies' outcomes as written: reading them does not copy again.
        stored = _read_batches(spark, f"{layout.copies}/response/batch={batch_id}", results.schema)
        stored = stored.select("src", "dst", F.coalesce("ok", F.lit(False)).alias("stored"))
        settled = responses.join(stored, ["src", "dst"], "left").withColumn("reason", F.when(
            F.col("reason").isNull() & ~F.coalesce("stored", F.lit(False)), F.lit("store_failed")).otherwise(F.col("reason")))
        settled = settled.persist()
        _write_batch(hq.response_deadletter(settled), f"{layout.deadletter}/response", batch_id)
        out, emitted = counters.observed(settled.filter(F.col("reason").isNull())
                                         .select("seq", "ts", "assetID", "msg_title", "reason"), "Asset Response")
        _write_batch(out, f"{layout.base}/responses", batch_id)
        counters.record(layout.base, "Asset Response", batch_id, emitted)
        settled.unpersist()
        responses.unpersist()

    return _start(src, "asset_response", layout, spark, batch, trigger)


# --- EDGE ----------------------------------------------------------------------

def start_lifecycle_service(spark: SparkSession, layout: Layout, broadcast_topics: str,
                            trigger: dict | None = None):
    """Broadcast Listener + asset state, kept in an explicit state table.

    Each micro-batch folds its broadcast, click and publication events per
    asset (partial aggregation first), reads the earlier state of only the
    touched assets (semi join), merges the two with the same ``min``/``max``,
    and writes the merged rows as ``batch=<id>``. Readers take the newest row
    per asset (:func:`current_asset_state`). No state is held inside Spark's
    streaming state store, so :func:`compact_state` can also drop long-idle
    assets (``keep``). A retried batch reads only earlier batches.
    """
    ensure_dirs(spark, layout.clicks, layout.publications, layout.asset_state)
    b = topics.consume(_topic_stream(spark, layout, "asset_lifecycle", broadcast_topics, TOPIC_ASSET_BROADCAST),
                       TOPIC_ASSET_BROADCAST, ASSET_MSG)
    c = spark.readStream.schema(ASSET_ACTION).option("recursiveFileLookup", "true").parquet(layout.clicks)
    p = spark.readStream.schema(ASSET_ACTION).option("recursiveFileLookup", "true").parquet(layout.publications)
    events = edge.lifecycle_events(b, c, p)

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        counters.record(layout.base, "Broadcast Listener", batch_id, df.filter("kind = 'b'").count())
        delta = edge.lifecycle_fold(df).persist()
        state_schema = T.StructType(delta.schema.fields + [T.StructField("batch", T.LongType(), True)])
        earlier = read_state(spark, layout.asset_state, state_schema).filter(F.col("batch") < batch_id)
        # Only the touched assets' history is aggregated (semi join first).
        touched = earlier.join(delta.select("assetID"), "assetID", "left_semi")
        before = _latest_by_batch(touched, "assetID").drop("batch")
        merged = edge.lifecycle_merge(before.unionByName(delta))
        _write_batch(merged.withColumn("batch", F.lit(batch_id).cast("bigint")), layout.asset_state, batch_id)
        delta.unpersist()
        df.unpersist()

    return _start(events, "asset_lifecycle", layout, spark, batch, trigger)


def _latest_by_batch(rows: DataFrame, key: str) -> DataFrame:
    latest = F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col("batch"))
    return rows.groupBy(key).agg(latest.alias("_s")).select(key, "_s.*")


def current_asset_state(spark: SparkSession, layout: Layout) -> DataFrame:
    """Newest aggregate row per asset (the update-mode output of every batch so far)."""
    rows = read_state(spark, layout.asset_state)
    return _latest_by_batch(rows, "assetID").drop("batch")


def _state_folders(path: str) -> tuple[int, list[int], list[int]]:
    """Newest complete fold (-1: none), batch ids, fold ids."""
    names = [name for name, is_dir in fs.list_dir(path) if is_dir]
    batches, folds = (sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{kind}=")) for kind in ("batch", "fold"))
    done = max((n for n in folds if fs.exists(f"{path}/fold={n}/_SUCCESS")), default=-1)
    return done, batches, folds


def read_state(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Rows of an update-mode output: the newest complete fold and the batches after it."""
    done, batches, _ = _state_folders(path)
    folders = [f"{path}/fold={done}"] * (done >= 0) + [f"{path}/batch={n}" for n in batches if n > done]
    reader = spark.read.option("recursiveFileLookup", "true")
    return (reader.schema(schema) if schema is not None else reader).parquet(*(folders or [path]))


def compact_state(spark: SparkSession, path: str, key: str, keep=None) -> None:
    """Fold the older ``batch=<id>/`` folders of an update-mode output into ``fold=<id>/``.

    Readers (:func:`read_state`) take the newest complete fold and the batches
    after it, so they switch when the fold's ``_SUCCESS`` appears. Nothing is
    renamed, and folded folders are deleted only by the next call: a failure at
    any step leaves every row readable, and a reader that listed the older
    files can still finish. The newest batch folder is left alone;
    it may be in progress or be retried. ``keep`` (a Column over the state's
    columns) drops rows while folding, e.g. assets idle for too long.
    """
    done, batches, folds = _state_folders(path)
    for n in batches:
        if n <= done:
            fs.delete_dir(f"{path}/batch={n}")
    for n in folds:
        if n < done:
            fs.delete_dir(f"{path}/fold={n}")
    olds = [n for n in batches if n > done][:-1]
    if not olds or len(olds) + (done >= 0) < 2:
        return
    sources = [f"{path}/batch={n}" for n in olds] + [f"{path}/fold={done}"] * (done >= 0)
    folded = _latest_by_batch(spark.read.option("recursiveFileLookup", "true").parquet(*sources), key)
    if keep is not None:
        folded = folded.filter(keep)
    folded.withColumn("batch", F.lit(olds[-1]).cast("bigint")).write.mode("overwrite").parquet(f"{path}/fold={olds[-1]}")


def asset_table(spark: SparkSession, layout: Layout) -> DataFrame:
    """Asset Viewer's view: every broadcast asset with its status, against the live mirror listing."""
    ensure_dirs(spark, layout.sites.edge_files, layout.asset_state)
    state = current_asset_state(spark, layout)
    # Only assets whose status hinges on the file (published since the last
    # click) need a presence check; those paths are checked, not the volume.
    unchecked = edge.lifecycle_status(state, spark.createDataFrame([], volumes.LISTING_SCHEMA), layout.sites)
    present = volumes.stat_files(unchecked.filter(F.col("status") == "requested"), "path")
    return edge.lifecycle_status(state, present, layout.sites)


def record_clicks(spark: SparkSession, layout: Layout, clicks: DataFrame, batch_id: int) -> None:
    """Row clicks from the edge UI, appended idempotently."""
    _write_batch(clicks.select(*[F.col(f.name).cast(f.dataType) for f in ASSET_ACTION.fields]),
                 layout.clicks, batch_id)


def publish_requests(spark: SparkSession, layout: Layout, batch_id: int) -> DataFrame:
    """Asset Request: publish every ``requesting...`` asset once per click.

    The asset state lags behind what was published, so clicks whose
    publication is already logged are left out. What to publish is written
    first; a retry of the batch publishes just that, whatever was logged
    meanwhile. Then come the ASSET_REQUEST messages and the publication log
    (which turns the assets into ``requested``). Returns what was published.
    """
    plans = f"{layout.base}/request_plans"
    if not fs.exists(f"{plans}/batch={batch_id}/_SUCCESS"):
        pending = edge.request_publish(asset_table(spark, layout), extra=("description", "filename", "c_seq"))
        ensure_dirs(spark, layout.publications)
        logged = _read_batches(spark, layout.publications, ASSET_ACTION).select("assetID", F.col("seq").alias("c_seq"))
        pending = pending.join(logged.distinct(), ["assetID", "c_seq"], "left_anti")
        _write_batch(pending.select(
            "assetID", "title", "description", "filename", "status", F.col("c_seq").alias("seq"),
            F.current_timestamp().cast("timestamp_ntz").alias("ts")), plans, batch_id)
    rows = _read_batches(spark, f"{plans}/batch={batch_id}", REQUEST_PLAN)
    _publish(topics.encode(rows, TOPIC_ASSET_REQUEST, ASSET_FIELDS, EDGE), layout, TOPIC_ASSET_REQUEST, batch_id, "Asset Request")
    _write_batch(rows.select("seq", "ts", "assetID"), layout.publications, batch_id)
    return rows


REQUEST_PLAN = "assetID string, title string, description string, filename string, status string, seq long, ts timestamp_ntz"


def start_request_service(spark: SparkSession, layout: Layout, trigger: dict | None = None):
    """Asset Request: publishes what waits whenever the asset state has new rows.

    The stream of new state rows only says when to look. A folded folder that
    is gone before it was read is no loss, since its rows are in the fold.
    """
    ensure_dirs(spark, layout.asset_state)
    src = (spark.readStream.schema("assetID string").option("recursiveFileLookup", "true")
           .option("ignoreMissingFiles", "true").parquet(layout.asset_state))
    return _start(src, "asset_request", layout, spark,
                  lambda df, batch_id: publish_requests(spark, layout, batch_id), trigger)


RECEIVED = "assetID string, seq long, title string, description string, path string, ts timestamp_ntz"


def view_received(spark: SparkSession, layout: Layout, batch_id: int | None = None) -> DataFrame:
    """Asset Viewer: requested assets whose file has arrived since the last look, each once per publication.

    Only publications not seen as received before are checked for their file.
    What a batch finds is written first and stays, so a retry finds the same.
    Without ``batch_id`` the next free one is taken. Returns the batch's rows.
    """
    path = f"{layout.base}/received"
    ensure_dirs(spark, path, layout.asset_state)
    if batch_id is None:
        batch_id = 1 + max((int(n.split("=")[1]) for n, is_dir in fs.list_dir(path) if is_dir and n.startswith("batch=")), default=-1)
    if not fs.exists(f"{path}/batch={batch_id}/_SUCCESS"):
        before = _read_batches(spark, path, RECEIVED).select("assetID", F.col("seq").alias("p_seq")).distinct()
        nothing = spark.createDataFrame([], volumes.LISTING_SCHEMA)
        waiting = edge.lifecycle_status(current_asset_state(spark, layout), nothing, layout.sites).filter(F.col("status") == "requested")
        waiting = waiting.join(before, ["assetID", "p_seq"], "left_anti").persist()
        there = volumes.file_present(waiting.drop("present"), volumes.stat_files(waiting, "path"), "path", "present")
        _write_batch(there.filter("present").select("assetID", F.col("p_seq").alias("seq"), "title", "description", "path", F.col("p_ts").alias("ts")),
                     path, batch_id)
        waiting.unpersist()
    rows = spark.read.schema(RECEIVED).parquet(f"{path}/batch={batch_id}")
    counters.record(layout.base, "Asset Viewer", batch_id, rows.count())
    return rows


def start_viewer_service(spark: SparkSession, layout: Layout, trigger: dict | None = None):
    """Asset Viewer on its period: looks for arrived files whether or not there are new messages."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", "1").load()
    return _start(clock, "asset_viewer", layout, spark, lambda df, batch_id: view_received(spark, layout, batch_id),
                  trigger or EDGE_PERIOD)


# --- replication ----------------------------------------------------------------

def start_replication(spark: SparkSession, src: Layout, dst: Layout, topic: str, origin: str,
                      trigger: dict | None = None):
    """Forward ``topic`` rows that ``origin`` produced from ``src`` to ``dst``'s replica folder.

    Only the source site's own rows travel, so nothing loops back; one query
    per direction gives multi-master replication. Pausing is ``stop()``;
    resuming restarts from the checkpoint.
    """
    name = f"replicate_{origin}_{topic}".lower()
    rows = _topic_stream(spark, src, name, src.topics, topic).filter(F.col("origin") == origin)
    return topics.write_topic_stream(rows, dst.replica, topic, src.checkpoint(spark, name), trigger, name)


def site_topic_stream(spark: SparkSession, layout: Layout, topic: str, delay: str = "1 hour") -> DataFrame:
    """Streaming view of a replicated topic at one site, deduplicated within ``delay``."""
    ensure_dirs(spark, f"{layout.topics}/{topic}", f"{layout.replica}/{topic}")
    own = topics.read_topic(spark, layout.topics, topic, streaming=True)
    rep = topics.read_topic(spark, layout.replica, topic, streaming=True)
    return topics.dedupe_stream(own.unionByName(rep), delay)


def start_counters_service(spark: SparkSession, layout: Layout, sources: dict[str, str],
                           trigger: dict | None = None, folders: dict[str, str] | None = None,
                           name: str = "service_counters"):
    """Running counts of rows that services wrote through the file sink.

    ``sources`` maps a service name to the topic folder it emits, ``folders``
    to another folder of its output. Each micro-batch counts its rows and adds
    them to the totals of earlier batches; :func:`current_counters` reads the
    newest. A few totals need no state store with a partition for every
    shuffle task.
    """
    parts, path = None, f"{layout.base}/counters"
    ensure_dirs(spark, path)
    outputs = {service: f"{layout.topics}/{topic}" for service, topic in sources.items()} | (folders or {})
    for service, folder in outputs.items():
        ensure_dirs(spark, folder)
        s = (spark.readStream.schema("seq long").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
             .parquet(folder).select(F.lit(service).alias("service")))
        parts = s if parts is None else parts.unionByName(s)
    retention.note_consumer(layout.base, name, layout.checkpoint(spark, name), list(outputs.values()))

    def batch(df: DataFrame, batch_id: int) -> None:
        new = df.groupBy("service").agg(F.count(F.lit(1)).alias("n"))
        earlier = read_state(spark, path, "service string, n long, batch long").filter(F.col("batch") < batch_id)
        before = _latest_by_batch(earlier, "service").select("service", "n")
        total = before.unionByName(new).groupBy("service").agg(F.sum("n").alias("n"))
        _write_batch(total.withColumn("batch", F.lit(batch_id).cast("bigint")), path, batch_id)

    return _start(parts, name, layout, spark, batch, trigger)


def current_counters(spark: SparkSession, layout: Layout) -> DataFrame:
    """Newest count per service of those that :func:`start_counters_service` counts."""
    rows = read_state(spark, f"{layout.base}/counters", "service string, n long, batch long")
    return _latest_by_batch(rows, "service").select("service", "n")


def start_site_counters(spark: SparkSession, layout: Layout, site: str, trigger: dict | None = None):
    """Counts of the site's service that writes through the file sink; the others count in their batches."""
    if site == HQ:
        return start_counters_service(spark, layout, {"Asset Broadcast": TOPIC_ASSET_BROADCAST}, trigger, name="sink_counters")
    return start_counters_service(spark, layout, {}, trigger, {"Audit Listener": f"{layout.base}/audit"}, "sink_counters")


def site_counters(spark: SparkSession, layout: Layout, site: str) -> dict[str, int]:
    """Rows that each of a site's services has emitted; 0 for those with none, and for Upstream Comm, which only reports."""
    ensure_dirs(spark, f"{layout.base}/counters")
    sinks = {r["service"]: r["n"] for r in current_counters(spark, layout).collect()}
    return {name: sinks[name] if name in sinks else counters.total(layout.base, name) for at, name in SERVICES if at == site}


#: State folders below a site's base, with the key of which they keep the newest row.
STATE_KEYS = {"asset_state": "assetID", "replica_last": "replica", "mirror_lag": "replica", "counters": "service"}


def maintain(spark: SparkSession, layout: Layout, topic_ttl_s: int = TOPIC_TTL_SECONDS) -> None:
    """Fold a site's state folders (:func:`compact_state`) and its documents, and delete expired topic files.

    Safe beside the running services.
    """
    for name, key in STATE_KEYS.items():
        if fs.exists(f"{layout.base}/{name}"):
            compact_state(spark, f"{layout.base}/{name}", key)
    for _, service in SERVICES:
        counters.fold(layout.base, service)
    retention.expire_topics(spark, layout, topic_ttl_s)
    if fs.exists(layout.documents):
        # A retried feed batch asks for the documents as they were before it.
        fed = [int(n.split("=")[1]) for n, is_dir in fs.list_dir(f"{layout.documents}/feed") if is_dir and n.startswith("batch=")]
        docs.fold(spark, layout.documents, max(fed) << _SEQ_SHIFT if fed else None)


def sweep(spark: SparkSession, layout: Layout) -> int:
    """Delete what dead copies left in the site's volumes; the number of files. Lists the volumes."""
    s = layout.sites
    gone = [volumes.sweep_parts(spark, root) for root in (s.download_dir, s.hq_files, s.edge_files)]
    return sum(g.filter("ok").count() for g in gone)


def _pause_mark(layout: Layout) -> str:
    return f"{layout.base}/_paused/replication"


def pause_replication(layout: Layout) -> None:
    """Ask the site's runner to stop forwarding; it goes on from its position after ``resume_replication``."""
    fs.mkdirs(_pause_mark(layout))


def resume_replication(layout: Layout) -> None:
    fs.delete_dir(_pause_mark(layout))


def replication_paused(layout: Layout) -> bool:
    return fs.exists(_pause_mark(layout))


def site_topic(spark: SparkSession, layout: Layout, topic: str) -> DataFrame:
    """A site's view of a replicated topic: own rows plus replicated ones, duplicates removed."""
    ensure_dirs(spark, f"{layout.topics}/{topic}", f"{layout.replica}/{topic}")
    own = topics.read_topic(spark, layout.topics, topic)
    rep = topics.read_topic(spark, layout.replica, topic)
    return own.unionByName(rep).dropDuplicates(["origin", "topic", "seq"])


def documents_now(spark: SparkSession, layout: Layout) -> DataFrame:
    return docs.read_current(spark, layout.documents)


def start_replica_monitor(spark: SparkSession, layout: Layout, trigger: dict | None = None):
    """Upstream Comm (E3 streaming): replica state changes across micro-batches.

    Each micro-batch is seeded with the last known (seq, state) of every
    replica from earlier batches, then runs the same skew-safe
    :func:`~fieldlink.plans.ordering.with_previous` as the batch query: a hot
    replica is spread over range partitions instead of one task (a first run
    can hold the whole backlog in one micro-batch). Rows not newer than the
    replica's last seen seq are late and go to the dead letter. Changes go to
    ``<base>/replica_changes``, the last states to ``<base>/replica_last``;
    both are written per batch id, so a retried batch rewrites the same files
    and reads only earlier batches' state.
    """
    from fieldlink.config import TOPIC_REPLICA_INFO
    from fieldlink.operators import monitor
    from fieldlink.plans.ordering import with_previous
    from fieldlink.schemas import REPLICA_INFO_MSG

    last_path = f"{layout.base}/replica_last"
    ensure_dirs(spark, last_path)
    src = topics.consume(_topic_stream(spark, layout, "replica_monitor", layout.topics, TOPIC_REPLICA_INFO),
                         TOPIC_REPLICA_INFO, REPLICA_INFO_MSG)
    obs = monitor.replica_observations(src, layout.sites).select("replica", "seq", "state")
    last_schema = "replica string, seq long, state string, batch long"

    def batch(df: DataFrame, batch_id: int) -> None:
        earlier = (read_state(spark, last_path, last_schema)
                   .filter(F.col("batch") < batch_id)
                   .join(df.select("replica").distinct(), "replica", "left_semi"))  # only replicas in this batch
        last = _latest_by_batch(earlier, "replica").select("replica", F.col("seq").alias("_last_seq"),
                                                           F.col("state").alias("_last_state"))
        seen = df.join(last, "replica", "left")
        _write_batch(seen.filter(F.col("seq") <= F.col("_last_seq")).select(
            "replica", "seq", "state", F.lit("late").alias("reason")), f"{layout.deadletter}/replica", batch_id)
        new = (seen
               .filter(F.col("_last_seq").isNull() | (F.col("seq") > F.col("_last_seq")))
               .select("replica", "seq", "state", F.lit(False).alias("_seed")))
        seeds = last.select("replica", F.col("_last_seq").alias("seq"), F.col("_last_state").alias("state"),
                            F.lit(True).alias("_seed"))
        prev = with_previous(new.unionByName(seeds), "replica", "seq", "state", out="prev_state")
        changes = prev.filter(~F.col("_seed") & (F.col("prev_state").isNull() |
                                                  (F.col("prev_state") != F.col("state"))))
        _write_batch(changes.select("replica", "seq", "state", "prev_state"), f"{layout.base}/replica_changes",
                     batch_id)
        newest = (new.groupBy("replica").agg(F.max_by(F.struct("seq", "state"), "seq").alias("_n"))
                  .select("replica", "_n.seq", "_n.state", F.lit(batch_id).cast("bigint").alias("batch")))
        _write_batch(newest, last_path, batch_id)

    return _start(obs, "replica_monitor", layout, spark, batch, trigger)


def start_audit_listener(spark: SparkSession, layout: Layout, trigger: dict | None = None):
    """Audit Listener (C3 streaming): audit records with the "replication established" flag."""
    from fieldlink.config import TOPIC_AUDIT
    from fieldlink.operators import monitor
    from fieldlink.schemas import AUDIT_MSG

    audit = topics.consume(_topic_stream(spark, layout, "audit_listener", layout.topics, TOPIC_AUDIT), TOPIC_AUDIT, AUDIT_MSG)
    return (monitor.audit_replication(audit, layout.sites).writeStream.format("parquet")
            .queryName("audit_listener").option("checkpointLocation", layout.checkpoint(spark, "audit_listener"))
            .trigger(**(trigger or {"availableNow": True})).outputMode("append")
            .start(f"{layout.base}/audit"))


def start_mirror_lag_service(spark: SparkSession, layout: Layout, trigger: dict | None = None):
    """Mirror lag (E4 streaming): latest volume observation per replica, update mode."""
    from fieldlink.config import TOPIC_VOLUME_INFO
    from fieldlink.operators import monitor
    from fieldlink.schemas import VOLUME_INFO_MSG

    vi = topics.consume(_topic_stream(spark, layout, "mirror_lag", layout.topics, TOPIC_VOLUME_INFO),
                        TOPIC_VOLUME_INFO, VOLUME_INFO_MSG)
    lag = monitor.mirror_lag(vi)

    def batch(df: DataFrame, batch_id: int) -> None:
        _write_batch(df.withColumn("batch", F.lit(batch_id).cast("bigint")), f"{layout.base}/mirror_lag", batch_id)

    return _start(lag, "mirror_lag", layout, spark, batch, trigger, output_mode="update")


def current_mirror_lag(spark: SparkSession, layout: Layout) -> DataFrame:
    """Newest lag per replica."""
    rows = read_state(spark, f"{layout.base}/mirror_lag")
    return _latest_by_batch(rows, "replica").select("replica", "lag_s", "lag_text")


def site_tiles(spark: SparkSession, hq_layout: Layout, edge_layout: Layout) -> DataFrame:
    """The activity tiles of the running sites (B6), from what the services wrote.

    Feed, download and broadcast tiles come from their topics, response tiles
    from the response service's request log, viewer tiles from the edge
    asset table. Feed this to :func:`fieldlink.operators.activity.newest` or
    :func:`~fieldlink.operators.activity.visible`.
    """
    from fieldlink.functions.paths import asset_path
    from fieldlink.operators import activity

    s = hq_layout.sites
    ensure_dirs(spark, f"{hq_layout.base}/responses")
    feed = topics.consume(topics.read_topic(spark, hq_layout.topics, TOPIC_IMAGEFEED), TOPIC_IMAGEFEED, IMAGEFEED_MSG)
    dl = topics.consume(topics.read_topic(spark, hq_layout.topics, TOPIC_IMAGE_DOWNLOAD), TOPIC_IMAGE_DOWNLOAD,
                        ASSET_MSG).withColumn("location", asset_path(s.download_dir, F.col("assetID"),
                                                                     F.col("filename"), s.layout))
    bc = topics.consume(topics.read_topic(spark, hq_layout.topics, TOPIC_ASSET_BROADCAST), TOPIC_ASSET_BROADCAST,
                        ASSET_MSG)
    resp = spark.read.option("recursiveFileLookup", "true").schema(
        "seq long, ts timestamp_ntz, assetID string, msg_title string, reason string").parquet(
        f"{hq_layout.base}/responses")
    return activity.all_tiles(
        activity.feed_tiles(feed), activity.download_tiles(dl), activity.broadcast_tiles(bc),
        activity.response_tiles(resp), activity.viewer_tiles(edge.viewer(asset_table(spark, edge_layout))))


HQ_PERIOD = {"processingTime": "2 seconds"}
EDGE_PERIOD = {"processingTime": "3 seconds"}


def start_hq(spark: SparkSession, layout: Layout, feed_dir: str, trigger: dict | None = HQ_PERIOD,
             request_topics: str | None = None) -> dict:
    """Start the HQ services (J1); each returned query can be stopped and restarted on its own."""
    return {
        "image_feed": start_feed_service(spark, layout, feed_dir, trigger),
        "image_download": start_download_service(spark, layout, trigger),
        "asset_broadcast": start_broadcast_service(spark, layout, trigger),
        "asset_response": start_response_service(spark, layout, trigger, request_topics),
        "service_counters": start_site_counters(spark, layout, HQ, trigger),
        **start_deadletter_service(spark, layout, HQ, trigger, request_topics),
    }


def start_edge(spark: SparkSession, layout: Layout, broadcast_topics: str,
               trigger: dict | None = EDGE_PERIOD) -> dict:
    """Start the EDGE streaming services: asset state, asset requests, audit
    listener, replica monitor, mirror lag, viewer and counters."""
    return {
        "asset_lifecycle": start_lifecycle_service(spark, layout, broadcast_topics, trigger),
        "asset_request": start_request_service(spark, layout, trigger),
        "asset_viewer": start_viewer_service(spark, layout, trigger),
        "service_counters": start_site_counters(spark, layout, EDGE, trigger),
        "audit_listener": start_audit_listener(spark, layout, trigger),
        "replica_monitor": start_replica_monitor(spark, layout, trigger),
        "mirror_lag": start_mirror_lag_service(spark, layout, trigger),
        **start_deadletter_service(spark, layout, EDGE, trigger, broadcast_topics),
    }


def service_status(queries: dict) -> list[dict]:
    """Per service: active flag, trigger, last batch id, rows in the last batch.

    The reference shows each service's name, period, on/off switch and count;
    here that comes from each streaming query's progress report.
    """
    out = []
    for name, q in queries.items():
        p = q.lastProgress or {}
        out.append({"service": name, "active": q.isActive, "batch": p.get("batchId"),
                    "rows_last_batch": p.get("numInputRows"), "status": q.status.get("message")})
    return out


def stop_all(queries: dict) -> None:
    """Stop services; a restart with the same layout resumes from the checkpoints."""
    for q in queries.values():
        q.stop()
