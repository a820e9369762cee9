"""Topic log: consume, produce, replicate, expire.

A topic is a set of rows ``(seq, ts, origin, topic, key, value)`` stored as
parquet in the topic's own folder; ``value`` is the message's JSON text. A
consumer reads with a declared schema (no inference) and decodes with
``from_json``. Rows whose JSON does not parse are split off to a
dead letter instead of ending the consumer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlink.config import TOPIC_TTL_SECONDS
from fieldlink.schemas import TOPIC_LOG
from fieldlink.sources import fs

CORRUPT = "_corrupt"
ENVELOPE = ["seq", "ts", "origin", "topic", "key"]


def topic_path(base: str, topic: str) -> str:
    """Each topic lives in its own folder under ``base`` and has one producer."""
    return f"{base.rstrip('/')}/{topic}"


#: Bytes of files that a micro-batch of a topic's consumer takes at most (at least one file).
BYTES_PER_TRIGGER = 1 << 30


def read_topic(spark: SparkSession, base: str, topic: str, streaming: bool = False,
               max_files_per_trigger: int | None = None, partitioned: bool = False,
               max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Open one topic.

    A stream takes a backlog in micro-batches of at most ``BYTES_PER_TRIGGER``
    (or the given limit). Files that retention deletes meanwhile are left out.

    Two layouts: a folder per topic (``<base>/<topic>``; written by the
    streaming file sink and read through its commit log, or by
    ``foreachBatch`` as ``batch=<id>/`` sub-folders), or an archive log
    partitioned by ``topic`` (``partitioned=True``: ``<base>/topic=<name>/``,
    where only that partition's files are listed and read).
    """
    if partitioned and not streaming:
        return (spark.read.option("basePath", base).parquet(f"{base.rstrip('/')}/topic={topic}")
                .select(*[F.col(f.name).cast(f.dataType) for f in TOPIC_LOG.fields], *_day_col(base, spark)))
    path = topic_path(base, topic)
    if streaming:
        r = spark.readStream.schema(TOPIC_LOG).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
        else:
            r = r.option("maxBytesPerTrigger", str(max_bytes_per_trigger or BYTES_PER_TRIGGER))
        return r.parquet(path)
    return (spark.read.schema(TOPIC_LOG).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
            .parquet(path))


def read_topic_log(spark: SparkSession, base: str, topic_names: list[str] | None = None) -> DataFrame:
    """Several topics as one log (batch). Without names: the whole archive log
    partitioned by ``topic`` under ``base``."""
    if topic_names is None:
        return (spark.read.parquet(base)
                .select(*[F.col(f.name).cast(f.dataType) for f in TOPIC_LOG.fields], *_day_col(base, spark)))
    out = None
    for t in topic_names:
        df = read_topic(spark, base, t)
        out = df if out is None else out.unionByName(df)
    return out


def _day_col(base: str, spark: SparkSession) -> list:
    """``dt`` when the archive is partitioned by day (kept so filters on it prune folders)."""
    for name, is_dir in fs.list_dir(base):
        if is_dir and name.startswith("topic="):
            return [F.col("dt")] if any(d and n.startswith("dt=") for n, d in fs.list_dir(f"{base}/{name}")) else []
    return []


KAFKA_MISSING = ("the Kafka connector (spark-sql-kafka) is not on the classpath; "
                 "use the folder topics or add the connector package")


def read_topic_kafka(spark: SparkSession, servers: str, topic: str, origin: str,
                     streaming: bool = True, options: dict | None = None) -> DataFrame:
    """A Kafka topic as topic-log rows: ``seq`` = offset, ``ts`` = broker time.

    Offsets are ordered per Kafka partition; ``origin`` names the site whose
    cluster this is. Needs the Kafka connector on the classpath.
    """
    r = spark.readStream if streaming else spark.read
    r = r.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    r = r.option("startingOffsets", "earliest")
    for k, v in (options or {}).items():
        r = r.option(k, v)
    try:
        raw = r.load()
    except Exception as e:  # the connector is an optional package
        if "kafka" in str(e).lower() and ("find data source" in str(e).lower() or "DATA_SOURCE_NOT_FOUND" in str(e)):
            raise RuntimeError(KAFKA_MISSING) from e
        raise
    return raw.select(
        F.col("offset").alias("seq"), F.col("timestamp").cast("timestamp_ntz").alias("ts"),
        F.lit(origin).alias("origin"), F.col("topic"), F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"))


def write_topic_kafka(rows: DataFrame, servers: str, topic: str, checkpoint: str,
                      trigger: dict | None = None):
    """Produce topic-log rows to Kafka (``key``, ``value`` as UTF-8)."""
    out = rows.select(F.col("key"), F.col("value"))
    w = (out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
         .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})))
    try:
        return w.start()
    except Exception as e:
        if "kafka" in str(e).lower() and ("find data source" in str(e).lower() or "DATA_SOURCE_NOT_FOUND" in str(e)):
            raise RuntimeError(KAFKA_MISSING) from e
        raise


def subscribe(log: DataFrame, topic: str) -> DataFrame:
    """One topic; on a partitioned log this is partition pruning."""
    return log.filter(F.col("topic") == F.lit(topic))


def _parse(log: DataFrame, schema: T.StructType) -> DataFrame:
    """Decode ``value`` once into ``_msg``.

    The decode sits inside a one-element ``explode`` so the optimizer cannot
    copy ``from_json`` into the following filter and projection (which would
    parse every message two or three times).
    """
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType(), True)])
    parsed = F.from_json(F.col("value"), with_corrupt,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return log.select("*", F.explode(F.array(parsed)).alias("_msg"))


def _is_bad() -> Column:
    return F.col("_msg").isNull() | F.col(f"_msg.{CORRUPT}").isNotNull()


def consume(log: DataFrame, topic: str, schema: T.StructType,
            envelope: list[str] = ENVELOPE) -> DataFrame:
    """Well-formed messages of ``topic``: envelope columns plus decoded fields."""
    df = _parse(subscribe(log, topic), schema)
    return df.filter(~_is_bad()).select(
        *[F.col(c) for c in envelope], *[F.col(f"_msg.{f.name}").alias(f.name) for f in schema.fields])


def malformed(log: DataFrame, schemas: dict[str, T.StructType]) -> DataFrame:
    """Rows of the given topics whose JSON does not decode: ``seq, topic, origin, raw``."""
    parts = None
    for topic, schema in schemas.items():
        df = _parse(subscribe(log, topic), schema).filter(_is_bad()).select(
            "seq", "topic", "origin", F.col("value").alias("raw"))
        parts = df if parts is None else parts.unionByName(df)
    return parts


def unusable(log: DataFrame, topic: str, schema: T.StructType, needs: str | None = None) -> DataFrame:
    """Rows of ``topic`` that no stage can use: ``seq, topic, origin, raw, reason``.

    ``malformed`` rows do not decode; rows whose field ``needs`` is null are
    ``no_<field>``.
    """
    reason = F.when(_is_bad(), F.lit("malformed"))
    if needs:
        reason = reason.when(F.col(f"_msg.{needs}").isNull(), F.lit(f"no_{needs}"))
    df = _parse(subscribe(log, topic), schema).withColumn("reason", reason)
    return df.filter(F.col("reason").isNotNull()).select("seq", "topic", "origin", F.col("value").alias("raw"), "reason")


def encode(df: DataFrame, topic: str, fields: list[str], origin: str | Column,
           seq: str = "seq", ts: str = "ts", key: str | None = "assetID") -> DataFrame:
    """Turn rows into topic-log rows: JSON ``value`` from ``fields``."""
    org = F.lit(origin) if isinstance(origin, str) else origin
    return df.select(
        F.col(seq).cast("bigint").alias("seq"),
        F.col(ts).cast("timestamp_ntz").alias("ts"),
        org.alias("origin"),
        F.lit(topic).alias("topic"),
        (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"),
        F.to_json(F.struct(*[F.col(f) for f in fields])).alias("value"),
    )


def write_topic_log(rows: DataFrame, base: str, mode: str = "errorifexists", by_day: bool = True) -> None:
    """Write rows of many topics as an archive log partitioned by ``topic`` (and day).

    With ``by_day`` each topic folder holds ``dt=<date>/`` folders: retention
    drops whole days and readers of recent data prune the rest. Rows are
    rebalanced by the partition columns first, so each folder gets few files and
    AQE splits a topic-day that is larger than a task should write.
    """
    if by_day:
        rows = rows.withColumn("dt", F.to_date("ts"))
        rows.hint("rebalance", "topic", "dt").write.mode(mode).partitionBy("topic", "dt").parquet(base)
    else:
        rows.write.mode(mode).partitionBy("topic").parquet(base)


def write_topic(rows: DataFrame, base: str, topic: str, batch_id: int | None = None) -> bool:
    """Append encoded rows to a topic (batch or inside ``foreachBatch``); whether this call published them.

    With ``batch_id`` the rows are written under a name of this attempt's own,
    which readers leave out, and then become ``batch=<id>/`` in one step. A
    batch that is there already stays as it is: what a consumer has listed
    never changes or vanishes, and a retried micro-batch adds nothing.
    """
    path = topic_path(base, topic)
    if batch_id is None:
        rows.write.mode("append").parquet(path)
        return True
    final = f"{path}/batch={batch_id}"
    if fs.exists(f"{final}/_SUCCESS"):
        return False
    attempt = f"{path}/_attempt-{batch_id}-{uuid.uuid4().hex}"
    rows.write.parquet(attempt)
    if fs.rename(attempt, final):
        return True
    fs.delete_dir(attempt)  # another attempt was faster
    return False


def write_topic_stream(rows: DataFrame, base: str, topic: str, checkpoint: str,
                       trigger: dict | None = None, query_name: str | None = None):
    """Streaming produce through the parquet file sink (exactly-once)."""
    w = (rows.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .outputMode("append"))
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start(topic_path(base, topic))


def replicate(site_logs: dict[str, DataFrame]) -> DataFrame:
    """Multi-master replication between sites.

    Each site forwards only rows it originated (``origin == site``), so a row
    never travels back to where it came from. Every site's log afterwards is
    its own rows plus what others forwarded, with at-least-once duplicates
    removed on ``(origin, topic, seq)``. Returns all sites' logs with a
    ``site`` column.
    """
    sites = list(site_logs)
    out = None
    for site in sites:
        parts = site_logs[site]
        for other in sites:
            if other == site:
                continue
            fwd = site_logs[other].filter(F.col("origin") == F.lit(other))
            parts = parts.unionByName(fwd)
        view = parts.withColumn("site", F.lit(site))
        out = view if out is None else out.unionByName(view)
    return out.dropDuplicates(["site", "origin", "topic", "seq"])


def expire(log: DataFrame, ttl_seconds: int = TOPIC_TTL_SECONDS, now: Column | None = None) -> DataFrame:
    """Messages still inside retention: ``ts >= now - ttl``.

    ``now`` defaults to the newest ``ts`` in the log (a scalar subquery, one
    small aggregate job), which keeps batch runs deterministic.
    """
    if now is None:
        now = log.select(F.max("ts")).scalar()
    cutoff = now - F.make_dt_interval(secs=F.lit(ttl_seconds))
    keep = F.col("ts") >= cutoff
    if "dt" in log.columns:  # day-partitioned archive: whole older days are never read
        keep = (F.col("dt") >= F.to_date(cutoff)) & keep
    return log.filter(keep)


def compact_expired(spark: SparkSession, base: str, topic: str, out_base: str,
                    ttl_seconds: int = TOPIC_TTL_SECONDS, now: Column | None = None) -> None:
    """Physical retention: write the rows still inside ``ttl`` to a new topic folder.

    The old folder can then be dropped; readers switch to ``out_base``.
    """
    kept = expire(read_topic(spark, base, topic), ttl_seconds, now)
    kept.write.mode("overwrite").parquet(topic_path(out_base, topic))


def dedupe_stream(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """At-least-once delivery made idempotent in a stream.

    ``ts`` is cast to TIMESTAMP (watermarks reject ``timestamp_ntz``); state
    for a key is kept only while its ``ts`` is within ``delay`` of the newest.
    """
    return (rows.withColumn("_event_time", F.col("ts").cast("timestamp"))
            .withWatermark("_event_time", delay)
            .dropDuplicatesWithinWatermark(["origin", "topic", "seq"])
            .drop("_event_time"))
