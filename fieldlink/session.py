"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "fieldlink", extra: dict | None = None) -> SparkSession:
    """Session with the settings every job here assumes.

    UTC session time (the topic log carries ``timestamp_ntz``), AQE with skew
    join and partition coalescing, no UI server. On a cluster pass ``master``
    as None and let the submitter decide.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot join key even when that costs an extra shuffle.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        # Reliable checkpoints (ordering helpers, per micro-batch) are removed once unreferenced.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    existing = SparkSession.getActiveSession()
    if "spark.checkpoint.dir" not in conf and existing is None:
        # Only a fresh local session gets a scratch folder; a cluster session
        # arrives with spark.checkpoint.dir already pointing at shared storage.
        if master and master.startswith("local"):
            conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="fieldlink-ckpt-")
            conf.setdefault("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="fieldlink-wh-"))
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the submitter sets it to shared storage; it is only filled in
    here (with a fresh local scratch folder) when unset in a local session, as
    in tests. A Spark Connect session has no SparkContext; there the setting
    must come from the server.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        return d
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="fieldlink-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions of the file jobs and pandas stages are pickled by reference, so
    every worker must be able to import them, installed there or not.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="fieldlink-ship-"), "fieldlink_package.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
