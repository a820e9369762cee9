"""Topic retention by consumer positions.

Every service that reads a topic folder is noted with its checkpoint when it
starts. A file of a topic goes when two things hold: it was written longer ago
than the topic's time-to-live, so every message in it is older too, and each
of the folder's consumers has committed a batch that read it. A consumer that
lags, or has not started its first batch, therefore keeps what it has not
read. Readers leave out files that are gone, so a batch read at the same time
does not fail.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlink.sources import fs, volumes

_ENTRY = "path string, batchId long"


def note_consumer(base: str, name: str, checkpoint: str, folders: list[str]) -> None:
    """Remember that a streaming query reads these topic folders, with the folder of its positions."""
    fs.mkdirs(f"{base}/_consumers")
    fs.write_text(f"{base}/_consumers/{name}.json", json.dumps({"checkpoint": checkpoint, "folders": folders}))


def forget_consumer(base: str, name: str) -> None:
    """A consumer that will not run again no longer holds back what it has not read."""
    fs.delete_file(f"{base}/_consumers/{name}.json")


def consumers(base: str) -> dict[str, dict]:
    return {n.removesuffix(".json"): json.loads(fs.read_text(f"{base}/_consumers/{n}"))
            for n, is_dir in fs.list_dir(f"{base}/_consumers") if not is_dir and n.endswith(".json")}


def _committed(checkpoint: str) -> list[int]:
    """Per source of a query the last entry of its file log that a committed batch covers; empty before the first."""
    batches = [int(n) for n, is_dir in fs.list_dir(f"{checkpoint}/commits") if not is_dir and n.isdigit()]
    if not batches:
        return []
    offsets = fs.read_text(f"{checkpoint}/offsets/{max(batches)}").splitlines()[2:]
    return [json.loads(o).get("logOffset", -1) if o.startswith("{") else -1 for o in offsets]


def consumed(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``path`` (without scheme) of every file that a query's committed batches have read."""
    upto = _committed(checkpoint)
    logs = [f"{checkpoint}/sources/{k}" for k in range(len(upto)) if fs.exists(f"{checkpoint}/sources/{k}")]
    if not logs:
        return spark.createDataFrame([], "path string")
    lines = spark.read.text(logs).select(
        F.regexp_extract("_metadata.file_path", r"/sources/(\d+)/[^/]*$", 1).cast("int").alias("source"),
        F.from_json("value", _ENTRY).alias("e"))
    done = F.element_at(F.array(*[F.lit(n) for n in upto]), F.col("source") + 1)
    read = lines.filter(F.col("e.path").isNotNull() & (F.col("e.batchId") <= done))
    # The log holds URIs; a plus sign stands for itself there.
    path = F.url_decode(F.replace(F.col("e.path"), F.lit("+"), F.lit("%2B")))
    return read.select(volumes.plain_path(path).alias("path")).distinct()


def _drop_emptied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        gone = []
        for d in pdf["folder"]:
            gone.append(not any(is_dir or n.endswith(".parquet") for n, is_dir in fs.list_dir(d)))
            if gone[-1]:
                fs.delete_dir(d)
        yield pd.DataFrame({"folder": pdf["folder"], "dropped": gone})


def expire_topics(spark: SparkSession, layout, ttl_seconds: int, now: float | None = None) -> int:
    """Delete what all consumers of the site's topics have read and is older than ``ttl_seconds``; the number of files.

    Folders without a noted consumer are left alone. Deletions run in
    executors; a run that dies is made up for by the next one.
    """
    cutoff = (time.time() if now is None else now) - ttl_seconds
    known, expired = consumers(layout.base), 0
    for root in (layout.topics, layout.replica):
        for topic, is_dir in fs.list_dir(root):
            folder = f"{root}/{topic}"
            readers = [c for c in known.values() if folder in c["folders"]]
            if not is_dir or not readers:
                continue
            old = volumes.list_volume(spark, folder, missing_ok=True).filter(
                F.col("path").endswith(".parquet") & (F.col("modificationTime") < F.timestamp_seconds(F.lit(cutoff))))
            old = old.select(volumes.plain_path("path").alias("path"))
            for c in readers:
                old = old.join(consumed(spark, c["checkpoint"]), "path", "left_semi")
            log = f"{layout.base}/expired/{topic}-{time.time_ns()}"
            volumes.delete_files(old, "path").write.parquet(log)  # the deletions happen in this write
            done = spark.read.schema(volumes.COPY_RESULT_SCHEMA).parquet(log).filter("ok")
            emptied = done.select(F.regexp_replace("dst", "/[^/]*$", "").alias("folder")).filter("folder RLIKE '/batch=[0-9]+$'")
            expired += done.count()
            emptied.distinct().mapInPandas(_drop_emptied, "folder string, dropped boolean").count()
            fs.delete_dir(log)
    return expired
