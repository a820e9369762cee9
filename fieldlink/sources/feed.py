"""Feed ingest: nested JSON files of ``collection.items``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlink.schemas import FEED_FILE, FEED_ITEM

CORRUPT = "_corrupt_record"
FEED_FILE_READ = T.StructType(FEED_FILE.fields + [T.StructField(CORRUPT, T.StringType(), True)])


def read_feed_files(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Feed files (one JSON document per file) with the declared schema.

    Each file is one record, so files are the unit of parallelism; a feed
    that arrives as one huge file should be split upstream. A file that is not
    valid JSON keeps its text in ``_corrupt_record`` (see :func:`bad_feed_files`);
    ``file`` is the source path.
    """
    r = spark.readStream if streaming else spark.read
    df = (r.option("multiLine", "true").option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT).schema(FEED_FILE_READ).json(path))
    return df.withColumn("file", F.col("_metadata.file_path"))


def explode_items(feed: DataFrame) -> DataFrame:
    """One row per item of ``collection.items`` of well-formed files.

    ``item`` has the declared fields, ``raw`` the item's whole JSON text and
    ``item_pos`` its place in the file. An item that is no object, or whose
    declared fields have other types, has them null.
    """
    cols = [F.col(c) for c in ("file",) if c in feed.columns]
    ok = feed.filter(F.col(CORRUPT).isNull()) if CORRUPT in feed.columns else feed
    read = F.transform("collection.items", lambda raw: F.struct(F.from_json(raw, FEED_ITEM).alias("item"), raw.alias("raw")))
    return ok.select(*cols, F.posexplode(read).alias("item_pos", "_e")).select(*cols, "item_pos", "_e.item", "_e.raw")


def bad_feed_files(feed: DataFrame) -> DataFrame:
    """Feed files that did not parse: ``file, reason, parsed``.

    No filter may reach the JSON reader here: its pushed-down filters drop
    corrupt rows. The test is a null-tolerant ``coalesce`` (no ``IsNotNull``
    is inferred or pushed). ``collection`` is read through the ``parsed``
    output flag rather than a filter, because Spark refuses a raw JSON scan
    whose only column is the corrupt record.
    """
    corrupt = F.length(F.coalesce(F.col(CORRUPT), F.lit(""))) > 0
    return feed.filter(corrupt).select("file", F.lit("malformed_json").alias("reason"),
                                       F.col("collection").isNotNull().alias("parsed"))
