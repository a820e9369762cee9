"""Declared record shapes. Nothing here is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
L = T.LongType()
B = T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Topic log: one row per message. ``value`` is the UTF-8 JSON text.
TOPIC_LOG = T.StructType([
    T.StructField("seq", L, False),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("origin", S, True),
    T.StructField("topic", S, True),
    T.StructField("key", S, True),
    T.StructField("value", S, True),
])

# Feed file: {"collection": {"items": [item, ...]}}
FEED_DATA = _struct(("title", S), ("description", S), ("item_id", S))
FEED_LINK = _struct(("href", S))
FEED_ITEM = _struct(("data", T.ArrayType(FEED_DATA)), ("links", T.ArrayType(FEED_LINK)))
# Items are read as their JSON text, so attributes that FEED_ITEM does not name are kept.
FEED_FILE = _struct(("collection", _struct(("items", T.ArrayType(S)))))

# Stored document (keyed by _id); ``extra`` is the JSON text of the item as it came.
DOCUMENT = T.StructType([
    T.StructField("_id", S, False),
    T.StructField("data", T.ArrayType(FEED_DATA), True),
    T.StructField("links", T.ArrayType(FEED_LINK), True),
    T.StructField("imageDownloadLocation", S, True),
    T.StructField("extra", S, True),
])
# Changelog row: a whole document version plus its ordering key (seq, rev):
# ``seq`` is the message that caused the write, ``rev`` orders several writes
# caused by one message (the download stage's update comes after the feed's).
DOCUMENT_CHANGE = T.StructType(DOCUMENT.fields + [T.StructField("seq", L, False),
                                                  T.StructField("rev", T.IntegerType(), True)])

# Message bodies per topic.
IMAGEFEED_MSG = _struct(("title", S), ("description", S), ("tablename", S),
                        ("assetID", S), ("messageCreatorID", S))
ASSET_MSG = _struct(("title", S), ("description", S), ("filename", S),
                    ("assetID", S), ("status", S))
AUDIT_MSG = _struct(("operation", S), ("upstreamPath", S))
REPLICA_INFO_MSG = _struct(
    ("status", S),
    ("errors", T.ArrayType(_struct(("desc", S)))),
    ("data", T.ArrayType(_struct(("replicaState", S), ("paused", B), ("isUptodate", B)))),
)
VOLUME_INFO_MSG = _struct(
    ("timestamp", L),
    ("data", T.ArrayType(_struct(("lastSuccessfulMirrorTime", L)))),
)

# Volume listing, as ``binaryFile`` returns it without ``content``.
LISTING = T.StructType([
    T.StructField("path", S, False),
    T.StructField("modificationTime", T.TimestampType(), True),
    T.StructField("length", L, True),
])

# Action logs that are not topics: row clicks and request publications (edge).
ASSET_ACTION = T.StructType([
    T.StructField("seq", L, False),
    T.StructField("ts", T.TimestampNTZType(), True),
    T.StructField("assetID", S, True),
])

# Outcome of storing one downloaded asset (from the copy job).
STORE_RESULT = T.StructType([
    T.StructField("seq", L, False),
    T.StructField("ok", B, True),
])
