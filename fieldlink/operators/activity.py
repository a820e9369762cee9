"""Activity feed: the tiles each service emits, newest first, with time-to-live."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlink.config import (
    TILE_ASSET_BROADCAST,
    TILE_ASSET_RESPONSE,
    TILE_ASSET_VIEWER,
    TILE_BROADCAST_TITLE_PREFIX,
    TILE_DESCRIPTION_WIDTH,
    TILE_FEED_DESCRIPTION,
    TILE_FEED_TITLE_PREFIX,
    TILE_IMAGE_DOWNLOAD,
    TILE_IMAGE_FEED,
    TILE_RESPONSE_TITLE_PREFIX,
    TILE_TITLE_WIDTH,
    TILE_TTL_SECONDS,
)
from fieldlink.functions.text import shorten, shorten_exact

TILE_COLUMNS = ["seq", "ts", "service", "title", "description", "image_url"]


def _tile(df: DataFrame, service: str, title: Column, description: Column,
          image_url: Column | None, seq: str = "seq", ts: str = "ts") -> DataFrame:
    return df.select(
        F.col(seq).alias("seq"), F.col(ts).alias("ts"), F.lit(service).alias("service"),
        title.alias("title"), description.alias("description"),
        (image_url if image_url is not None else F.lit(None).cast("string")).alias("image_url"))


def feed_tiles(feed_msgs: DataFrame) -> DataFrame:
    return _tile(feed_msgs, TILE_IMAGE_FEED, F.concat(F.lit(TILE_FEED_TITLE_PREFIX), F.col("assetID")),
                 F.lit(TILE_FEED_DESCRIPTION), None)


def download_tiles(download_msgs: DataFrame) -> DataFrame:
    return _tile(download_msgs, TILE_IMAGE_DOWNLOAD, F.col("title"), F.col("description"), F.col("location"))


def broadcast_tiles(broadcasts: DataFrame) -> DataFrame:
    return _tile(broadcasts, TILE_ASSET_BROADCAST,
                 F.concat(F.lit(TILE_BROADCAST_TITLE_PREFIX), F.col("assetID")), F.col("title"), None)


def response_tiles(responses: DataFrame) -> DataFrame:
    ok = responses.filter(F.col("reason").isNull())
    return _tile(ok, TILE_ASSET_RESPONSE, F.concat(F.lit(TILE_RESPONSE_TITLE_PREFIX), F.col("assetID")),
                 F.col("msg_title"), None)


def viewer_tiles(received: DataFrame) -> DataFrame:
    return _tile(received, TILE_ASSET_VIEWER, F.col("title"), F.col("description"), F.col("path"),
                 seq="p_seq", ts="p_ts")


def all_tiles(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def newest_of(seqs: DataFrame, tiles_from: Callable[[int], DataFrame], n: int = 20, first: int = 4) -> DataFrame:
    """A service's newest ``n`` tiles, made from as few of its messages as that takes.

    ``seqs`` has the ``seq`` of all its messages; ``tiles_from(seq)`` makes
    all tiles of the messages from there on, each with its message's ``seq``. The
    newest ``first * n`` messages are tried first, then eight times as many,
    until ``n`` tiles are found: no older message can give a newer one. So
    joins and decoding see some hundred messages, not a service's history.
    At most ``n`` rows pass through the driver.
    """
    k = first * n
    while True:
        seen = seqs.select("seq").orderBy(F.col("seq").desc()).limit(k).agg(F.min("seq").alias("cut"), F.count("*").alias("n")).first()
        tiles = tiles_from(seen["cut"] if seen["n"] == k else -(1 << 63)).select(*TILE_COLUMNS)
        rows = tiles.orderBy(F.col("seq").desc(), F.col("service")).limit(n).collect()
        if len(rows) == n or seen["n"] < k:
            return seqs.sparkSession.createDataFrame(rows, tiles.schema)
        k *= 8


def newest(tiles: DataFrame, n: int = 20, exact: bool = False) -> DataFrame:
    """Newest ``n`` tiles with shortened texts (G2: a distributed top-k).

    ``exact`` shortens with Python's own ``textwrap`` (a pandas UDF on the
    ``n`` rows left after the top-k) instead of the JVM expression.
    """
    cut = shorten_exact if exact else shorten
    top = tiles.orderBy(F.col("seq").desc(), F.col("service")).limit(n)
    return top.select(
        "seq", "service",
        cut(F.col("title"), TILE_TITLE_WIDTH).alias("title_short"),
        cut(F.col("description"), TILE_DESCRIPTION_WIDTH).alias("description_short"),
        "image_url")


def visible(tiles: DataFrame, ttl_seconds: int = TILE_TTL_SECONDS, now: Column | None = None) -> DataFrame:
    """Tiles still shown: viewer tiles never expire, others live ``ttl_seconds``."""
    if now is None:
        now = tiles.select(F.max("ts")).scalar()
    keep = (F.col("service") == TILE_ASSET_VIEWER) | (
        F.col("ts") >= now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return tiles.filter(keep)
