"""Names, paths and defaults.

Everything under "Fixed values" must stay equal to the behaviour being
reproduced (topic names, status strings, service labels, tile texts, limits);
the site roots are this project's own defaults and are parameters everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values -----------------------------------------------------------
# Topics
TOPIC_IMAGEFEED = "IMAGEFEED"
TOPIC_IMAGE_DOWNLOAD = "IMAGE_DOWNLOAD"
TOPIC_ASSET_BROADCAST = "ASSET_BROADCAST"
TOPIC_ASSET_REQUEST = "ASSET_REQUEST"
# Message and asset statuses
STATUS_SUCCESS = "success"
STATUS_FAILED = "failed"
STATUS_LISTED = "!"
STATUS_REQUESTING = "requesting..."
STATUS_REQUESTED = "requested"
STATUS_RECEIVED = "received"
# Constant creator id on feed messages
MESSAGE_CREATOR_ID = "ezshow"
# Service names (site, name)
SERVICES = [
    ("HQ", "IMAGE Feed"),
    ("HQ", "Image Download"),
    ("HQ", "Asset Broadcast"),
    ("HQ", "Asset Response"),
    ("EDGE", "Audit Listener"),
    ("EDGE", "Upstream Comm"),
    ("EDGE", "Broadcast Listener"),
    ("EDGE", "Asset Request"),
    ("EDGE", "Asset Viewer"),
]
# Activity tiles: service labels and fixed texts
TILE_IMAGE_FEED = "IMAGE Feed Service"
TILE_IMAGE_DOWNLOAD = "Image Download Service"
TILE_ASSET_BROADCAST = "Asset Broadcast Service"
TILE_ASSET_RESPONSE = "Asset Response Service"
TILE_ASSET_VIEWER = "Asset Viewer Service"
TILE_FEED_TITLE_PREFIX = "Asset: "
TILE_FEED_DESCRIPTION = "New asset available from IMAGE"
TILE_BROADCAST_TITLE_PREFIX = "Broadcasting: "
TILE_RESPONSE_TITLE_PREFIX = "Processing: "
TILE_TITLE_WIDTH = 32
TILE_DESCRIPTION_WIDTH = 64
SHORTEN_PLACEHOLDER = " [...]"
TILE_TTL_SECONDS = 20
# Replication monitoring
AUDIT_UPSTREAM_ADD = "DB_UPSTREAMADD"
NOT_A_VALID_STREAM = " is not a valid stream"
REPLICA_ERROR = "ERROR"
REPLICA_NO_STREAM = "NO STREAM"
REPLICA_PAUSED = "PAUSED"
REPLICA_SYNCED = "SYNCED"
REPLICA_UNKNOWN = "UNKNOWN"
STATUS_OK = "OK"
LAG_SUFFIX = " ago"
# Topic retention (seconds)
TOPIC_TTL_SECONDS = 38400
# Sub-paths under a site root
DOWNLOAD_DIR = "downloadedAssets"
MISSION_FILES_DIR = "files"
MIRROR_FILES_DIR = "files.mirror"
IMAGE_TABLE_NAME = "imagesTable"
PIPELINE_STREAM = "pipelineStream"
REPLICATED_STREAM = "replicatedStream"
REPLICATED_STREAM_COPY = "replicatedStream.copy"
# --- end of fixed values ----------------------------------------------------

# Site names and this project's default roots (parameters everywhere).
HQ = "HQ"
EDGE = "EDGE"
HQ_ROOT = "/apps/fieldlink"
EDGE_ROOT = "/apps/fieldlink-edge"
SOURCE_IMAGES_ROOT = "/srv/fieldlink/images"  # HQ-local folder the feed's images come from

# Extra topics for monitoring observations and the edge request log.
TOPIC_AUDIT = "AUDIT"
TOPIC_REPLICA_INFO = "REPLICA_INFO"
TOPIC_VOLUME_INFO = "VOLUME_INFO"

# File layout. "sharded" (default) stores <root>/<assetID[0:2]>/<assetID>/<filename>:
# assets whose URLs end in the same name do not overwrite each other, and a
# volume's top level has at most 256 folders (asset ids are hex), so no single
# directory grows with the number of assets. "by_asset" drops the shard level;
# "flat" keeps <root>/<filename>.
LAYOUT_SHARDED = "sharded"
LAYOUT_BY_ASSET = "by_asset"
LAYOUT_FLAT = "flat"


@dataclass(frozen=True)
class Sites:
    """Where each site keeps its volumes, tables and streams."""

    hq_root: str = HQ_ROOT
    edge_root: str = EDGE_ROOT
    source_images: str = SOURCE_IMAGES_ROOT
    layout: str = LAYOUT_SHARDED

    @property
    def download_dir(self) -> str:
        return f"{self.hq_root}/{DOWNLOAD_DIR}"

    @property
    def hq_files(self) -> str:
        return f"{self.hq_root}/{MISSION_FILES_DIR}"

    @property
    def edge_files(self) -> str:
        return f"{self.edge_root}/{MIRROR_FILES_DIR}"

    @property
    def image_table(self) -> str:
        return f"{self.hq_root}/{IMAGE_TABLE_NAME}"

    @property
    def hq_stream(self) -> str:
        return f"{self.hq_root}/{PIPELINE_STREAM}"

    @property
    def hq_replicated_stream(self) -> str:
        return f"{self.hq_root}/{REPLICATED_STREAM}"

    @property
    def edge_replicated_stream(self) -> str:
        return f"{self.edge_root}/{REPLICATED_STREAM_COPY}"


DEFAULT_SITES = Sites()
