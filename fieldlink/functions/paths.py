"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlink.config import LAYOUT_BY_ASSET, LAYOUT_FLAT, LAYOUT_SHARDED


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def last_segment(p) -> Column:
    """Text after the last ``/`` (query string kept), like ``s.split('/').pop()``."""
    return F.try_element_at(F.split(_c(p), "/"), F.lit(-1))


def basename(p) -> Column:
    """POSIX ``basename``: same as the last segment."""
    return last_segment(p)


def basename_normpath(p) -> Column:
    """``basename(normpath(p))`` for the common case: trailing slashes dropped.

    ``..`` and ``.`` segments are not resolved.
    """
    return F.regexp_extract(F.regexp_replace(_c(p), "/+$", ""), "([^/]*)$", 1)


def topic_address(stream, topic) -> Column:
    """``stream:topic``."""
    return F.concat_ws(":", _c(stream), _c(topic))


def asset_path(root: str, asset_id, filename, layout: str = LAYOUT_SHARDED) -> Column:
    """Where an asset's file lives under ``root`` for the chosen layout."""
    if layout == LAYOUT_SHARDED:
        aid = _c(asset_id)
        return F.concat_ws("/", F.lit(root), F.substring(aid, 1, 2), aid, _c(filename))
    if layout == LAYOUT_BY_ASSET:
        return F.concat_ws("/", F.lit(root), _c(asset_id), _c(filename))
    if layout == LAYOUT_FLAT:
        return F.concat_ws("/", F.lit(root), _c(filename))
    raise ValueError(f"unknown layout {layout!r}")


def relative_to(path, root: str) -> Column:
    """Path below ``root`` (scheme such as ``file:`` ignored); null when outside."""
    root = root.rstrip("/")
    pat = "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?)?" + _regex_escape(root) + "/(.*)$"
    rel = F.regexp_extract(_c(path), pat, 1)
    return F.when(rel != "", rel)


def _regex_escape(s: str) -> str:
    return "".join("\\" + ch if ch in ".^$*+?{}[]\\|()" else ch for ch in s)
