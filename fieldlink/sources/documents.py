"""Keyed JSON document table: bucketed snapshot, changelog and a "current" view.

Writes append whole documents to a changelog (insert-or-replace semantics:
the newest version of an ``_id`` replaces every field). Reads take the newest
version per ``_id`` with one hash aggregate (``max_by``), which is combined
map-side, so a hot ``_id`` does not pile up in one task.

:func:`fold` moves finished batches of the changelog into a snapshot beside it,
dealt to buckets by a hash of the id. A manifest names the folder of every
bucket and the last batch of each producer that the snapshot holds; a fold
writes only the buckets that change, then the next manifest, which is one
atomic step for readers. A lookup reads the buckets of its ids and the batches
behind the manifest, so what a micro-batch reads follows the batch and the
folding period, not the table. ``compact`` writes the current view to a folder
of the caller's choice.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlink.schemas import DOCUMENT, DOCUMENT_CHANGE
from fieldlink.sources import fs

DOC_FIELDS = [f.name for f in DOCUMENT.fields]


def current(changes: DataFrame, key: str = "_id", order: tuple[str, ...] = ("seq", "rev")) -> DataFrame:
    """Latest whole document per key (last write wins, by ``order``)."""
    value_cols = [c for c in changes.columns if c != key]
    by = [F.coalesce(F.col(c), F.lit(0)) for c in order if c in changes.columns]
    latest = F.max_by(F.struct(*[F.col(c) for c in value_cols]), F.struct(*by) if len(by) > 1 else by[0])
    return (changes.groupBy(key).agg(latest.alias("_d"))
            .select(key, *[F.col(f"_d.{c}").alias(c) for c in value_cols]))


def upsert(changelog_path: str, changes: DataFrame, batch_id: int | None = None,
           producer: str = "default") -> None:
    """Append document versions; with ``batch_id`` the write is idempotent.

    Each producer writes under its own ``<producer>/`` folder; a retried
    micro-batch overwrites its own ``batch=<id>`` folder instead of appending
    a second copy.
    """
    rows = changes.select(*[F.col(f.name).cast(f.dataType) for f in DOCUMENT_CHANGE.fields])
    if batch_id is None:
        rows.write.mode("append").parquet(f"{changelog_path}/{producer}")
    else:
        rows.write.mode("overwrite").parquet(f"{changelog_path}/{producer}/batch={batch_id}")


def read_changelog(spark: SparkSession, changelog_path: str) -> DataFrame:
    """All document versions that were not folded away; an empty table before the first write."""
    if not fs.exists(changelog_path):
        fs.mkdirs(changelog_path)
    return (spark.read.schema(DOCUMENT_CHANGE).option("recursiveFileLookup", "true")
            .parquet(changelog_path))


def read_versions(spark: SparkSession, changelog_path: str, ids: DataFrame | None = None,
                  id_col: str = "assetID") -> DataFrame:
    """Versions that decide the current documents: snapshot rows and the changelog behind the snapshot.

    With ``ids`` only those documents' versions. Of the snapshot just the
    buckets of these ids are read; the bucket numbers (at most as many as there
    are buckets) go through the driver.
    """
    wanted = None if ids is None else _distinct_ids(ids, id_col)
    m = manifest(changelog_path)
    if m is None:
        rows = read_changelog(spark, changelog_path)
    else:
        buckets = sorted(m["paths"], key=int)
        if wanted is not None:
            hit = {str(r[0]) for r in wanted.select(_bucket("_id", m["buckets"])).distinct().collect()}
            buckets = [b for b in buckets if b in hit]
        paths = [f"{snapshot_path(changelog_path)}/{m['paths'][b]}" for b in buckets] + _tail(changelog_path, m["folded"])
        rows = spark.read.schema(DOCUMENT_CHANGE).parquet(*paths) if paths else spark.createDataFrame([], DOCUMENT_CHANGE)
    return rows if wanted is None else rows.join(wanted, "_id", "left_semi")


def read_current(spark: SparkSession, changelog_path: str, snapshot_path: str | None = None,
                 ids: DataFrame | None = None, id_col: str = "assetID") -> DataFrame:
    """Current documents, re-read on every call (fresh inside ``foreachBatch``).

    With ``ids``, only those documents' versions are read and aggregated: the
    semi join runs before the newest-version aggregate (the same answer, since
    the join key is the grouping key), so a micro-batch does not re-aggregate
    the whole table. ``snapshot_path`` adds rows that :func:`compact` wrote.
    """
    changes = read_versions(spark, changelog_path, ids, id_col)
    if snapshot_path:
        more = spark.read.schema(DOCUMENT_CHANGE).parquet(snapshot_path)
        changes = changes.unionByName(more if ids is None else lookup(more, ids, id_col))
    return current(changes)


# --- snapshot --------------------------------------------------------------------

#: Rows of a bucket at which the number of buckets is doubled.
BUCKET_ROWS = 100_000


def snapshot_path(changelog_path: str) -> str:
    return changelog_path.rstrip("/") + "_snapshot"


def manifest(changelog_path: str) -> dict | None:
    """The newest manifest: ``version, buckets, folded`` (producer: last batch), ``paths`` and ``rows`` by bucket."""
    folder = f"{snapshot_path(changelog_path)}/manifests"
    versions = sorted(int(n.split(".")[0]) for n, is_dir in fs.list_dir(folder) if not is_dir and n.split(".", 1)[1] == "json")
    return json.loads(fs.read_text(f"{folder}/{versions[-1]}.json")) if versions else None


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")


def _producers(changelog_path: str) -> dict[str, tuple[list[int], bool]]:
    """Per producer folder its batches, oldest first, and whether it also holds files outside batches."""
    out = {}
    for name, is_dir in fs.list_dir(changelog_path):
        if is_dir:
            inside = fs.list_dir(f"{changelog_path}/{name}")
            batches = sorted(int(n.split("=")[1]) for n, d in inside if d and n.startswith("batch="))
            out[name] = batches, any(not d and n.endswith(".parquet") for n, d in inside)
    return out


def _tail(changelog_path: str, folded: dict[str, int]) -> list[str]:
    """Folders and files of the changelog that the snapshot does not hold."""
    paths = []
    for name, (batches, loose) in _producers(changelog_path).items():
        paths += [f"{changelog_path}/{name}/batch={n}" for n in batches if n > folded.get(name, -1)]
        if loose:
            paths += [f"{changelog_path}/{name}/{n}" for n, d in fs.list_dir(f"{changelog_path}/{name}")
                      if not d and n.endswith(".parquet")]
    return paths


def fold(spark: SparkSession, changelog_path: str, open_from: int | None = None, bucket_rows: int = BUCKET_ROWS) -> bool:
    """Move finished batches of the changelog into the snapshot; whether there was something to move.

    Of every producer the newest batch stays, since it may be in progress or
    be retried; rows written without a batch id stay too. For each document the
    newest version is kept, and beside it the newest one older than
    ``open_from`` (a ``seq``), which a retried producer may still ask for.

    A failure at any step loses nothing: readers follow the newest manifest,
    which is written last. Folders that it no longer names are deleted only by
    the next call, so a reader that listed them can finish. One fold of a table
    may run at a time.
    """
    home, m = snapshot_path(changelog_path), manifest(changelog_path)
    m = m or {"version": 0, "buckets": 1, "folded": {}, "paths": {}, "rows": {}}
    _drop_folded(changelog_path, home, m)
    new = {name: [n for n in batches[:-1] if n > m["folded"].get(name, -1)
                  and fs.exists(f"{changelog_path}/{name}/batch={n}/_SUCCESS")]
           for name, (batches, _) in _producers(changelog_path).items()}
    new = {name: batches for name, batches in new.items() if batches}
    if not new:
        return False
    tail = spark.read.schema(DOCUMENT_CHANGE).parquet(
        *[f"{changelog_path}/{name}/batch={n}" for name, batches in new.items() for n in batches])
    version, buckets = m["version"] + 1, m["buckets"]
    while sum(m["rows"].values()) > bucket_rows * buckets:
        buckets *= 2
    if buckets != m["buckets"]:  # dealt anew: every bucket changes
        changed = list(m["paths"])
    else:
        changed = [str(r[0]) for r in tail.select(_bucket("_id", buckets)).distinct().collect()]
    old = [f"{home}/{m['paths'][b]}" for b in changed if b in m["paths"]]
    rows = tail.unionByName(spark.read.schema(DOCUMENT_CHANGE).parquet(*old)) if old else tail
    is_open = F.col("seq") >= F.lit(open_from) if open_from is not None else F.lit(False)
    newest = F.max_by(F.struct(*[f.name for f in DOCUMENT_CHANGE.fields]), F.struct("seq", F.coalesce("rev", F.lit(0))))
    kept = rows.groupBy("_id", is_open.alias("_open")).agg(newest.alias("_d")).select("_d.*", _bucket("_d._id", buckets))
    target = f"{home}/v={version}"
    kept.hint("rebalance", "bucket").sortWithinPartitions("bucket", "_id").write.mode("overwrite").partitionBy("bucket").parquet(target)
    written = {str(r["bucket"]): r["count"] for r in
               spark.read.schema("_id string, bucket bigint").parquet(target).groupBy("bucket").count().collect()}
    stay = {} if buckets != m["buckets"] else m
    paths = {**stay.get("paths", {}), **{b: f"v={version}/bucket={b}" for b in written}}
    after = {"version": version, "buckets": buckets, "folded": {**m["folded"], **{name: max(b) for name, b in new.items()}},
             "paths": paths, "rows": {**stay.get("rows", {}), **written}}
    fs.mkdirs(f"{home}/manifests")
    fs.write_text(f"{home}/manifests/{version}.json", json.dumps(after))
    return True


def _drop_folded(changelog_path: str, home: str, m: dict) -> None:
    """Delete what an earlier fold replaced: its batches, bucket folders that no manifest names, older manifests."""
    for name, (batches, _) in _producers(changelog_path).items():
        for n in batches:
            if n <= m["folded"].get(name, -1):
                fs.delete_dir(f"{changelog_path}/{name}/batch={n}")
    named = set(m["paths"].values())
    for v, is_dir in fs.list_dir(home):
        if is_dir and v.startswith("v=") and int(v[2:]) <= m["version"]:
            inside = [b for b, d in fs.list_dir(f"{home}/{v}") if d and b.startswith("bucket=")]
            for b in inside:
                if f"{v}/{b}" not in named:
                    fs.delete_dir(f"{home}/{v}/{b}")
            if not any(f"{v}/{b}" in named for b in inside):
                fs.delete_dir(f"{home}/{v}")
    for n, is_dir in fs.list_dir(f"{home}/manifests"):
        if not is_dir and n != f"{m['version']}.json":
            fs.delete_file(f"{home}/manifests/{n}")


def lookup(documents: DataFrame, ids: DataFrame, id_col: str = "assetID") -> DataFrame:
    """Documents whose ``_id`` is among ``ids`` (absent ids give no row)."""
    return documents.join(_distinct_ids(ids, id_col), "_id", "left_semi")


def whole(documents: DataFrame) -> DataFrame:
    """``_id, document``: each document as one JSON text.

    The item as it came, unknown attributes included, with ``_id`` and, once
    downloaded, ``imageDownloadLocation`` added behind its own attributes. A
    document stored without its text is put together from the declared fields.
    """
    own = F.to_json(F.struct("_id", "imageDownloadLocation"))
    text = F.regexp_replace(F.trim("extra"), r"\s*\}$", "")
    joined = F.concat(text, F.when(F.trim(text) == "{", F.lit("")).otherwise(F.lit(",")), F.substring(own, 2, 1 << 30))
    typed = F.to_json(F.struct("data", "links", "_id", "imageDownloadLocation"))
    return documents.select("_id", F.when(F.col("extra").isNull(), typed).otherwise(joined).alias("document"))


def _distinct_ids(ids: DataFrame, id_col: str) -> DataFrame:
    """Each id once: a popular id shrinks in every task before the shuffle, which a semi join's right side needs."""
    return ids.select(F.col(id_col).alias("_id")).filter(F.col("_id").isNotNull()).distinct()


def compact(spark: SparkSession, changelog_path: str, snapshot_path: str,
            previous_snapshot: str | None = None) -> None:
    """Write the current view (with its ``seq``) to a new snapshot folder."""
    cur = read_current(spark, changelog_path, previous_snapshot)
    cur.select(*[f.name for f in DOCUMENT_CHANGE.fields]).write.mode("overwrite").parquet(snapshot_path)
