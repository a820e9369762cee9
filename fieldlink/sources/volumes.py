"""Volumes: listing, usage, file copies and mirror sync planning.

Listings are walked by executors, from the root on (zero-length files
included); the ``binaryFile`` source (``content`` pruned) is an option,
but it leaves zero-length files out.
Copies, reads and deletes run in executors through ``mapInPandas`` with
``pyarrow.fs``, which speaks to local, HDFS and object-store paths alike; a
manifest is de-duplicated map-side first, then grouped by destination so two
copies to one path never race. How bytes move is in :mod:`.transfer`.
"""

from __future__ import annotations

import collections
import datetime as dt
import os
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlink.functions.paths import relative_to
from fieldlink.session import ensure_checkpoint_dir
from fieldlink.sources import transfer

COPY_RESULT_SCHEMA = "src string, dst string, ok boolean, error string, length bigint, sha256 string"
LISTING_SCHEMA = "path string, modificationTime timestamp, length bigint"


def _fs_and_path(p: str):
    from fieldlink.sources.fs import resolve

    return resolve(p)


def _prefix(p: str) -> str:
    """``file:`` for local paths, ``scheme://authority`` for URIs (as listings print paths)."""
    if "://" not in p:
        return "file:"
    scheme, rest = p.split("://", 1)
    return f"{scheme}://{rest.split('/', 1)[0]}"


#: Entries a task lists before it hands the folders that are left to the next step; rows it holds at a time.
WALK_ENTRIES, WALK_ROWS = 20_000, 4096
_WALK_SCHEMA = LISTING_SCHEMA + ", is_dir boolean"
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def _entries(folder: str) -> Iterator[tuple]:
    """Entries of one folder as ``(path, mtime, size, is_dir)``; none if it is gone. Local folders are read as a stream."""
    from pyarrow import fs as pafs

    f, root = _fs_and_path(folder)
    prefix = _prefix(folder)
    if isinstance(f, pafs.LocalFileSystem):
        try:
            with os.scandir(root) as found:
                for e in found:
                    if e.is_dir():
                        if not e.is_symlink():  # a linked folder could lead back here
                            yield prefix + e.path, None, None, True
                    elif e.is_file():
                        try:
                            st = e.stat()
                        except FileNotFoundError:  # deleted meanwhile
                            continue
                        yield prefix + e.path, _EPOCH + dt.timedelta(microseconds=st.st_mtime_ns // 1000), st.st_size, False
        except FileNotFoundError:
            return
    else:
        for i in f.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True)):
            if i.type == pafs.FileType.Directory:
                yield prefix + i.path, None, None, True
            elif i.type == pafs.FileType.File:
                yield prefix + i.path, i.mtime, i.size, False


def _walk(batches: Iterator[pd.DataFrame], entries: int | None = None, held: int | None = None) -> Iterator[pd.DataFrame]:
    """List folders and those below them until ``entries`` entries were seen; folders not listed by then are rows.

    At most about ``entries`` folder names and ``held`` rows are in memory, however large a folder is.
    """
    entries, held = entries or WALK_ENTRIES, held or WALK_ROWS
    frame = lambda rows: pd.DataFrame(rows, columns=["path", "modificationTime", "length", "is_dir"])
    for pdf in batches:
        todo, seen, rows = collections.deque(pdf["path"]), 0, []
        while todo and seen < entries:
            for row in _entries(todo.popleft()):
                seen += 1
                if row[3] and seen < entries:
                    todo.append(row[0])
                else:
                    rows.append(row)
                if len(rows) >= held:
                    yield frame(rows)
                    rows = []
        rows += [(d, None, None, True) for d in todo]
        for k in range(0, max(1, len(rows)), held):
            yield frame(rows[k : k + held])


def list_volume(spark: SparkSession, path: str, method: str = "tree", missing_ok: bool = False,
                parts: bool = False) -> DataFrame:
    """Recursive listing: ``path, modificationTime, length`` (paths as ``scheme:/...``).

    ``tree`` (default): a walk in steps. Each step's tasks list the folders
    found so far and what lies below them, up to some thousand entries a task;
    the folders that are left are dealt out anew in the next step, so neither
    the driver nor one task lists a volume, whatever its shape. A step's rows
    are checkpointed. Every file counts, whatever its name or length, but the
    part files of running copies, which only ``parts`` shows. Local folders
    that are links are not followed.

    A root that does not exist is an error unless ``missing_ok``: an empty
    listing of a mistyped source would make a mirror delete all it has.
    ``pyarrow.fs`` must reach the store (local, S3, GCS; HDFS through
    libhdfs). ``binaryFile``: Spark's file source with ``content`` pruned,
    which reaches any Hadoop store but holds every file status on the driver
    and leaves out zero-length files and names that begin with ``_`` or ``.``.
    """
    if method == "binaryFile":
        return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
                .select("path", "modificationTime", "length"))
    from pyarrow import fs as pafs

    f, root = _fs_and_path(path)
    if f.get_file_info(root).type != pafs.FileType.Directory:
        if missing_ok:
            return spark.createDataFrame([], LISTING_SCHEMA)
        raise FileNotFoundError(path)
    ensure_checkpoint_dir(spark)
    todo, found = spark.createDataFrame([(_prefix(path) + root,)], "path string"), None
    while True:
        step = _spread(todo, "path", None if found is not None else 1).mapInPandas(_walk, _WALK_SCHEMA).checkpoint(eager=True)
        files = step.filter(~F.col("is_dir")).drop("is_dir")
        found = files if found is None else found.unionByName(files)
        todo = step.filter("is_dir").select("path")
        if todo.isEmpty():
            return found if parts else found.filter(~is_part("path"))


def is_part(path) -> "F.Column":
    """Whether a path is that of a running or dead copy's part file."""
    name = F.regexp_extract(F.col(path) if isinstance(path, str) else path, "[^/]*$", 0)
    return name.rlike(transfer.PART)


def sweep_parts(spark: SparkSession, path: str, older_than_s: int = 3600) -> DataFrame:
    """Delete part files of dead copies: those nothing was written to for ``older_than_s`` seconds.

    Returns one row per file (as :func:`delete_files`). A missing root has none.
    """
    old = F.col("modificationTime") < F.current_timestamp() - F.make_dt_interval(secs=F.lit(older_than_s))
    return delete_files(list_volume(spark, path, missing_ok=True, parts=True).filter(is_part("path") & old), "path")


def _stat_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs as pafs

    for pdf in batches:
        rows = []
        for p in pdf["path"]:
            try:
                f, q = _fs_and_path(p)
            except ValueError:  # not a path at all, so no file stands there
                continue
            info = f.get_file_info(q)  # a store that can't be reached fails the task, and the batch retries
            if info.type == pafs.FileType.File:
                rows.append((_prefix(p) + q if "://" not in p else p, info.mtime, info.size))
        yield pd.DataFrame(rows, columns=["path", "modificationTime", "length"])


def stat_files(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Listing rows (``path, modificationTime, length``) for those of the given paths that exist.

    Checks only the paths asked for, spread over executors, so a stage that
    needs a few files' presence does not list a whole volume.
    """
    p = paths.select(F.col(path_col).alias("path")).filter(F.col("path").isNotNull()).dropDuplicates(["path"])
    return _spread(p, "path").mapInPandas(_stat_batches, LISTING_SCHEMA)


def volume_usage(listings: dict[str, DataFrame]) -> DataFrame:
    """Files and bytes per volume: ``volume, n_files, bytes``."""
    parts = [df.select(F.lit(name).alias("volume"), "length") for name, df in listings.items()]
    allrows = parts[0]
    for p in parts[1:]:
        allrows = allrows.unionByName(p)
    return allrows.groupBy("volume").agg(F.count(F.lit(1)).alias("n_files"),
                                         F.sum("length").cast("bigint").alias("bytes"))


_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?"


def plain_path(p) -> "F.Column":
    """Path without ``scheme:`` or ``scheme://authority`` (listings say ``file:/a``, callers ``/a``)."""
    return F.regexp_replace(F.col(p) if isinstance(p, str) else p, _SCHEME, "")


def file_present(wanted: DataFrame, listing: DataFrame, path_col: str = "path",
                 out: str = "present") -> DataFrame:
    """Add a boolean ``out``: does ``wanted[path_col]`` exist in ``listing``?

    Both sides are compared without scheme and authority. A listing holds
    each path once, so the left join adds no rows.
    """
    lst = listing.select(plain_path("path").alias("_lp")).withColumn(out, F.lit(True))
    j = wanted.join(lst, plain_path(path_col) == F.col("_lp"), "left").drop("_lp")
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def _copy_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for src, dst in zip(pdf["src"], pdf["dst"]):
            try:
                rows.append((src, dst, True, None, *transfer.copy(src, dst)))
            except Exception as e:  # one bad file must not fail the batch
                rows.append((src, dst, False, f"{type(e).__name__}: {e}", None, None))
        yield pd.DataFrame(rows, columns=["src", "dst", "ok", "error", "length", "sha256"]).astype({"length": "Int64"})


def _spread(rows: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Deal file work to a fixed number of tasks.

    A number given explicitly is not merged by AQE, which would judge the rows
    by their few bytes, not by the files they stand for.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key)


def copy_files(manifest: DataFrame, partitions: int | None = None) -> DataFrame:
    """Copy each distinct ``(src, dst)``, overwriting; returns ``src, dst, ok, error, length, sha256``.

    A target is replaced by a whole and checked copy at once or stays as it
    was (:func:`.transfer.copy`), also when a task dies or an attempt runs
    twice. Idempotent: running it again rewrites the same files.
    """
    m = manifest.select("src", "dst").filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    # De-duplicate first (combined map-side, so a popular asset's many copy
    # requests shrink to one row per task before any shuffle), then group the
    # distinct copies by destination so two copies to one path never race.
    m = m.dropDuplicates(["dst", "src"])
    return _spread(m, "dst", partitions).mapInPandas(_copy_batches, COPY_RESULT_SCHEMA)


def store_files(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Store rows ``(path, content)`` as files: ``path, ok, error, length, sha256``.

    Files appear whole (:func:`.transfer.put`). Of rows that name one path any
    one wins. No shuffle: the contents stay in their partitions.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((p, True, None, *transfer.put(p, bytes(content))))
                except Exception as e:  # one bad file must not fail the batch
                    rows.append((p, False, f"{type(e).__name__}: {e}", None, None))
            yield pd.DataFrame(rows, columns=["path", "ok", "error", "length", "sha256"]).astype({"length": "Int64"})

    rows = files.select(F.col(path_col).alias("path"), F.col(content_col).cast("binary").alias("content"))
    rows = rows.filter(F.col("path").isNotNull() & F.col("content").isNotNull())
    return rows.mapInPandas(run, "path string, ok boolean, error string, length bigint, sha256 string")


def mirror_diff(src: DataFrame, src_root: str, dst: DataFrame, dst_root: str,
                include_same: bool = False) -> DataFrame:
    """Plan a one-way mirror from ``src`` to ``dst`` listings.

    ``copy``: only in the source; ``delete``: only in the mirror; ``refresh``:
    in both but length differs or the source is newer; ``same`` otherwise.
    Returns ``rel_path, action, src_path, dst_path``.
    """
    s = src.select(relative_to("path", src_root).alias("rel_path"), F.col("path").alias("src_path"),
                   F.col("length").alias("s_len"), F.col("modificationTime").alias("s_mt"))
    d = dst.select(relative_to("path", dst_root).alias("rel_path"), F.col("path").alias("dst_path"),
                   F.col("length").alias("d_len"), F.col("modificationTime").alias("d_mt"))
    j = s.join(d, "rel_path", "full_outer")
    action = (F.when(F.col("dst_path").isNull(), F.lit("copy"))
              .when(F.col("src_path").isNull(), F.lit("delete"))
              .when((F.col("s_len") != F.col("d_len")) |
                    (F.coalesce(F.col("s_mt") > F.col("d_mt"), F.lit(False))), F.lit("refresh"))
              .otherwise(F.lit("same")))
    out = j.select("rel_path", action.alias("action"), "src_path", "dst_path")
    return out if include_same else out.filter(F.col("action") != "same")


def _delete_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs as pafs

    for pdf in batches:
        oks, errs = [], []
        for p in pdf["dst"]:
            try:
                f, fp = _fs_and_path(p)
                if f.get_file_info(fp).type == pafs.FileType.File:
                    f.delete_file(fp)
                oks.append(True)  # already gone counts as done: deletes are idempotent
                errs.append(None)
            except Exception as e:
                oks.append(False)
                errs.append(f"{type(e).__name__}: {e}")
        yield pd.DataFrame({"src": [None] * len(pdf), "dst": pdf["dst"], "ok": oks, "error": errs,
                            "length": pd.array([None] * len(pdf), "Int64"), "sha256": [None] * len(pdf)})


def delete_files(paths: DataFrame, path_col: str = "dst") -> DataFrame:
    """Delete each distinct path; returns the columns of :func:`copy_files` (``src``, ``length`` and ``sha256`` null)."""
    p = paths.select(F.col(path_col).alias("dst")).filter(F.col("dst").isNotNull())
    return _spread(p.dropDuplicates(["dst"]), "dst").mapInPandas(_delete_batches, COPY_RESULT_SCHEMA)


def mirror_apply(plan: DataFrame, dst_root: str, src_root: str, delete: bool = True) -> DataFrame:
    """Carry out a mirror plan: copy new and changed files, and (one-way mirror)
    delete files that are gone from the source. Returns one row per action."""
    root = dst_root.rstrip("/")
    todo = plan.filter(F.col("action").isin("copy", "refresh")).select(
        F.col("src_path").alias("src"),
        F.concat_ws("/", F.lit(root), F.col("rel_path")).alias("dst"))
    done = copy_files(todo)
    if delete:
        gone = plan.filter(F.col("action") == "delete").select(
            F.concat_ws("/", F.lit(root), F.col("rel_path")).alias("dst"))
        done = done.unionByName(delete_files(gone))
    return done


#: Bytes of a piece, and of the pieces that a task hands over at a time.
RANGE_BYTES, BATCH_BYTES = 4 << 20, 16 << 20


def read_ranges(wanted: DataFrame, path_col: str = "path", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The wanted files' bytes in pieces: ``path, offset, content, error``.

    A file of any size passes through a task in pieces of ``range_bytes``, and
    a task hands over about ``BATCH_BYTES`` at a time. An empty file is one
    empty piece; an absent or unreadable one a row with null content and the error.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=["path", "offset", "content", "error"]).astype({"offset": "Int64"})
        rows, held = [], 0
        for pdf in batches:
            for p in pdf["path"]:
                try:
                    for at, piece in transfer.ranges(p, range_bytes):
                        rows.append((p, at, piece, None))
                        held += len(piece)
                        if held >= BATCH_BYTES or len(rows) >= WALK_ROWS:
                            yield frame(rows)
                            rows, held = [], 0
                except Exception as e:
                    rows.append((p, None, None, f"{type(e).__name__}: {e}"))
        yield frame(rows)

    return _wanted(wanted, path_col).mapInPandas(run, "path string, offset bigint, content binary, error string")


def file_digests(wanted: DataFrame, path_col: str = "path") -> DataFrame:
    """``path, length, sha256, error`` of the wanted files, each read a chunk at a time; nulls where a file can't be read."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                try:
                    rows.append((p, *transfer.digest(p), None))
                except Exception as e:
                    rows.append((p, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "length", "sha256", "error"]).astype({"length": "Int64"})

    return _wanted(wanted, path_col).mapInPandas(run, "path string, length bigint, sha256 string, error string")


def _wanted(wanted: DataFrame, path_col: str) -> DataFrame:
    """Distinct paths, combined map-side so that hot ones shrink before the shuffle, dealt to tasks."""
    paths = wanted.select(F.col(path_col).alias("path")).filter(F.col("path").isNotNull())
    return _spread(paths.dropDuplicates(["path"]), "path")


def _read_batches_fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, held = [], 0
    frame = lambda rows: pd.DataFrame(rows, columns=["path", "content", "error"])
    for pdf in batches:
        for p in pdf["path"]:
            try:
                f, fp = _fs_and_path(p)
                with f.open_input_stream(fp) as s:
                    rows.append((p, s.read(), None))
                held += len(rows[-1][1])
            except Exception as e:  # absent or unreadable: no content
                rows.append((p, None, f"{type(e).__name__}: {e}"))
            if held >= BATCH_BYTES or len(rows) >= WALK_ROWS:
                yield frame(rows)
                rows, held = [], 0
    yield frame(rows)


def read_files(wanted: DataFrame, path_col: str = "path") -> DataFrame:
    """Bytes of the wanted files (A7): ``path, content, error``; absent files give null content.

    Only the wanted files are opened (a ``binaryFile`` scan of the whole
    volume would read every file's bytes). A row holds a whole file, a task
    about ``BATCH_BYTES`` and one file; :func:`read_ranges` is for large files.
    """
    return _wanted(wanted, path_col).mapInPandas(_read_batches_fn, "path string, content binary, error string")
