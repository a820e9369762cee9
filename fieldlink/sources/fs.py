"""Folder bookkeeping on shared storage through ``pyarrow.fs`` (a public library).

Spark reads and writes the data; this module only creates, lists, renames
and deletes folders (metadata operations). Paths may be plain (``/a/b``),
``file:/a/b``, or URIs; ``s3a://``/``s3n://`` map to ``s3://``.
"""

from __future__ import annotations

from pyarrow import fs as pafs

_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def resolve(path: str):
    """``(filesystem, path inside it)`` for a Spark-style path.

    Only scheme and authority are read as a URI. What follows is a plain path,
    in which ``?``, ``#``, ``%``, blanks and other characters stand for themselves.
    """
    import os

    if "://" not in path or path.startswith("file://"):
        local = path[len("file:"):] if path.startswith("file:") else path
        local = local[2:] if local.startswith("//") else local
        return pafs.LocalFileSystem(), os.path.abspath(local)
    scheme, rest = path.split("://", 1)
    authority, _, inside = rest.partition("/")
    f, base = pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{authority}/")
    return f, f"{base.rstrip('/')}/{inside}"


def mkdirs(*paths: str) -> None:
    for p in paths:
        f, q = resolve(p)
        f.create_dir(q, recursive=True)


def exists(path: str) -> bool:
    f, q = resolve(path)
    return f.get_file_info(q).type != pafs.FileType.NotFound


def file_size_and_mtime(path: str) -> tuple[int, str]:
    f, q = resolve(path)
    info = f.get_file_info(q)
    return int(info.size or 0), str(info.mtime_ns)


def list_dir(path: str) -> list[tuple[str, bool]]:
    """Entries directly below ``path``: ``(name, is_dir)``; empty when missing."""
    f, q = resolve(path)
    return [(i.base_name, i.type == pafs.FileType.Directory)
            for i in f.get_file_info(pafs.FileSelector(q, recursive=False, allow_not_found=True))]


def rename(src: str, dst: str) -> bool:
    """Move ``src`` to ``dst``; False when ``dst`` already exists (someone else won)."""
    f, s = resolve(src)
    _, d = resolve(dst)
    if f.get_file_info(d).type != pafs.FileType.NotFound:
        return False
    try:
        f.move(s, d)
    except OSError:
        if f.get_file_info(d).type == pafs.FileType.NotFound:
            raise
        return False
    return True


def write_text(path: str, text: str) -> None:
    """Write a small file so that readers see all of it or nothing."""
    import uuid

    f, q = resolve(path)
    part = f"{q}.{uuid.uuid4().hex}"
    with f.open_output_stream(part) as out:
        out.write(text.encode())
    f.move(part, q)


def read_text(path: str) -> str:
    f, q = resolve(path)
    with f.open_input_stream(q) as s:
        return s.read().decode()


def delete_file(path: str) -> None:
    f, q = resolve(path)
    if f.get_file_info(q).type == pafs.FileType.File:
        f.delete_file(q)


def delete_dir(path: str) -> None:
    f, q = resolve(path)
    if f.get_file_info(q).type == pafs.FileType.Directory:
        f.delete_dir(q)
