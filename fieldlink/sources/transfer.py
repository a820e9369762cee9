"""Moving file bytes inside tasks: copies that show whole files only, and reads in byte ranges.

A copy streams into a part file beside its target, under a name of its own
for every attempt. It is read back and compared by length and SHA-256 with
what was read from the source, and only then moved onto the target. The move
is atomic on local disks and HDFS; object stores show an object only when it
is complete. A reader of the target therefore sees the file as it was
before or all of the new one, whichever attempts die or run twice, and two
attempts never write to one file. What dead attempts leave behind has a name
that listings leave out and :func:`is_part` knows, for sweeping.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

from pyarrow import fs as pafs

from fieldlink.sources.fs import resolve

#: Bytes held at a time while a file is copied or read.
CHUNK = 1 << 20
#: Name of a part file, as a regular expression of Java and Python.
PART = r"^\..*\.part-[0-9a-f]{32}$"


def part_path(target: str) -> str:
    """A path beside ``target`` that no other attempt uses."""
    folder, name = posixpath.split(target)
    return posixpath.join(folder, f".{name}.part-{uuid.uuid4().hex}")


def _chunks(stream, size: int | None = None) -> Iterator[bytes]:
    while size is None or size > 0:
        chunk = stream.read(CHUNK if size is None else min(CHUNK, size))
        if not chunk:
            return
        size = None if size is None else size - len(chunk)
        yield chunk


def digest(path: str) -> tuple[int, str]:
    """Length and SHA-256 of a file, a chunk at a time."""
    f, p = resolve(path)
    return _digest(f, p)


def _digest(f, path: str) -> tuple[int, str]:
    n, sha = 0, hashlib.sha256()
    with f.open_input_stream(path) as s:
        for chunk in _chunks(s):
            n += len(chunk)
            sha.update(chunk)
    return n, sha.hexdigest()


def _publish(f, path: str, chunks, check=lambda n: None) -> tuple[int, str]:
    """Write ``chunks`` to a part file, compare it with what was written, and move it onto ``path``."""
    f.create_dir(posixpath.dirname(path), recursive=True)
    part = part_path(path)
    try:
        n, sha = 0, hashlib.sha256()
        with f.open_output_stream(part) as out:
            for chunk in chunks:
                n += len(chunk)
                sha.update(chunk)
                out.write(chunk)
        check(n)
        if _digest(f, part) != (n, sha.hexdigest()):
            raise OSError(f"what was written for {path} differs from what was read")
        f.move(part, path)
    except BaseException:
        if f.get_file_info(part).type == pafs.FileType.File:
            f.delete_file(part)
        raise
    return n, sha.hexdigest()


def _file_target(path: str):
    f, p = resolve(path)
    if path.endswith("/") or f.get_file_info(p).type == pafs.FileType.Directory:
        raise IsADirectoryError(path)
    return f, p


def put(path: str, content: bytes) -> tuple[int, str]:
    """Store bytes as a file and return their length and SHA-256; the file changes all at once or not at all."""
    f, p = _file_target(path)
    return _publish(f, p, (content[k : k + CHUNK] for k in range(0, len(content), CHUNK)))


def copy(src: str, dst: str) -> tuple[int, str]:
    """Copy one file and return its length and SHA-256; the target changes all at once or not at all."""
    source, spath = resolve(src)
    before = source.get_file_info(spath)
    if src.endswith("/") or before.type != pafs.FileType.File:
        raise FileNotFoundError(src)
    target, dpath = _file_target(dst)

    def unchanged(n: int) -> None:
        after = source.get_file_info(spath)
        if (n, before.size, before.mtime_ns) != (after.size, after.size, after.mtime_ns):
            raise OSError(f"{src} changed while it was copied")

    with source.open_input_stream(spath) as s:
        return _publish(target, dpath, _chunks(s), unchanged)


def ranges(path: str, size: int) -> Iterator[tuple[int, bytes]]:
    """A file's bytes as ``(offset, content)`` pieces of at most ``size`` bytes; one empty piece for an empty file."""
    f, p = resolve(path)
    with f.open_input_stream(p) as s:
        at = 0
        while True:
            piece = b"".join(_chunks(s, size))
            if piece or not at:
                yield at, piece
            at += len(piece)
            if len(piece) < size:
                return
