"""Copies that show whole files only, listings in steps, reads in pieces."""

import hashlib
import os
import subprocess
import sys
import time

import pandas as pd
import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from fieldlink.sources import fs, transfer, volumes


def write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


ODD_NAMES = ["x?page=2&ref=x", "x#top", "%41.jpg", "a b.jpg", "é日.jpg", "x", "A.jpg", ".hidden", "_under", "a:b", "it's \"q\".jpg"]


def test_names_stand_for_themselves(spark, tmp_path):
    """Characters that mean something in a URI do not in a path."""
    for n in ODD_NAMES:
        write(f"{tmp_path}/src/{n}", n.encode())
    for p in (f"{tmp_path}/src/x#top", f"file:{tmp_path}/src/x#top", f"file://{tmp_path}/src/x#top"):
        assert fs.resolve(p)[1] == f"{tmp_path}/src/x#top"
    m = spark.createDataFrame([(f"{tmp_path}/src/{n}", f"{tmp_path}/dst/{n}") for n in ODD_NAMES], "src string, dst string")
    got = {os.path.basename(r.dst): r for r in volumes.copy_files(m).collect()}
    assert set(got) == set(ODD_NAMES) and all(r.ok for r in got.values())
    for n in ODD_NAMES:
        assert open(f"{tmp_path}/dst/{n}", "rb").read() == n.encode()
        assert (got[n].length, got[n].sha256) == (len(n.encode()), hashlib.sha256(n.encode()).hexdigest())
    listed = volumes.list_volume(spark, f"{tmp_path}/dst")
    assert {os.path.basename(r.path) for r in listed.collect()} == set(ODD_NAMES)
    assert {r.path for r in volumes.stat_files(listed).collect()} == {r.path for r in listed.collect()}


COPY_AND_DIE = """
import os, sys
sys.path.insert(0, {root!r})
from fieldlink.sources import transfer
done = 0
real = transfer._chunks
def chunks(stream, size=None):
    global done
    for c in real(stream, size):
        done += 1
        if done == {at}:
            os._exit(9)
        yield c
transfer._chunks, transfer.CHUNK = chunks, 1000
transfer.copy({src!r}, {dst!r})
"""


@pytest.mark.parametrize("at", [1, 3, 6, 9])  # while it is written, and while it is read back
@pytest.mark.parametrize("old", [None, b"old"])
def test_a_copy_that_dies_leaves_the_target_as_it_was(spark, tmp_path, at, old):
    src, dst = f"{tmp_path}/src/f.bin", f"{tmp_path}/dst/a/f.bin"
    write(src, b"x" * 4500)
    if old:
        write(dst, old)
    code = COPY_AND_DIE.format(root=ROOT, src=src, dst=dst, at=at)
    assert subprocess.run([sys.executable, "-c", code], timeout=60).returncode == 9
    assert (open(dst, "rb").read() if os.path.exists(dst) else None) == old
    left = [n for n in os.listdir(os.path.dirname(dst)) if n != "f.bin"]
    assert len(left) == 1 and left[0].startswith(".f.bin.part-")
    # Neither a listing nor a mirror sees the rest, and the next attempt is not in its way.
    assert volumes.list_volume(spark, f"{tmp_path}/dst").count() == (old is not None)
    assert transfer.copy(src, dst)[0] == 4500 and open(dst, "rb").read() == b"x" * 4500
    assert volumes.sweep_parts(spark, f"{tmp_path}/dst").count() == 0  # it could still be running
    os.utime(f"{os.path.dirname(dst)}/{left[0]}", (time.time() - 7200,) * 2)
    assert [r.ok for r in volumes.sweep_parts(spark, f"{tmp_path}/dst").collect()] == [True]
    assert os.listdir(os.path.dirname(dst)) == ["f.bin"]
    assert volumes.sweep_parts(spark, f"{tmp_path}/none").count() == 0


def test_a_copy_that_fails_cleans_up_and_keeps_the_target(tmp_path, monkeypatch):
    src, dst = f"{tmp_path}/f", f"{tmp_path}/d/f"
    write(src, b"new" * 1000)
    write(dst, b"old")
    real = transfer._digest
    monkeypatch.setattr(transfer, "_digest", lambda f, p: (real(f, p)[0], "0" * 64))
    with pytest.raises(OSError, match="differs"):
        transfer.copy(src, dst)
    monkeypatch.setattr(transfer, "_digest", real)
    chunks = transfer._chunks

    def growing(stream, size=None):
        for c in chunks(stream, size):
            yield c
            with open(src, "ab") as f:
                f.write(b"more")
            return

    monkeypatch.setattr(transfer, "_chunks", growing)
    with pytest.raises(OSError, match="changed"):
        transfer.copy(src, dst)
    monkeypatch.setattr(transfer, "_chunks", chunks)
    with pytest.raises(IsADirectoryError):
        transfer.copy(src, f"{tmp_path}/d")
    with pytest.raises(IsADirectoryError):
        transfer.copy(src, f"{tmp_path}/e/")
    with pytest.raises(FileNotFoundError):
        transfer.copy(f"{tmp_path}/d", f"{tmp_path}/e")
    assert open(dst, "rb").read() == b"old" and os.listdir(f"{tmp_path}/d") == ["f"]


def test_a_reader_never_sees_half_a_file(tmp_path):
    """While a target is replaced again and again, every read is one whole version."""
    versions = [bytes([k]) * (200_000 + k) for k in range(6)]
    for k, v in enumerate(versions):
        write(f"{tmp_path}/v{k}", v)
    dst = f"{tmp_path}/d/f"
    transfer.copy(f"{tmp_path}/v0", dst)
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from fieldlink.sources import transfer
transfer.CHUNK = 5000
for k in range(60):
    transfer.copy('{tmp_path}/v%d' % (k % 6), {dst!r})
"""
    running, seen = subprocess.Popen([sys.executable, "-c", code]), set()
    while running.poll() is None:
        data = open(dst, "rb").read()
        assert data in versions
        seen.add(data[0])
    assert running.returncode == 0 and len(seen) > 1


def _tree(root, shape):
    made = set()
    if shape == "wide":  # many files in one folder
        os.makedirs(f"{root}/a")
        made = {f"{root}/a/f{i}" for i in range(100_000)}
    elif shape == "folders":  # many folders in one
        made = {f"{root}/d{i}/f" for i in range(20_000)} | {f"{root}/top"}
    else:  # deep
        made = {f"{root}/" + "/".join(f"l{k}" for k in range(i)) + "/f" for i in range(1, 200)}
    for p in made:
        if shape != "wide":
            os.makedirs(os.path.dirname(p), exist_ok=True)
        os.close(os.open(p, os.O_CREAT | os.O_WRONLY))
    return made


@pytest.mark.parametrize("shape", ["wide", "folders", "deep"])
def test_listing_of_any_shape(spark, tmp_path, shape, monkeypatch):
    made = _tree(str(tmp_path / "v"), shape)
    paths = [r.path[len("file:"):] for r in volumes.list_volume(spark, str(tmp_path / "v")).toLocalIterator()]
    assert len(paths) == len(made) and set(paths) == made


@pytest.mark.parametrize("shape, entries, held", [("wide", 5000, 500), ("folders", 1000, 500), ("deep", 10, 7)])
def test_one_step_of_a_listing_is_bounded(tmp_path, shape, entries, held):
    """A task's memory follows its limits, not the size of a folder; what it leaves comes back as folders."""
    made, root = _tree(str(tmp_path / "v"), shape), str(tmp_path / "v")
    found, todo, steps = set(), [root], 0
    while todo:
        nxt, steps = [], steps + 1
        for frame in volumes._walk(iter([pd.DataFrame({"path": todo})]), entries, held):
            assert len(frame) <= held
            found |= {p[len("file:"):] for p in frame.loc[~frame["is_dir"].astype(bool), "path"]}
            nxt += frame.loc[frame["is_dir"].astype(bool), "path"].tolist()
        assert nxt != todo
        todo = nxt
    assert found == made and (steps == 1) == (shape == "wide")


def test_ranges_and_digests_of_files(spark, tmp_path, monkeypatch):
    big, other = os.urandom(10_000_000), os.urandom(5000)
    write(f"{tmp_path}/big", big)
    write(f"{tmp_path}/other", other)
    write(f"{tmp_path}/empty", b"")
    names = ["big", "other", "empty", "none", "big"]
    wanted = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in names] + [(None,)], "path string")
    pieces = volumes.read_ranges(wanted, range_bytes=3_000_000).collect()
    of = lambda n: b"".join(r.content for r in sorted((r for r in pieces if r.path.endswith(f"/{n}")), key=lambda r: r.offset))
    assert (of("big"), of("other"), of("empty")) == (big, other, b"")
    assert sorted(r.offset for r in pieces if r.path.endswith("/big")) == [0, 3_000_000, 6_000_000, 9_000_000]
    assert [(r.content, r.error[:17]) for r in pieces if r.path.endswith("/none")] == [(None, "FileNotFoundError")]
    got = {os.path.basename(r.path): (r.length, r.sha256) for r in volumes.file_digests(wanted).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {"big": (len(big), sha(big)), "other": (5000, sha(other)), "empty": (0, sha(b"")), "none": (None, None)}
    assert volumes.read_ranges(wanted.limit(0)).count() == 0


def test_many_files_are_read_within_a_budget(tmp_path):
    """What a task holds at a time is bounded by bytes, not by the number of files."""
    for i in range(60):
        write(f"{tmp_path}/f{i}", b"x" * 1_000_000)
    df = pd.DataFrame({"path": [f"{tmp_path}/f{i}" for i in range(60)]})
    sizes = [sum(map(len, f["content"])) for f in volumes._read_batches_fn(iter([df]))]
    assert sum(sizes) == 60_000_000 and max(sizes) <= volumes.BATCH_BYTES + 1_000_000


def test_part_names(spark):
    names = [transfer.part_path("/v/a/f.jpg"), "/v/a/f.jpg", "/v/a/.f.part-1", "/v/.part-x/f", transfer.part_path("/v/f\n.jpg")]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert [r[0] for r in df.select(volumes.is_part("path")).collect()][:4] == [True, False, False, False]
    assert df.filter(F.col("path").isNull()).count() == 0
