"""The command line parses its arguments (no Spark started for --help)."""

import os
import subprocess
import sys

from conftest import ROOT


def test_cli_help():
    out = subprocess.run([sys.executable, "-m", "fieldlink", "--help"], cwd=ROOT, capture_output=True, text=True,
                         timeout=120, env={**os.environ, "PYTHONPATH": ROOT})
    assert out.returncode == 0
    for cmd in ("hq", "edge", "mirror", "publish", "status"):
        assert cmd in out.stdout


def test_cli_runs_a_feed_item_to_the_edge(tmp_path):
    import hashlib
    import json

    (tmp_path / "feed").mkdir()
    (tmp_path / "feed/f.json").write_text(json.dumps({"collection": {"items": [
        {"data": [{"title": "Moon", "description": "m", "item_id": "1"}], "links": [{"href": "http://img/a/moon.jpg"}]}]}}))
    aid = hashlib.sha256(b"1:http://img/a/moon.jpg").hexdigest()[:12]
    img = tmp_path / "images" / aid[:2] / aid
    img.mkdir(parents=True)
    (img / "moon.jpg").write_bytes(b"moon")
    common = ["--hq-root", str(tmp_path / "hq"), "--edge-root", str(tmp_path / "edge"),
              "--source-images", str(tmp_path / "images"), "--master", "local[2]"]
    env = {**os.environ, "PYTHONPATH": ROOT,
           "PYSPARK_SUBMIT_ARGS": "--conf spark.sql.shuffle.partitions=2 pyspark-shell"}

    def cli(*args):
        out = subprocess.run([sys.executable, "-m", "fieldlink", *args, *common], cwd=ROOT, capture_output=True,
                             text=True, timeout=300, env=env)
        assert out.returncode == 0, out.stderr[-2000:]
        return out.stdout

    run_hq = lambda: cli("hq", "--base", str(tmp_path / "p_hq"), "--peer-base", str(tmp_path / "p_edge"),
                         "--feed", str(tmp_path / "feed"), "--once")
    cli("pause", "--base", str(tmp_path / "p_hq"))
    run_hq()
    assert not list(tmp_path.glob("p_edge/replica/**/*.parquet"))
    cli("resume", "--base", str(tmp_path / "p_hq"))
    run_hq()
    assert list(tmp_path.glob("p_edge/replica/**/*.parquet"))
    cli("edge", "--base", str(tmp_path / "p_edge"), "--once")
    status = cli("status", "--base", str(tmp_path / "p_edge"))
    assert aid in status and "Moon" in status
    assert (tmp_path / "hq" / "downloadedAssets" / aid[:2] / aid / "moon.jpg").read_bytes() == b"moon"
