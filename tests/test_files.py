"""File jobs in a temp folder: listing, copy, mirror plan and apply, feed files, bad JSON."""

import json
import os

from pyspark.sql import functions as F

from fieldlink.operators import hq
from fieldlink.schemas import ASSET_MSG, TOPIC_LOG
from fieldlink.sources import feed as feedsrc
from fieldlink.sources import topics, volumes


def write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_listing_usage_and_zero_length(spark, tmp_path):
    root = str(tmp_path / "vol")
    write(f"{root}/a/x.jpg", b"12345")
    write(f"{root}/a/b/y.jpg", b"12")
    write(f"{root}/empty.jpg", b"")
    lst = volumes.list_volume(spark, root)
    got = sorted((r.path, r.length) for r in lst.collect())
    assert got == [(f"file:{root}/a/b/y.jpg", 2), (f"file:{root}/a/x.jpg", 5), (f"file:{root}/empty.jpg", 0)]
    assert all(r.modificationTime is not None for r in lst.collect())
    u = volumes.volume_usage({"v": lst}).first()
    assert (u.volume, u.n_files, u.bytes) == ("v", 3, 7)
    via_source = sorted(os.path.basename(r.path) for r in volumes.list_volume(spark, root, "binaryFile").collect())
    assert via_source == ["x.jpg", "y.jpg"]  # Spark's file source leaves zero-length files out


def test_copy_files_overwrites_and_reports(spark, tmp_path):
    src = str(tmp_path / "src")
    write(f"{src}/a.jpg", b"new")
    write(str(tmp_path / "dst/a.jpg"), b"old-content")
    m = spark.createDataFrame([(f"{src}/a.jpg", str(tmp_path / "dst/a.jpg")),
                               (f"{src}/a.jpg", str(tmp_path / "dst/a.jpg")),  # duplicate: copied once
                               (f"{src}/missing.jpg", str(tmp_path / "dst/m.jpg"))], "src string, dst string")
    res = {r.dst: r for r in volumes.copy_files(m).collect()}
    assert len(res) == 2
    assert res[str(tmp_path / "dst/a.jpg")].ok
    assert not res[str(tmp_path / "dst/m.jpg")].ok and "FileNotFound" in res[str(tmp_path / "dst/m.jpg")].error
    assert open(tmp_path / "dst/a.jpg", "rb").read() == b"new"


def test_mirror_diff_and_apply(spark, tmp_path):
    s, d = str(tmp_path / "hq"), str(tmp_path / "edge")
    write(f"{s}/1/a.jpg", b"aaa")          # copy
    write(f"{s}/2/b.jpg", b"bbbb")         # refresh (length differs)
    write(f"{d}/2/b.jpg", b"bb")
    write(f"{s}/3/c.jpg", b"c")            # same
    write(f"{d}/3/c.jpg", b"c")
    os.utime(f"{d}/3/c.jpg", (os.path.getmtime(f"{s}/3/c.jpg") + 10,) * 2)
    write(f"{d}/4/gone.jpg", b"g")         # delete
    write(f"{s}/5/empty.jpg", b"")         # copy (a zero-length file is a file too)
    plan = volumes.mirror_diff(volumes.list_volume(spark, s), s, volumes.list_volume(spark, d), d)
    got = {r.rel_path: r.action for r in plan.collect()}
    assert got == {"1/a.jpg": "copy", "2/b.jpg": "refresh", "4/gone.jpg": "delete", "5/empty.jpg": "copy"}
    res = volumes.mirror_apply(plan, d, s).collect()
    assert all(r.ok for r in res) and len(res) == 4
    again = volumes.mirror_diff(volumes.list_volume(spark, s), s, volumes.list_volume(spark, d), d)
    assert again.count() == 0  # mirror now equals the source
    assert not os.path.exists(f"{d}/4/gone.jpg")


def test_feed_file_with_incomplete_items(spark, tmp_path):
    feed = {"collection": {"version": "1.0", "items": [
        {"data": [{"title": "Moon", "description": "m", "item_id": "1", "center": "X"}],
         "links": [{"href": "http://img/a/moon.jpg", "rel": "preview"}]},
        {"data": [{"title": "Mars", "description": "r", "item_id": "2"}], "links": [{"href": "http://img/b/mars.jpg?x=1"}]},
        {"data": [], "links": [{"href": "http://img/c.jpg"}]},
        {"data": [{"title": "NoLink", "description": "n", "item_id": "4"}], "links": []},
    ]}}
    write(str(tmp_path / "feed/f1.json"), json.dumps(feed, indent=2).encode())
    norm = hq.normalize_feed(feedsrc.explode_items(feedsrc.read_feed_files(spark, str(tmp_path / "feed"))))
    rows = {r.title: r for r in norm.collect()}
    assert rows["Mars"].filename == "mars.jpg?x=1"  # query string kept, as the reference does
    assert {r.reason for r in norm.collect()} == {None, "no_data", "no_link"}
    msgs = hq.feed_messages(norm).collect()
    assert sorted(m.title for m in msgs) == ["Mars", "Moon"]
    assert {m.tablename for m in msgs} == {"imagesTable"} and {m.messageCreatorID for m in msgs} == {"ezshow"}


def test_malformed_line_goes_to_dead_letter(spark, tmp_path):
    good = json.dumps({"title": "t", "description": "d", "filename": "f", "assetID": "a1", "status": "success"})
    rows = [(1, None, "HQ", "IMAGE_DOWNLOAD", "a1", good), (2, None, "HQ", "IMAGE_DOWNLOAD", "a2", good[:-3]),
            (3, None, "HQ", "IMAGE_DOWNLOAD", "a3", good.replace("success", "failed"))]
    log = spark.createDataFrame(rows, TOPIC_LOG)
    base = str(tmp_path / "topics")
    topics.write_topic(log, base, "IMAGE_DOWNLOAD")
    back = topics.read_topic(spark, base, "IMAGE_DOWNLOAD")
    ok = topics.consume(back, "IMAGE_DOWNLOAD", ASSET_MSG)
    bad = topics.malformed(back, {"IMAGE_DOWNLOAD": ASSET_MSG})
    assert sorted(r.seq for r in ok.collect()) == [1, 3]
    assert [r.seq for r in bad.collect()] == [2]
    assert [r.seq for r in hq.asset_broadcast(ok).collect()] == [1]


def test_replicate_prevents_loops_and_dedupes(spark):
    rows = lambda origin, seqs: [(s, None, origin, "T", None, "{}") for s in seqs]
    hq_log = spark.createDataFrame(rows("HQ", [1, 2]) + rows("EDGE", [7]), TOPIC_LOG)    # 7 came back from EDGE
    edge_log = spark.createDataFrame(rows("EDGE", [7, 8, 8]) + rows("HQ", [1]), TOPIC_LOG)  # 8 delivered twice
    out = topics.replicate({"HQ": hq_log, "EDGE": edge_log})
    got = sorted((r.site, r.origin, r.seq) for r in out.collect())
    want = sorted([(s, o, q) for s in ("HQ", "EDGE") for o, q in [("HQ", 1), ("HQ", 2), ("EDGE", 7), ("EDGE", 8)]])
    assert got == want


def test_expire_keeps_recent(spark):
    from datetime import datetime

    rows = [(1, datetime(2024, 1, 1, 0, 0), "HQ", "T", None, "{}"), (2, datetime(2024, 1, 1, 10, 0), "HQ", "T", None, "{}"),
            (3, datetime(2024, 1, 1, 12, 0), "HQ", "T", None, "{}")]
    log = spark.createDataFrame(rows, TOPIC_LOG)
    assert sorted(r.seq for r in topics.expire(log, 38400).collect()) == [2, 3]
    assert sorted(r.seq for r in topics.expire(log, 3600, now=F.lit(datetime(2024, 1, 1, 12, 30))).collect()) == [3]


def test_read_files_only_wanted(spark, tmp_path):
    write(str(tmp_path / "v/a.jpg"), b"A")
    write(str(tmp_path / "v/b.jpg"), b"BB")
    wanted = spark.createDataFrame([(str(tmp_path / "v/a.jpg"),), (str(tmp_path / "v/zz.jpg"),)], "path string")
    got = {os.path.basename(r.path): r.content for r in volumes.read_files(wanted).collect()}
    assert got == {"a.jpg": b"A", "zz.jpg": None}


def test_compact_expired(spark, tmp_path):
    from datetime import datetime

    rows = [(1, datetime(2024, 1, 1, 0, 0), "HQ", "T", None, "{}"), (2, datetime(2024, 1, 2, 0, 0), "HQ", "T", None, "{}")]
    base, out = str(tmp_path / "t"), str(tmp_path / "t2")
    topics.write_topic(spark.createDataFrame(rows, TOPIC_LOG), base, "T")
    topics.compact_expired(spark, base, "T", out, 3600)
    assert [r.seq for r in topics.read_topic(spark, out, "T").collect()] == [2]


def test_catalog_init_and_drop(spark, tmp_path):
    from fieldlink.config import Sites
    from fieldlink.sources import catalog
    from fieldlink.streaming.services import Layout

    sites = Sites(hq_root=str(tmp_path / "hq"), edge_root=str(tmp_path / "edge"))
    hqL, edL = Layout(str(tmp_path / "p_hq"), sites), Layout(str(tmp_path / "p_edge"), sites)
    catalog.init_catalog(spark, hqL, "fl_test_hq", ["IMAGEFEED"])
    catalog.init_catalog(spark, hqL, "fl_test_hq", ["IMAGEFEED"])  # already there: no error
    assert os.path.isdir(f"{hqL.topics}/IMAGEFEED")
    assert spark.table("fl_test_hq.topic_imagefeed").count() == 0
    catalog.init_catalog(spark, edL, "fl_test_edge")
    catalog.drop_catalog(spark, [edL], "fl_test_edge")
    catalog.drop_catalog(spark, [hqL], "fl_test_hq")
    assert not os.path.exists(hqL.base) and not os.path.exists(edL.base)


def test_drop_takes_positions_and_volumes(spark, tmp_path):
    """Positions that are kept elsewhere and HQ's files go too; the source images stay."""
    from fieldlink.config import Sites
    from fieldlink.sources import catalog
    from fieldlink.streaming.services import Layout

    sites = Sites(hq_root=str(tmp_path / "hq"), edge_root=str(tmp_path / "edge"), source_images=str(tmp_path / "images"))
    hqL, edL = (Layout(str(tmp_path / n), sites, str(tmp_path / "ck")) for n in ("p_hq", "p_edge"))
    for layout in (edL, hqL):
        catalog.init_catalog(spark, layout, "fl_test_drop", ["IMAGEFEED"])
        layout.checkpoint(spark, "image_feed")
    write(f"{sites.source_images}/a.jpg", b"1")
    write(f"{sites.hq_files}/a.jpg", b"1")
    catalog.drop_catalog(spark, [edL], "fl_test_drop")
    assert os.path.exists(f"{sites.hq_files}/a.jpg") and os.path.exists(hqL.positions) and not os.path.exists(edL.positions)
    catalog.drop_catalog(spark, [edL, hqL], "fl_test_drop", hq_volumes=True)
    assert not os.path.exists(hqL.positions) and not os.path.exists(sites.hq_files) and not os.path.exists(sites.download_dir)
    assert os.listdir(sites.source_images) == ["a.jpg"]


def test_broadcast_deadletter_for_missing_status(spark):
    rows = [(1, "a", "success"), (2, "b", None), (3, "c", "failed")]
    df = spark.createDataFrame(rows, "seq long, assetID string, status string")
    assert [r.seq for r in hq.asset_broadcast(df).collect()] == [1]
    assert [(r.seq, r.reason) for r in hq.broadcast_deadletter(df).collect()] == [(2, "no_status")]


def test_flat_layout_collides_by_asset_does_not(spark):
    from fieldlink.config import LAYOUT_BY_ASSET, LAYOUT_FLAT, Sites

    docs_rows = [("a1", [("t", "d", None)], [("http://x/1/img.jpg",)], "/dl/a1/img.jpg", None),
                 ("a2", [("t", "d", None)], [("http://x/2/img.jpg",)], "/dl/a2/img.jpg", None)]
    docs_df = spark.createDataFrame(docs_rows, "_id string, data array<struct<title:string,description:string,"
                                               "item_id:string>>, links array<struct<href:string>>, "
                                               "imageDownloadLocation string, extra string")
    reqs = spark.createDataFrame([(1, None, "a1", "t"), (2, None, "a2", "t")],
                                 "seq long, ts timestamp_ntz, assetID string, title string")
    def dsts(**kw):
        return {r.dst for r in hq.response_copies(hq.asset_response(reqs, docs_df, Sites(hq_root="/hq", **kw))).collect()}

    assert dsts() == {"/hq/files/a1/a1/img.jpg", "/hq/files/a2/a2/img.jpg"}  # default: sharded by asset id
    assert dsts(layout=LAYOUT_BY_ASSET) == {"/hq/files/a1/img.jpg", "/hq/files/a2/img.jpg"}
    flat = dsts(layout=LAYOUT_FLAT)
    assert flat == {"/hq/files/img.jpg"}  # the reference's behaviour: both assets land on one path


def test_file_present_ignores_scheme(spark):
    wanted = spark.createDataFrame([("hdfs://nn:8020/v/a.jpg",), ("/v/b.jpg",)], "p string")
    listing = spark.createDataFrame([("file:/v/a.jpg",), ("hdfs://nn:8020/v/b.jpg",)], "path string")
    got = {r.p: r.present for r in volumes.file_present(wanted, listing, "p").collect()}
    assert got == {"hdfs://nn:8020/v/a.jpg": True, "/v/b.jpg": True}


def test_malformed_feed_file_goes_to_dead_letter(spark, tmp_path):
    good = {"collection": {"items": [{"data": [{"title": "Moon", "description": "m", "item_id": "1"}],
                                      "links": [{"href": "http://img/a/moon.jpg"}]}]}}
    write(str(tmp_path / "feed/good.json"), json.dumps(good).encode())
    write(str(tmp_path / "feed/bad.json"), b'{"collection": {"items": [ {"data": ')
    files = feedsrc.read_feed_files(spark, str(tmp_path / "feed"))
    items = feedsrc.explode_items(files).collect()
    assert [i.item.data[0].title for i in items] == ["Moon"]
    bad = feedsrc.bad_feed_files(files).collect()
    assert [(os.path.basename(b.file), b.reason, b.parsed) for b in bad] == [("bad.json", "malformed_json", False)]


def test_kafka_topics_are_gated(spark):
    import pytest

    with pytest.raises(RuntimeError, match="Kafka connector"):
        topics.read_topic_kafka(spark, "localhost:1", "IMAGEFEED", "HQ")


def test_stat_files_only_existing(spark, tmp_path):
    write(str(tmp_path / "v/a.jpg"), b"abc")
    write(str(tmp_path / "v/e.jpg"), b"")
    paths = spark.createDataFrame([(str(tmp_path / "v/a.jpg"),), (str(tmp_path / "v/e.jpg"),),
                                   (str(tmp_path / "v/none.jpg"),), (str(tmp_path / "v/a.jpg"),)], "path string")
    got = sorted((r.path, r.length) for r in volumes.stat_files(paths).collect())
    assert got == [(f"file:{tmp_path}/v/a.jpg", 3), (f"file:{tmp_path}/v/e.jpg", 0)]
