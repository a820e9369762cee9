"""Services and commands keep every row and file: each of these once lost some."""

import os
import subprocess
import sys

import pytest
from conftest import ROOT, rel
from pyspark.sql import functions as F

from fieldlink.config import Sites
from fieldlink.sources import documents, topics, volumes
from fieldlink.streaming import services as svc


def cli(*args, fail=False):
    out = subprocess.run([sys.executable, "-m", "fieldlink", *args, "--master", "local[4]"], cwd=ROOT, text=True,
                         capture_output=True, timeout=300, env={**os.environ, "PYTHONPATH": ROOT})
    assert (out.returncode != 0) == fail, out.stderr[-2000:]
    return out.stdout


def tree(root):
    return {os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names}


def test_mirror_copies_and_deletes_everything(tmp_path):
    sites = Sites(hq_root=str(tmp_path / "hq"), edge_root=str(tmp_path / "edge"))
    hq, edge = sites.hq_files, sites.edge_files
    for k in range(3000):
        d = os.path.join(hq, f"{k % 200:02x}")
        os.makedirs(d, exist_ok=True)
        open(os.path.join(d, f"f{k}.jpg"), "w").close()
    for name in ("_index.json", ".hidden", os.path.join("00", "_part"), os.path.join("00", ".keep")):
        open(os.path.join(hq, name), "w").write("x")
    os.makedirs(edge)
    for k in range(40):
        open(os.path.join(edge, f"stale{k}"), "w").close()
    args = ["mirror", "--base", str(tmp_path / "p"), "--hq-root", sites.hq_root, "--edge-root", sites.edge_root]
    out = cli(*args)
    assert tree(edge) == tree(hq) and len(tree(hq)) == 3004
    assert "copy: 3004 done" in out and "delete: 40 done" in out
    os.rename(hq, hq + "-gone")
    cli(*args, fail=True)  # a source that is not there deletes nothing
    assert len(tree(edge)) == 3004


def test_a_store_that_fails_is_not_an_absent_file(spark, tmp_path):
    df = spark.createDataFrame([(str(tmp_path / "none"),)], "path string")
    assert volumes.stat_files(df).count() == 0
    with pytest.raises(FileNotFoundError):
        volumes.list_volume(spark, str(tmp_path / "none"))
    assert volumes.list_volume(spark, str(tmp_path / "none"), missing_ok=True).count() == 0


def test_file_work_is_dealt_to_many_tasks(spark):
    plan = volumes.copy_files(spark.range(2000).select(F.col("id").cast("string").alias("src"), F.col("id").cast("string").alias("dst")))
    assert "REPARTITION_BY_NUM" in plan._jdf.queryExecution().toString()


def message(seq, value, topic):
    return (seq, None, "HQ", topic, None, value)


def rows(spark, layout, topic, values):
    from fieldlink.schemas import TOPIC_LOG

    df = spark.createDataFrame([message(k, v, topic) for k, v in enumerate(values, 1)], TOPIC_LOG)
    topics.write_topic(df, layout.topics, topic, batch_id=len(os.listdir(layout.topics)) if os.path.isdir(layout.topics) else 0)


def test_every_message_is_forwarded_or_a_dead_letter(spark, tmp_path):
    layout = svc.Layout(str(tmp_path / "hq"))
    good = '{"assetID":"a","title":"t","status":"success"}'
    rows(spark, layout, "IMAGE_DOWNLOAD", [good, "{not json", '{"assetID":"b","title":"t"}', '{"assetID":"c","status":"failed"}'])
    svc.start_broadcast_service(spark, layout).awaitTermination()
    for q in svc.start_deadletter_service(spark, layout, "HQ").values():
        q.awaitTermination()
    assert [r["seq"] for r in topics.read_topic(spark, layout.topics, "ASSET_BROADCAST").collect()] == [1]
    dead = spark.read.parquet(f"{layout.deadletter}/messages/IMAGE_DOWNLOAD").collect()
    assert {(r["seq"], r["reason"]) for r in dead} == {(2, "malformed"), (3, "no_status")}


def test_a_late_observation_is_a_dead_letter(spark, tmp_path):
    layout = svc.Layout(str(tmp_path / "edge"))
    captured = {}
    real = svc._start
    try:
        svc._start = lambda df, name, lay, sp, batch_fn=None, trigger=None, output_mode="append": captured.update(fn=batch_fn)
        svc.start_replica_monitor(spark, layout)
    finally:
        svc._start = real
    frame = lambda *x: spark.createDataFrame(list(x), "replica string, seq long, state string")
    captured["fn"](frame(("r", 9, "up")), 0)
    captured["fn"](frame(("r", 5, "down"), ("r", 10, "down")), 1)
    late = spark.read.parquet(f"{layout.deadletter}/replica").collect()
    assert [(r["seq"], r["reason"]) for r in late] == [(5, "late")]


def test_positions_live_with_the_site_and_are_not_silently_lost(spark, tmp_path):
    layout = svc.Layout(str(tmp_path / "hq"))
    good = '{"assetID":"a","title":"t","status":"success"}'
    seqs = lambda: sorted(r["seq"] for r in topics.read_topic(spark, layout.topics, "ASSET_BROADCAST").collect())
    rows(spark, layout, "IMAGE_DOWNLOAD", [good] * 2)
    svc.start_broadcast_service(spark, layout).awaitTermination()
    path = f"{layout.topics}/IMAGE_DOWNLOAD"
    from fieldlink.schemas import TOPIC_LOG

    spark.createDataFrame([message(k, good, "IMAGE_DOWNLOAD") for k in (3, 4)], TOPIC_LOG).write.mode("append").parquet(path)
    svc.start_broadcast_service(spark, svc.Layout(layout.base)).awaitTermination()
    assert seqs() == [1, 2, 3, 4]
    assert layout.checkpoint(spark, "asset_broadcast").startswith(layout.base)
    with pytest.raises(RuntimeError):
        svc.start_broadcast_service(spark, svc.Layout(layout.base, checkpoint_root=str(tmp_path / "elsewhere")))


def test_a_failed_copy_is_not_announced(spark, tmp_path):
    sites = Sites(hq_root=str(tmp_path / "hqroot"), edge_root=str(tmp_path / "edge"), source_images=str(tmp_path / "img"))
    layout = svc.Layout(str(tmp_path / "hq"), sites)
    src = os.path.join(sites.source_images, rel("abcd", "moon.jpg"))
    os.makedirs(os.path.dirname(src))
    open(src, "w").write("moon")
    os.makedirs(os.path.dirname(sites.download_dir), exist_ok=True)
    open(sites.download_dir, "w").close()  # a file where the folder should be: no copy can succeed
    change = spark.createDataFrame([("abcd", [{"title": "Moon", "description": "m", "item_id": "1"}],
                                     [{"href": "http://x/moon.jpg"}], None, None, 1, 0)], documents.DOCUMENT_CHANGE)
    documents.upsert(layout.documents, change, 0, producer="feed")
    rows(spark, layout, "IMAGEFEED", ['{"assetID":"abcd","title":"Moon"}'])
    svc.download_batch(spark, layout, topics.read_topic(spark, layout.topics, "IMAGEFEED"), 0)
    assert topics.read_topic(spark, layout.topics, "IMAGE_DOWNLOAD").count() == 0
    dead = spark.read.parquet(f"{layout.deadletter}/download").collect()
    assert [(r["assetID"], r["reason"]) for r in dead] == [("abcd", "store_failed")]


def test_a_hot_asset_shrinks_before_the_lookup(spark):
    docs = spark.createDataFrame([("hot", 1)], "_id string, v int")
    msgs = spark.range(1000).select(F.lit("hot").alias("assetID"))
    plan = documents.lookup(docs, msgs)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and documents.lookup(docs, msgs).count() == 1


def test_an_unchanged_item_keeps_its_location(spark, tmp_path):
    import json

    from fieldlink.sources import feed as feedsrc

    layout = svc.Layout(str(tmp_path / "hq"))
    item = lambda title: {"data": [{"title": title, "description": "d", "item_id": "1"}], "links": [{"href": "http://i/a.jpg"}]}
    (tmp_path / "feed").mkdir()

    def ingest(batch, title):
        (tmp_path / "feed/f.json").write_text(json.dumps({"collection": {"items": [item(title)]}}))
        svc.feed_batch(spark, layout, feedsrc.read_feed_files(spark, str(tmp_path / "feed")), batch)
        return documents.read_current(spark, layout.documents).collect()[0]

    first = ingest(0, "Moon")
    located = documents.read_changelog(spark, layout.documents).withColumn("imageDownloadLocation", F.lit("/at/a.jpg")) \
        .withColumn("rev", F.lit(1))
    documents.upsert(layout.documents, spark.createDataFrame(located.collect(), documents.DOCUMENT_CHANGE), 0, producer="download")
    assert first["imageDownloadLocation"] is None
    for _ in range(2):  # the second time as a retry
        assert ingest(1, "Moon")["imageDownloadLocation"] == "/at/a.jpg"
    assert ingest(2, "Mars")["imageDownloadLocation"] is None


def test_unknown_attributes_of_an_item_survive(spark, tmp_path):
    import hashlib
    import json
    import os

    from conftest import rel
    from fieldlink.config import Sites
    from fieldlink.sources import feed as feedsrc

    sites = Sites(hq_root=str(tmp_path / "h"), edge_root=str(tmp_path / "e"), source_images=str(tmp_path / "img"))
    layout = svc.Layout(str(tmp_path / "hq"), sites)
    item = {"data": [{"title": "Moon {1}", "description": "d", "item_id": "1", "keywords": ["a", {"b": 1.50}]}],
            "links": [{"href": "http://i/a/moon.jpg", "rel": "preview"}], "size": {"w": 10, "h": None}}
    aid = hashlib.sha256(b"1:http://i/a/moon.jpg").hexdigest()[:12]
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed/f.json").write_text(json.dumps({"collection": {"items": [item, "no object", {}]}}, indent=1))
    image = f"{sites.source_images}/{rel(aid, 'moon.jpg')}"
    os.makedirs(os.path.dirname(image))
    with open(image, "wb") as f:
        f.write(b"moon")
    svc.feed_batch(spark, layout, feedsrc.read_feed_files(spark, str(tmp_path / "feed")), 0)
    stored = lambda: [json.loads(r["document"]) for r in documents.whole(documents.read_current(spark, layout.documents)).collect()]
    assert stored() == [{**item, "_id": aid}]
    assert sorted(r["reason"] for r in spark.read.parquet(f"{layout.deadletter}/feed").collect()) == ["no_data", "no_data"]
    svc.download_batch(spark, layout, topics.read_topic(spark, layout.topics, "IMAGEFEED"), 0)
    after = stored()
    assert len(after) == 1 and after[0].pop("imageDownloadLocation").endswith("moon.jpg")
    assert after == [{**item, "_id": aid}]


def test_whole_document_without_its_text(spark):
    import json

    rows = [("a", [{"title": "t", "description": None, "item_id": "1"}], None, "/at", None), ("b", None, None, None, " { } ")]
    got = documents.whole(spark.createDataFrame(rows, documents.DOCUMENT)).collect()
    assert {r["_id"]: json.loads(r["document"]) for r in got} == {
        "a": {"data": [{"title": "t", "item_id": "1"}], "_id": "a", "imageDownloadLocation": "/at"}, "b": {"_id": "b"}}


def requested_site(spark, tmp_path):
    """An edge site whose asset ``abcd`` was broadcast and clicked."""
    from fieldlink.config import Sites

    layout = svc.Layout(str(tmp_path / "edge"), Sites(hq_root=str(tmp_path / "h"), edge_root=str(tmp_path / "e")))
    rows(spark, layout, "ASSET_BROADCAST", ['{"assetID":"abcd","title":"Moon","filename":"moon.jpg","status":"success"}'])
    click(spark, layout, 10, 0)
    svc.start_lifecycle_service(spark, layout, layout.topics).awaitTermination()
    return layout


def click(spark, layout, seq, batch):
    svc.record_clicks(spark, layout, spark.createDataFrame([(seq, "abcd")], "seq long, assetID string").withColumn(
        "ts", F.lit(None).cast("timestamp_ntz")), batch)


def test_requests_are_published_by_the_service_once(spark, tmp_path):
    layout = requested_site(spark, tmp_path)
    sent = lambda: sorted(r["seq"] for r in topics.read_topic(spark, layout.topics, "ASSET_REQUEST").collect())
    for _ in range(2):  # the state lags behind the first publication
        svc.start_request_service(spark, layout).awaitTermination()
        assert sent() == [10]
    svc.publish_requests(spark, layout, 99)
    assert sent() == [10]
    svc.start_lifecycle_service(spark, layout, layout.topics).awaitTermination()
    svc.publish_requests(spark, layout, 0)  # the service's batch as a retry, after the state has caught up
    assert sent() == [10]
    click(spark, layout, 20, 1)
    svc.start_lifecycle_service(spark, layout, layout.topics).awaitTermination()
    svc.start_request_service(spark, layout).awaitTermination()
    assert sent() == [10, 20]


def test_maintenance_folds_the_state_and_loses_nothing(spark, tmp_path):
    import os

    layout = requested_site(spark, tmp_path)
    for k in range(3):
        click(spark, layout, 20 + k, 1 + k)
        svc.start_lifecycle_service(spark, layout, layout.topics).awaitTermination()
    before = svc.current_asset_state(spark, layout).collect()
    for _ in range(2):
        svc.maintain(spark, layout)
        assert svc.current_asset_state(spark, layout).collect() == before
    assert len([n for n in os.listdir(layout.asset_state) if "=" in n]) < 4
    svc.start_request_service(spark, layout).awaitTermination()
    assert topics.read_topic(spark, layout.topics, "ASSET_REQUEST").count() == 1
