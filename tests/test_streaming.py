"""Services as streams on temp folders: the whole HQ -> EDGE -> HQ round trip,
batch/stream parity, idempotence and restart."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from fieldlink.config import Sites
from fieldlink.operators import hq
from fieldlink.schemas import ASSET_MSG, IMAGEFEED_MSG
from fieldlink.sources import feed as feedsrc
from fieldlink.sources import topics
from fieldlink.sources import volumes
from fieldlink.streaming import services as svc
from conftest import rel


def aid(item_id, href):
    return hashlib.sha256(f"{item_id}:{href}".encode()).hexdigest()[:12]


def write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def feed_file(path, items):
    body = {"collection": {"items": [
        {"data": ([{"title": t, "description": f"about {t}", "item_id": i}] if t else []),
         "links": [{"href": h}]} for i, t, h in items]}}
    write(path, json.dumps(body).encode())


def run(q):
    q.awaitTermination()
    assert q.exception() is None


@pytest.fixture()
def env(spark, tmp_path):
    sites = Sites(hq_root=str(tmp_path / "hq"), edge_root=str(tmp_path / "edge"),
                  source_images=str(tmp_path / "images"))
    ck = str(tmp_path / "ckpt")
    hqL = svc.Layout(str(tmp_path / "pipe_hq"), sites, ck)
    edL = svc.Layout(str(tmp_path / "pipe_edge"), sites, ck)
    return sites, hqL, edL, tmp_path


def topic_rows(spark, base, topic, schema=ASSET_MSG):
    return topics.consume(topics.read_topic(spark, base, topic), topic, schema)


def test_round_trip(spark, env):
    sites, hqL, edL, tmp = env
    items = [("1", "Moon", "http://img/a/moon.jpg"), ("2", "Mars", "http://img/b/mars.jpg"),
             ("3", "Venus", "http://img/c/venus.jpg"), ("4", None, "http://img/d/none.jpg")]
    ids = {t: aid(i, h) for i, t, h in items if t}
    write(f"{sites.source_images}/{rel(ids['Moon'], 'moon.jpg')}", b"moon-bytes")
    write(f"{sites.source_images}/{rel(ids['Mars'], 'mars.jpg')}", b"mars-bytes")   # Venus has no source file
    feed_file(str(tmp / "feed/f1.json"), items)

    run(svc.start_feed_service(spark, hqL, str(tmp / "feed")))
    assert topic_rows(spark, hqL.topics, "IMAGEFEED", __import__("fieldlink.schemas", fromlist=["x"]).IMAGEFEED_MSG).count() == 3
    run(svc.start_download_service(spark, hqL))
    docs_now = {r._id: r.imageDownloadLocation for r in svc.documents_now(spark, hqL).collect()}
    assert docs_now[ids["Moon"]] == f"{sites.download_dir}/{rel(ids['Moon'], 'moon.jpg')}"
    assert docs_now[ids["Venus"]] is None
    assert open(docs_now[ids["Moon"]], "rb").read() == b"moon-bytes"
    dl = {r.assetID: r.status for r in topic_rows(spark, hqL.topics, "IMAGE_DOWNLOAD").collect()}
    assert dl == {ids["Moon"]: "success", ids["Mars"]: "success"}
    dead = spark.read.parquet(f"{hqL.deadletter}/download").collect()
    assert [(r.assetID, r.reason) for r in dead] == [(ids["Venus"], "file_missing")]

    run(svc.start_broadcast_service(spark, hqL))
    run(svc.start_broadcast_service(spark, hqL))  # nothing new: nothing added
    assert topic_rows(spark, hqL.topics, "ASSET_BROADCAST").count() == 2

    run(svc.start_replication(spark, hqL, edL, "ASSET_BROADCAST", "HQ"))
    svc.record_clicks(spark, edL, spark.createDataFrame(
        [(10 ** 15, ids["Moon"])], "seq long, assetID string").withColumn("ts", F.lit(None).cast("timestamp_ntz")), 0)
    run(svc.start_lifecycle_service(spark, edL, edL.replica))
    table = {r.assetID: r.status for r in svc.asset_table(spark, edL).collect()}
    assert table == {ids["Moon"]: "requesting...", ids["Mars"]: "!"}

    published = svc.publish_requests(spark, edL, 0)
    assert [r.assetID for r in published.collect()] == [ids["Moon"]]
    run(svc.start_lifecycle_service(spark, edL, edL.replica))
    assert {r.assetID: r.status for r in svc.asset_table(spark, edL).collect()}[ids["Moon"]] == "requested"

    run(svc.start_replication(spark, edL, hqL, "ASSET_REQUEST", "EDGE"))
    run(svc.start_response_service(spark, hqL, request_topics=hqL.replica))
    copied = f"{sites.hq_files}/{rel(ids['Moon'], 'moon.jpg')}"
    assert open(copied, "rb").read() == b"moon-bytes"

    plan = volumes.mirror_diff(volumes.list_volume(spark, sites.hq_files), sites.hq_files,
                               volumes.list_volume(spark, sites.edge_files), sites.edge_files)
    assert all(r.ok for r in volumes.mirror_apply(plan, sites.edge_files, sites.hq_files).collect())
    table = {r.assetID: r.status for r in svc.asset_table(spark, edL).collect()}
    assert table == {ids["Moon"]: "received", ids["Mars"]: "!"}

    from fieldlink.operators import activity
    tiles = svc.site_tiles(spark, hqL, edL)
    by_service = {}
    for r in tiles.collect():
        by_service.setdefault(r.service, []).append(r)
    assert {k: len(v) for k, v in by_service.items()} == {
        "IMAGE Feed Service": 3, "Image Download Service": 2, "Asset Broadcast Service": 2,
        "Asset Response Service": 1, "Asset Viewer Service": 1}
    assert by_service["Asset Viewer Service"][0].image_url == f"{sites.edge_files}/{rel(ids['Moon'], 'moon.jpg')}"
    newest = activity.newest(tiles, 3).collect()
    assert len(newest) == 3 and newest[0].seq >= newest[-1].seq

    # restart: a new feed file is the only thing processed
    feed_file(str(tmp / "feed/f2.json"), [("9", "Io", "http://img/e/io.jpg")])
    run(svc.start_feed_service(spark, hqL, str(tmp / "feed")))
    assert {r.title for r in topic_rows(spark, hqL.topics, "IMAGEFEED",
                                        __import__("fieldlink.schemas", fromlist=["x"]).IMAGEFEED_MSG).collect()} \
        == {"Moon", "Mars", "Venus", "Io"}


def test_broadcast_stream_equals_batch(spark, env):
    _sites, hqL, _edL, _tmp = env
    import __spark_entry__ as E  # noqa: F401
    from fieldlink.plans import fixtures as fix

    log = fix.topic_log(spark, "/root/testdata/sf0.001", topics=["IMAGE_DOWNLOAD"])
    first, second = log.filter("seq % 2 = 0"), log.filter("seq % 2 = 1")
    topics.write_topic(first, hqL.topics, "IMAGE_DOWNLOAD", batch_id=0)
    run(svc.start_broadcast_service(spark, hqL))
    topics.write_topic(second, hqL.topics, "IMAGE_DOWNLOAD", batch_id=1)
    run(svc.start_broadcast_service(spark, hqL))
    streamed = sorted(r.seq for r in topic_rows(spark, hqL.topics, "ASSET_BROADCAST").collect())
    batch = sorted(r.seq for r in hq.asset_broadcast(topics.consume(log, "IMAGE_DOWNLOAD", ASSET_MSG)).collect())
    assert streamed == batch and len(batch) > 0


def test_dedupe_and_counters_streams(spark, env):
    from datetime import datetime

    from fieldlink.schemas import TOPIC_LOG

    _sites, hqL, edL, tmp = env
    row = lambda seq, origin: (seq, datetime(2024, 1, 1, 0, 0, seq), origin, "ASSET_BROADCAST", "a", "{}")
    topics.write_topic(spark.createDataFrame([row(1, "HQ"), row(2, "HQ")], TOPIC_LOG), edL.topics, "ASSET_BROADCAST", 0)
    topics.write_topic(spark.createDataFrame([row(1, "HQ"), row(3, "EDGE")], TOPIC_LOG), edL.replica, "ASSET_BROADCAST", 0)
    q = (svc.site_topic_stream(spark, edL, "ASSET_BROADCAST").writeStream.format("memory").queryName("dedupe_view")
         .option("checkpointLocation", str(tmp / "ck_dedupe")).trigger(availableNow=True).start())
    run(q)
    assert sorted(r.seq for r in spark.table("dedupe_view").collect()) == [1, 2, 3]

    run(svc.start_counters_service(spark, edL, {"Broadcast Listener": "ASSET_BROADCAST", "Asset Request": "ASSET_REQUEST"}))
    topics.write_topic(spark.createDataFrame([row(4, "HQ")], TOPIC_LOG), edL.topics, "ASSET_BROADCAST", 1)
    run(svc.start_counters_service(spark, edL, {"Broadcast Listener": "ASSET_BROADCAST", "Asset Request": "ASSET_REQUEST"}))
    assert {r.service: r.n for r in svc.current_counters(spark, edL).collect()} == {"Broadcast Listener": 3}


def test_site_runner_stop_and_resume(spark, env):
    sites, hqL, _edL, tmp = env
    iid, href = "1", "http://img/a/moon.jpg"
    write(f"{sites.source_images}/{rel(aid(iid, href), 'moon.jpg')}", b"m")
    feed_file(str(tmp / "feed/f1.json"), [(iid, "Moon", href)])
    trig = {"processingTime": "1 second"}
    qs = svc.start_hq(spark, hqL, str(tmp / "feed"), trig)
    for name in ("image_feed", "image_download", "asset_broadcast", "image_download", "asset_broadcast"):
        qs[name].processAllAvailable()
    status = {s["service"]: s for s in svc.service_status(qs)}
    assert all(s["active"] for s in status.values()) and status["image_feed"]["batch"] is not None
    svc.stop_all(qs)
    assert not any(s["active"] for s in svc.service_status(qs))
    assert topic_rows(spark, hqL.topics, "ASSET_BROADCAST").count() == 1
    qs = svc.start_hq(spark, hqL, str(tmp / "feed"), trig)  # resume from checkpoints: nothing is redone
    for q in qs.values():
        q.processAllAvailable()
    svc.stop_all(qs)
    assert topic_rows(spark, hqL.topics, "ASSET_BROADCAST").count() == 1
    assert topic_rows(spark, hqL.topics, "IMAGE_DOWNLOAD").count() == 1


def test_download_sees_documents_written_after_start(spark, env):
    """Within one running query, a document written later is found (re-read per batch)."""
    from fieldlink.schemas import IMAGEFEED_MSG
    from fieldlink.sources import documents as docs

    sites, hqL, _edL, tmp = env
    schema = ("_id string, data array<struct<title:string,description:string,item_id:string>>, "
              "links array<struct<href:string>>, imageDownloadLocation string, extra string, seq long, rev int")

    def doc_and_msg(n, seq, batch):
        a = f"asset{n:07d}"
        write(f"{sites.source_images}/{rel(a, f'p{n}.jpg')}", b"x")
        docs.upsert(hqL.documents, spark.createDataFrame(
            [(a, [(f"T{n}", "d", None)], [(f"http://h/p{n}.jpg",)], None, None, seq, 0)], schema), batch, "test")
        msg = spark.createDataFrame([(seq, a, f"T{n}")], "seq long, assetID string, title string") \
            .withColumn("ts", F.lit(None).cast("timestamp_ntz")).withColumn("description", F.lit("d")) \
            .withColumn("tablename", F.lit("imagesTable")).withColumn("messageCreatorID", F.lit("ezshow"))
        topics.write_topic(topics.encode(msg, "IMAGEFEED", ["title", "description", "tablename", "assetID",
                                                            "messageCreatorID"], "HQ"), hqL.topics, "IMAGEFEED", batch)
        return a

    a1 = doc_and_msg(1, 1, 0)
    q = svc.start_download_service(spark, hqL, {"processingTime": "1 second"})
    q.processAllAvailable()
    a2 = doc_and_msg(2, 2, 1)  # document and message arrive after the query started
    q.processAllAvailable()
    q.stop()
    got = {r.assetID: r.status for r in topic_rows(spark, hqL.topics, "IMAGE_DOWNLOAD").collect()}
    assert got == {a1: "success", a2: "success"}
    assert IMAGEFEED_MSG is not None


def test_replica_monitor_stream_equals_batch(spark, env):
    from fieldlink.operators import monitor
    from fieldlink.plans import fixtures as fix
    from fieldlink.schemas import REPLICA_INFO_MSG

    sites, hqL, _edL, _tmp = env
    log = fix.topic_log(spark, "/root/testdata/sf0.001", sites, topics=["REPLICA_INFO"])
    topics.write_topic(log.filter("seq < 500"), hqL.topics, "REPLICA_INFO", 0)
    run(svc.start_replica_monitor(spark, hqL))
    topics.write_topic(log.filter("seq >= 500"), hqL.topics, "REPLICA_INFO", 1)
    run(svc.start_replica_monitor(spark, hqL))
    streamed = sorted(tuple(r) for r in spark.read.option("recursiveFileLookup", "true")
                      .parquet(f"{hqL.base}/replica_changes")
                      .select("replica", "seq", "state", "prev_state").collect())
    obs = monitor.replica_observations(topics.consume(log, "REPLICA_INFO", REPLICA_INFO_MSG), sites)
    batch = sorted(tuple(r) for r in monitor.replica_state_changes(obs)
                   .select("replica", "seq", "state", "prev_state").collect())
    assert streamed == batch and len(batch) > 0


def test_audit_and_mirror_lag_streams_equal_batch(spark, env):
    from fieldlink.operators import monitor
    from fieldlink.plans import fixtures as fix
    from fieldlink.schemas import AUDIT_MSG, VOLUME_INFO_MSG

    sites, hqL, _edL, _tmp = env
    log = fix.topic_log(spark, "/root/testdata/sf0.001", sites, topics=["AUDIT", "VOLUME_INFO"])
    for t in ("AUDIT", "VOLUME_INFO"):
        topics.write_topic(log.filter(f"topic = '{t}' AND seq < 600"), hqL.topics, t, 0)
    run(svc.start_audit_listener(spark, hqL))
    run(svc.start_mirror_lag_service(spark, hqL))
    for t in ("AUDIT", "VOLUME_INFO"):
        topics.write_topic(log.filter(f"topic = '{t}' AND seq >= 600"), hqL.topics, t, 1)
    run(svc.start_audit_listener(spark, hqL))
    run(svc.start_mirror_lag_service(spark, hqL))
    audit_s = sorted(tuple(r) for r in spark.read.parquet(f"{hqL.base}/audit").collect())
    audit_b = sorted(tuple(r) for r in monitor.audit_replication(
        topics.consume(log, "AUDIT", AUDIT_MSG), sites).collect())
    assert audit_s == audit_b and any(r[3] for r in audit_b)
    lag_s = sorted(tuple(r) for r in svc.current_mirror_lag(spark, hqL).collect())
    lag_b = sorted(tuple(r) for r in monitor.mirror_lag(topics.consume(log, "VOLUME_INFO", VOLUME_INFO_MSG)).collect())
    assert lag_s == lag_b and len(lag_b) > 0


def test_compact_state_keeps_newest(spark, tmp_path):
    path = str(tmp_path / "state")
    for b, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)], [("c", 5)], [("c", 6)]]):
        spark.createDataFrame(rows, "assetID string, v long").withColumn("batch", F.lit(b).cast("bigint")) \
            .write.parquet(f"{path}/batch={b}")
    before = sorted(tuple(r) for r in svc._latest_by_batch(spark.read.option("recursiveFileLookup", "true")
                                                            .parquet(path), "assetID").drop("batch").collect())
    now = lambda: sorted(tuple(r) for r in svc._latest_by_batch(
        svc.read_state(spark, path), "assetID").drop("batch").collect())
    svc.compact_state(spark, path, "assetID")
    # Folded folders stay until the next call finds the fold complete; the newest is left alone.
    assert sorted(os.listdir(path)) == ["batch=0", "batch=1", "batch=2", "batch=3", "fold=2"]
    assert before == now() == [("a", 2), ("b", 1), ("c", 6)]
    svc.compact_state(spark, path, "assetID")
    assert sorted(os.listdir(path)) == ["batch=3", "fold=2"]
    assert now() == before


def test_lifecycle_state_table_equals_batch_and_expires(spark, env):
    from fieldlink.operators import edge
    from fieldlink.plans import fixtures as fix
    from fieldlink.schemas import ASSET_MSG as AM

    sites, _hqL, edL, _tmp = env
    d = "/root/testdata/sf0.001"
    log = fix.topic_log(spark, d, sites, topics=["ASSET_BROADCAST"])
    clicks, pubs = fix.clicks(spark, d), fix.request_publications(spark, d)
    for i, cond in enumerate(["seq < 400", "seq >= 400 AND seq < 800", "seq >= 800"]):
        topics.write_topic(log.filter(cond), edL.replica, "ASSET_BROADCAST", i)
        svc.record_clicks(spark, edL, clicks.filter(cond), i)
        svc._write_batch(pubs.filter(cond), edL.publications, i)
        run(svc.start_lifecycle_service(spark, edL, edL.replica))
    streamed = sorted(tuple(r) for r in svc.current_asset_state(spark, edL)
                      .select("assetID", "_b.seq", "c_seq", "_p.seq").collect())
    batch = sorted(tuple(r) for r in edge.lifecycle_state(topics.consume(log, "ASSET_BROADCAST", AM), clicks, pubs)
                   .filter("_b IS NOT NULL OR c_seq IS NOT NULL OR _p IS NOT NULL")
                   .select("assetID", "_b.seq", "c_seq", "_p.seq").collect())
    assert streamed == batch and len(batch) > 0
    before = spark.read.option("recursiveFileLookup", "true").parquet(
        f"{edL.asset_state}/batch=0", f"{edL.asset_state}/batch=1")
    assert before.filter("_b IS NULL").count() > 0  # clicks on assets never broadcast
    svc.compact_state(spark, edL.asset_state, "assetID", keep=F.col("_b").isNotNull())
    assert sorted(os.listdir(edL.asset_state)) == ["batch=0", "batch=1", "batch=2", "fold=1"]
    folded = spark.read.parquet(f"{edL.asset_state}/fold=1")
    assert folded.count() > 0 and folded.filter("_b IS NULL").count() == 0


def test_retried_batches_leave_the_same_output(spark, env):
    """A micro-batch run twice with the same id (a retry) rewrites its folders: nothing doubles."""
    from fieldlink.schemas import IMAGEFEED_MSG
    from fieldlink.sources import documents as docs

    sites, hqL, _edL, tmp = env
    items = [("1", "Moon", "http://img/a/moon.jpg"), ("2", "Mars", "http://img/b/mars.jpg")]
    for i, t, h in items:
        write(f"{sites.source_images}/{rel(aid(i, h), h.rsplit('/', 1)[1])}", b"x")
    feed_file(str(tmp / "feed/f1.json"), items)
    from fieldlink.sources import feed as feedsrc

    files = feedsrc.read_feed_files(spark, str(tmp / "feed"))
    for _ in range(2):
        svc.feed_batch(spark, hqL, files, 0)
    feed_msgs = topics.read_topic(spark, hqL.topics, "IMAGEFEED")
    assert feed_msgs.count() == 2
    for _ in range(2):
        svc.download_batch(spark, hqL, feed_msgs, 0)
    assert topic_rows(spark, hqL.topics, "IMAGE_DOWNLOAD").count() == 2
    assert docs.read_changelog(spark, hqL.documents).count() == 4  # 2 feed versions + 2 location updates
    assert {r.imageDownloadLocation is not None for r in docs.read_current(spark, hqL.documents).collect()} == {True}
    assert topics.consume(feed_msgs, "IMAGEFEED", IMAGEFEED_MSG).count() == 2


def test_site_topic_batch_view_drops_duplicates(spark, env):
    from datetime import datetime

    from fieldlink.schemas import TOPIC_LOG

    _sites, _hqL, edL, _tmp = env
    row = lambda seq, origin: (seq, datetime(2024, 1, 1), origin, "ASSET_REQUEST", "a", "{}")
    topics.write_topic(spark.createDataFrame([row(1, "EDGE"), row(2, "EDGE")], TOPIC_LOG), edL.topics,
                       "ASSET_REQUEST", 0)
    topics.write_topic(spark.createDataFrame([row(5, "HQ"), row(5, "HQ"), row(6, "HQ")], TOPIC_LOG), edL.replica,
                       "ASSET_REQUEST", 0)
    got = sorted((r.origin, r.seq) for r in svc.site_topic(spark, edL, "ASSET_REQUEST").collect())
    assert got == [("EDGE", 1), ("EDGE", 2), ("HQ", 5), ("HQ", 6)]


def test_counters_of_all_services_and_retries(spark, env):
    """Every service counts what it emitted, once per batch however often the batch runs; malformed rows count nowhere."""
    from fieldlink.schemas import TOPIC_LOG

    sites, hqL, edL, tmp = env
    items = [("1", "Moon", "http://img/a/moon.jpg"), ("2", "Mars", "http://img/b/mars.jpg"), ("3", "Venus", "http://img/c/venus.jpg")]
    ids = {t: aid(i, h) for i, t, h in items}
    for t, f in (("Moon", "moon.jpg"), ("Mars", "mars.jpg")):
        write(f"{sites.source_images}/{rel(ids[t], f)}", t.encode())
    feed_file(str(tmp / "feed/f1.json"), items)
    bad = lambda topic: spark.createDataFrame([(7, None, "HQ", topic, None, "{no json")], TOPIC_LOG)
    run(svc.start_feed_service(spark, hqL, str(tmp / "feed")))
    topics.write_topic(bad("IMAGEFEED"), hqL.topics, "IMAGEFEED", 900)
    run(svc.start_download_service(spark, hqL))
    topics.write_topic(bad("IMAGE_DOWNLOAD"), hqL.topics, "IMAGE_DOWNLOAD", 900)
    run(svc.start_broadcast_service(spark, hqL))
    run(svc.start_site_counters(spark, hqL, "HQ"))
    run(svc.start_replication(spark, hqL, edL, "ASSET_BROADCAST", "HQ"))
    svc.record_clicks(spark, edL, spark.createDataFrame(
        [(10 ** 15, ids["Moon"])], "seq long, assetID string").withColumn("ts", F.lit(None).cast("timestamp_ntz")), 0)
    run(svc.start_lifecycle_service(spark, edL, edL.replica))
    for _ in range(2):  # a retry of the same batch
        svc.publish_requests(spark, edL, 0)
    run(svc.start_lifecycle_service(spark, edL, edL.replica))
    assert svc.view_received(spark, edL).count() == 0  # the file is not there yet
    run(svc.start_replication(spark, edL, hqL, "ASSET_REQUEST", "EDGE"))
    run(svc.start_response_service(spark, hqL, request_topics=hqL.replica))
    write(f"{sites.edge_files}/{rel(ids['Moon'], 'moon.jpg')}", b"Moon")
    for batch in (5, 5, 6):  # a retry, and a later look that finds nothing new
        found = svc.view_received(spark, edL, batch).collect()
        assert [r.title for r in found] == (["Moon"] if batch == 5 else [])
    good = '{"operation":"DB_GET","upstreamPath":"/x"}'
    topics.write_topic(spark.createDataFrame([(k, None, "EDGE", "AUDIT", None, v) for k, v in enumerate([good, good, "{no"])], TOPIC_LOG),
                       edL.topics, "AUDIT", 0)
    run(svc.start_audit_listener(spark, edL))
    run(svc.start_site_counters(spark, edL, "EDGE"))
    hq_want = {"IMAGE Feed": 3, "Image Download": 2, "Asset Broadcast": 2, "Asset Response": 1}
    edge_want = {"Audit Listener": 2, "Upstream Comm": 0, "Broadcast Listener": 2, "Asset Request": 1, "Asset Viewer": 1}
    assert (svc.site_counters(spark, hqL, "HQ"), svc.site_counters(spark, edL, "EDGE")) == (hq_want, edge_want)
    # Retries of earlier batches replace their numbers; folding keeps them.
    feed = feedsrc.read_feed_files(spark, str(tmp / "feed"))
    svc.feed_batch(spark, hqL, feed, 0)
    svc.download_batch(spark, hqL, spark.read.parquet(f"{hqL.topics}/IMAGEFEED/batch=0"), 0)
    for k in range(3):
        assert (svc.site_counters(spark, hqL, "HQ"), svc.site_counters(spark, edL, "EDGE")) == (hq_want, edge_want)
        svc.maintain(spark, hqL)
        svc.maintain(spark, edL)
    # The same numbers as the batch query gives for what the services wrote.
    from fieldlink.operators import monitor

    batch = monitor.service_counters(spark, {
        "IMAGE Feed": topic_rows(spark, hqL.topics, "IMAGEFEED", IMAGEFEED_MSG), "Image Download": topic_rows(spark, hqL.topics, "IMAGE_DOWNLOAD"),
        "Asset Broadcast": topic_rows(spark, hqL.topics, "ASSET_BROADCAST"), "Asset Response": spark.read.parquet(f"{hqL.base}/responses"),
        "Audit Listener": spark.read.parquet(f"{edL.base}/audit"), "Broadcast Listener": topic_rows(spark, edL.replica, "ASSET_BROADCAST"),
        "Asset Request": spark.read.schema("seq long").option("recursiveFileLookup", "true").parquet(edL.publications),
        "Asset Viewer": spark.read.option("recursiveFileLookup", "true").parquet(f"{edL.base}/received")})
    assert {r.service: r.n for r in batch.collect()} == {**hq_want, **edge_want}


def test_folded_counts_survive_failures(tmp_path, monkeypatch):
    from fieldlink.streaming import counters

    base, want = str(tmp_path), 0
    for b in range(40):
        counters.record(base, "S", b, b)
        counters.record(base, "S", b, b + 1)  # the retry counts
        want += b + 1
        if b % 3 == 0:
            name = ["write_text", "delete_file"][b % 2]
            real = getattr(counters.fs, name)
            monkeypatch.setattr(counters.fs, name, lambda *a: (_ for _ in ()).throw(OSError("gone")))
            try:
                counters.fold(base, "S")
            except OSError:
                pass
            monkeypatch.setattr(counters.fs, name, real)
            assert counters.total(base, "S") == want
        if b % 4 == 0:
            counters.fold(base, "S")
        assert counters.total(base, "S") == want
    assert counters.total(base, "none") == 0
    assert len(counters._files(counters._folder(base, "S"))[1]) < 12
