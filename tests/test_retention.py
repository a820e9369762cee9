"""Topics: published once, read in bounded micro-batches, expired behind their slowest consumer."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from fieldlink.config import Sites
from fieldlink.schemas import ASSET_MSG, TOPIC_LOG
from fieldlink.sources import topics
from fieldlink.streaming import retention
from fieldlink.streaming import services as svc


@pytest.fixture()
def layout(tmp_path):
    sites = Sites(hq_root=str(tmp_path / "hq"), edge_root=str(tmp_path / "edge"), source_images=str(tmp_path / "images"))
    return svc.Layout(str(tmp_path / "pipe+ hq"), sites)  # characters that a URI would encode


def messages(spark, seqs, topic="IMAGE_DOWNLOAD"):
    value = '{"assetID":"a%d","title":"t","status":"success"}'
    return spark.createDataFrame([(s, None, "HQ", topic, None, value % s) for s in seqs], TOPIC_LOG).coalesce(1)


def run(q):
    q.awaitTermination()
    assert q.exception() is None


def seqs(df):
    return sorted(r.seq for r in df.select("seq").collect())


def test_a_batch_is_published_once(spark, layout):
    """A retry with other rows changes nothing that a consumer may have read; attempts that died are invisible."""
    where = f"{layout.topics}/IMAGE_DOWNLOAD"
    assert topics.write_topic(messages(spark, [1, 2]), layout.topics, "IMAGE_DOWNLOAD", 0)
    os.makedirs(f"{where}/_attempt-1-dead")
    messages(spark, [9]).write.mode("overwrite").parquet(f"{where}/_attempt-1-dead")
    before = sorted(os.listdir(f"{where}/batch=0"))
    run(svc.start_broadcast_service(spark, layout))
    assert not topics.write_topic(messages(spark, [1, 2, 3]), layout.topics, "IMAGE_DOWNLOAD", 0)
    assert sorted(os.listdir(f"{where}/batch=0")) == before
    assert topics.write_topic(messages(spark, [3]), layout.topics, "IMAGE_DOWNLOAD", 1)
    run(svc.start_broadcast_service(spark, layout))
    assert seqs(topics.read_topic(spark, layout.topics, "IMAGE_DOWNLOAD")) == [1, 2, 3]
    assert seqs(topics.read_topic(spark, layout.topics, "ASSET_BROADCAST")) == [1, 2, 3]
    assert not [n for n in os.listdir(where) if n.startswith("_attempt-0")]


def test_attempts_at_the_same_time_publish_one(spark, layout):
    done = []
    threads = [threading.Thread(target=lambda k=k: done.append(topics.write_topic(messages(spark, [k]), layout.topics, "T", 0)))
               for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(done) == 1 and len(seqs(topics.read_topic(spark, layout.topics, "T"))) == 1


def test_one_response_for_a_batch_that_ran_twice(spark, layout):
    """The request batch is written again after it was read: one response, one count."""
    for _ in range(2):
        topics.write_topic(messages(spark, [1], "ASSET_REQUEST"), layout.topics, "ASSET_REQUEST", 0)
        run(svc.start_response_service(spark, layout))
    dead = spark.read.parquet(f"{layout.deadletter}/response")
    assert seqs(dead) == [1] and svc.site_counters(spark, layout, "HQ")["Asset Response"] == 0


def test_a_backlog_is_taken_in_several_micro_batches(spark, layout):
    for b in range(6):
        topics.write_topic(messages(spark, range(10 * b, 10 * b + 10)), layout.topics, "IMAGE_DOWNLOAD", b)
    size = max(os.path.getsize(f"{layout.topics}/IMAGE_DOWNLOAD/batch=0/{n}") for n in os.listdir(f"{layout.topics}/IMAGE_DOWNLOAD/batch=0"))
    src = topics.read_topic(spark, layout.topics, "IMAGE_DOWNLOAD", streaming=True, max_bytes_per_trigger=2 * size + 100)
    seen = []
    q = (topics.consume(src, "IMAGE_DOWNLOAD", ASSET_MSG).writeStream.foreachBatch(lambda d, b: seen.append(seqs(d)))
         .option("checkpointLocation", f"{layout.base}/ck").trigger(availableNow=True).start())
    run(q)
    assert len(seen) >= 3 and sorted(s for b in seen for s in b) == list(range(60))


def age(layout, topic, batches, seconds):
    for b in batches:
        for n in os.listdir(f"{layout.topics}/{topic}/batch={b}"):
            os.utime(f"{layout.topics}/{topic}/batch={b}/{n}", (time.time() - seconds,) * 2)


def test_retention_waits_for_the_slowest_consumer(spark, layout):
    read = lambda: seqs(topics.read_topic(spark, layout.topics, "IMAGE_DOWNLOAD"))
    for b in range(3):
        topics.write_topic(messages(spark, [b]), layout.topics, "IMAGE_DOWNLOAD", b)
    age(layout, "IMAGE_DOWNLOAD", [0, 1], 1000)
    assert retention.expire_topics(spark, layout, 100) == 0  # nobody is known to have read anything
    run(svc.start_broadcast_service(spark, layout))
    lagging = svc._topic_stream(spark, layout, "lagging", layout.topics, "IMAGE_DOWNLOAD")
    assert retention.expire_topics(spark, layout, 100) == 0 and read() == [0, 1, 2]  # noted, but before its first batch
    got = []
    start = lambda: (lagging.writeStream.queryName("lagging").foreachBatch(lambda d, b: got.extend(seqs(d)))
                     .option("checkpointLocation", layout.checkpoint(spark, "lagging")).trigger(availableNow=True).start())
    run(start())
    opened = topics.read_topic(spark, layout.topics, "IMAGE_DOWNLOAD")  # has listed the files
    topics.write_topic(messages(spark, [3]), layout.topics, "IMAGE_DOWNLOAD", 3)
    age(layout, "IMAGE_DOWNLOAD", [3], 1000)  # old, but not read by anyone
    assert retention.expire_topics(spark, layout, 100) == 2 and read() == [2, 3]
    assert seqs(opened) == [2]  # a reader in parallel does not fail
    assert not os.path.exists(f"{layout.topics}/IMAGE_DOWNLOAD/batch=0")
    run(svc.start_broadcast_service(spark, layout))
    assert retention.expire_topics(spark, layout, 100) == 0  # the other one has not read batch 3
    run(start())
    assert retention.expire_topics(spark, layout, 100) == 1 and read() == [2]
    assert sorted(got) == [0, 1, 2, 3]
    assert seqs(topics.read_topic(spark, layout.topics, "ASSET_BROADCAST")) == [0, 1, 2, 3]
    # A consumer that is given up no longer holds anything back.
    topics.write_topic(messages(spark, [4]), layout.topics, "IMAGE_DOWNLOAD", 4)
    run(svc.start_broadcast_service(spark, layout))
    age(layout, "IMAGE_DOWNLOAD", [2, 4], 1000)
    assert retention.expire_topics(spark, layout, 100) == 1 and read() == [4]
    retention.forget_consumer(layout.base, "lagging")
    assert retention.expire_topics(spark, layout, 100) == 1 and read() == []
    # Everything goes on: the services neither fail nor repeat.
    topics.write_topic(messages(spark, [5]), layout.topics, "IMAGE_DOWNLOAD", 5)
    run(svc.start_broadcast_service(spark, layout))
    assert seqs(topics.read_topic(spark, layout.topics, "ASSET_BROADCAST")) == [0, 1, 2, 3, 4, 5]


def test_retention_of_a_topic_written_by_the_file_sink(spark, layout, tmp_path):
    """The other site's replica folder: read through the sink's log, which still names what is gone."""
    edge = svc.Layout(str(tmp_path / "pipe_edge"), layout.sites)
    for b in range(2):
        topics.write_topic(messages(spark, [b]), layout.topics, "IMAGE_DOWNLOAD", b)
        run(svc.start_broadcast_service(spark, layout))
        run(svc.start_replication(spark, layout, edge, "ASSET_BROADCAST", "HQ"))
    run(svc.start_lifecycle_service(spark, edge, edge.replica))
    svc.maintain(spark, edge, topic_ttl_s=0)
    assert topics.read_topic(spark, edge.replica, "ASSET_BROADCAST").count() == 0
    topics.write_topic(messages(spark, [2]), layout.topics, "IMAGE_DOWNLOAD", 2)
    run(svc.start_broadcast_service(spark, layout))
    run(svc.start_replication(spark, layout, edge, "ASSET_BROADCAST", "HQ"))
    run(svc.start_lifecycle_service(spark, edge, edge.replica))
    assert sorted(r.assetID for r in svc.asset_table(spark, edge).collect()) == ["a0", "a1", "a2"]
    assert svc.site_counters(spark, edge, "EDGE")["Broadcast Listener"] == 3
