"""Document table: insert-or-replace, lookup, compaction."""

from fieldlink.sources import documents as docs


def change(_id, seq, title, loc=None, rev=0):
    return (_id, [(title, "d", None)], [("http://x/" + title,)], loc, None, seq, rev)


SCHEMA = ("_id string, data array<struct<title:string,description:string,item_id:string>>, "
          "links array<struct<href:string>>, imageDownloadLocation string, extra string, seq long, rev int")


def test_last_write_wins_whole_document(spark, tmp_path):
    base = str(tmp_path / "docs")
    docs.upsert(base, spark.createDataFrame([change("a", 1, "one", "/loc"), change("b", 2, "two")], SCHEMA))
    docs.upsert(base, spark.createDataFrame([change("a", 3, "three")], SCHEMA), batch_id=0, producer="p")
    docs.upsert(base, spark.createDataFrame([change("a", 3, "three")], SCHEMA), batch_id=0, producer="p")  # retry
    cur = {r._id: r for r in docs.read_current(spark, base).collect()}
    assert cur["a"].data[0].title == "three" and cur["a"].imageDownloadLocation is None  # whole doc replaced
    assert cur["b"].seq == 2
    assert docs.read_changelog(spark, base).count() == 3  # the retry did not append a copy


def test_rev_orders_writes_of_one_message(spark, tmp_path):
    base = str(tmp_path / "docs")
    docs.upsert(base, spark.createDataFrame([change("a", 5, "x", "/late", rev=1), change("a", 5, "x", None, 0)], SCHEMA))
    assert docs.read_current(spark, base).first().imageDownloadLocation == "/late"


def test_lookup_and_compact(spark, tmp_path):
    base, snap = str(tmp_path / "docs"), str(tmp_path / "snap")
    docs.upsert(base, spark.createDataFrame([change("a", 1, "one"), change("b", 2, "two"), change("a", 4, "four")], SCHEMA))
    ids = spark.createDataFrame([("a",), ("zz",)], "assetID string")
    found = docs.lookup(docs.read_current(spark, base), ids).collect()
    assert [(r._id, r.data[0].title) for r in found] == [("a", "four")]
    docs.compact(spark, base, snap)
    again = str(tmp_path / "docs2")
    docs.upsert(again, spark.createDataFrame([change("b", 9, "nine")], SCHEMA))
    cur = {r._id: r.data[0].title for r in docs.read_current(spark, again, snap).collect()}
    assert cur == {"a": "four", "b": "nine"}


def test_current_for_ids_aggregates_only_those(spark, tmp_path):
    """Services read only the batch's ids from the changelog, not every document."""
    base = str(tmp_path / "docs")
    docs.upsert(base, spark.createDataFrame([change("a", 1, "one"), change("b", 2, "two"), change("a", 3, "x")],
                                            SCHEMA))
    ids = spark.createDataFrame([("a",), ("q",)], "assetID string")
    df = docs.read_current(spark, base, ids=ids)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") > plan.index("Aggregate")  # the semi join sits below the aggregate
    assert [(r._id, r.seq) for r in df.collect()] == [("a", 3)]


def random_changes(rng, first, n, ids):
    """``n`` versions of random documents from ``seq`` on; some share a seq and differ in rev."""
    return [change(f"d{rng.randrange(ids)}", first + k // 2, f"t{first}-{k}", None if k % 3 else f"/loc{k}", rev=k % 2) for k in range(n)]


def newest(rows):
    best = {}
    for r in rows:
        if r[0] not in best or (r[5], r[6]) >= (best[r[0]][5], best[r[0]][6]):
            best[r[0]] = r
    return {k: (v[5], v[6], v[1][0][0], v[3]) for k, v in best.items()}


def seen(df):
    return {r._id: (r.seq, r.rev, r.data[0].title, r.imageDownloadLocation) for r in df.collect()}


def test_folds_keep_the_current_documents_and_the_scan_flat(spark, tmp_path):
    """200 batches: a batch's lookup reads about as much at the end as early on, and always the right documents."""
    import os
    import random

    base, rng, written, scanned, buckets = str(tmp_path / "docs"), random.Random(1), [], [], []
    for b in range(200):
        rows = [r for r in {(r[0], r[5], r[6]): r for r in random_changes(rng, 100 * b, 12, 60 + 4 * b)}.values()]
        docs.upsert(base, spark.createDataFrame(rows, SCHEMA).coalesce(1), batch_id=b, producer="feed")
        written += rows
        if b % 10 == 9:
            docs.fold(spark, base, bucket_rows=40)
            buckets.append(docs.manifest(base)["buckets"])
        if b % 10 == 5 or b > 195:
            ids = [f"d{rng.randrange(60 + 4 * b)}" for _ in range(3)] + ["none"]
            got = docs.read_current(spark, base, ids=spark.createDataFrame([(i,) for i in ids], "assetID string"))
            want = newest(written)
            assert seen(got) == {i: want[i] for i in ids if i in want}
            files = docs.read_versions(spark, base, spark.createDataFrame([(i,) for i in ids], "assetID string")).inputFiles()
            scanned.append(sum(os.path.getsize(f.split("file://")[-1].removeprefix("file:")) for f in files))
    assert seen(docs.read_current(spark, base)) == newest(written)
    assert buckets[-1] > 4 and max(scanned[-6:]) < 2 * max(scanned[1:6])
    assert len(docs._producers(base)["feed"][0]) <= 21  # folded batches are gone


def test_a_fold_that_dies_at_any_step_loses_nothing(spark, tmp_path, monkeypatch):
    import random

    import pytest

    base, rng, written = str(tmp_path / "docs"), random.Random(2), []

    def more(b):
        rows = [r for r in {(r[0], r[5], r[6]): r for r in random_changes(rng, 100 * b, 10, 15)}.values()]
        for producer, part in (("feed", rows[::2]), ("download", rows[1::2])):
            docs.upsert(base, spark.createDataFrame(part, SCHEMA), batch_id=b, producer=producer)
        written.extend(rows)

    docs.upsert(base, spark.createDataFrame([change("loose", 1, "l")], SCHEMA))  # written without a batch id
    written.append(change("loose", 1, "l"))
    for b in range(3):
        more(b)
    steps = ["write_text", "read_text", "delete_dir", "delete_file", "mkdirs"]
    for b, name in enumerate(steps * 2, 3):
        real = getattr(docs.fs, name)

        def dies(*args, **kw):
            if name == "delete_dir" and b % 2:  # half way through the deletions
                real(*args, **kw)
            raise OSError("gone")

        monkeypatch.setattr(docs.fs, name, dies)
        try:
            docs.fold(spark, base, bucket_rows=4)
        except OSError:
            pass
        monkeypatch.setattr(docs.fs, name, real)
        assert seen(docs.read_current(spark, base)) == newest(written), (name, b)
        before = docs.read_current(spark, base)  # lists its files now
        docs.fold(spark, base, bucket_rows=4)
        assert seen(before) == newest(written)
        more(b)
        assert seen(docs.read_current(spark, base)) == newest(written)
    with pytest.raises(AssertionError):
        assert docs.fold(spark, base) and docs.fold(spark, base)  # a second call finds nothing to move


def test_a_fold_keeps_what_a_retried_producer_asks_for(spark, tmp_path):
    """Beside the newest version stays the newest one before the open batch."""
    base = str(tmp_path / "docs")
    docs.upsert(base, spark.createDataFrame([change("a", 5, "old", "/at")], SCHEMA), batch_id=0, producer="feed")
    docs.upsert(base, spark.createDataFrame([change("a", 100, "new")], SCHEMA), batch_id=1, producer="feed")
    for b in range(2):
        docs.upsert(base, spark.createDataFrame([change("a", 100, "new", "/new", rev=1)], SCHEMA), batch_id=b, producer="download")
    assert docs.fold(spark, base, open_from=100)
    ids = spark.createDataFrame([("a",)], "assetID string")
    earlier = docs.current(docs.read_versions(spark, base, ids).filter("seq < 100"))
    assert seen(earlier) == {"a": (5, 0, "old", "/at")}
    assert seen(docs.read_current(spark, base)) == {"a": (100, 1, "new", "/new")}
