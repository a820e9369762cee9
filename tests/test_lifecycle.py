"""Closed-form lifecycle (one aggregate) equals the sequential state machine."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rel
from fieldlink.operators import edge
from fieldlink.config import Sites

SITES = Sites(edge_root="/e")


def fold(events, present):
    """The reference's per-event state machine over one asset's events."""
    status = None
    for _seq, kind in sorted(events):
        if kind == "b":
            if status is None:
                status = "!"
        elif kind == "c":
            if status is not None:
                status = "requesting..."
        elif kind == "p":
            if status == "requesting...":
                status = "requested"
                if present:
                    status = "received"
        if status == "requested" and present:
            status = "received"
    return status


history = st.lists(st.sampled_from("bcp"), min_size=0, max_size=8)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(history, st.booleans()), min_size=60, max_size=60), st.integers(0, 10_000))
def test_closed_form_equals_fold(spark, histories, seed):
    rnd = random.Random(seed)
    seqs = rnd.sample(range(100_000), sum(len(h) for h, _ in histories))
    b, c, p, files, expected = [], [], [], [], {}
    it = iter(seqs)
    for i, (kinds, present) in enumerate(histories):
        aid = f"a{i:04d}"
        events = [(next(it), k) for k in kinds]
        for s, k in events:
            if k == "b":
                b.append((s, aid, "t", "d", f"f{i}.jpg"))
            elif k == "c":
                c.append((s, aid))
            else:
                p.append((s, aid))
        if present:
            files.append((f"file:/e/files.mirror/{rel(aid, f'f{i}.jpg')}", 1))
        expected[aid] = fold(events, present)
    bdf = spark.createDataFrame(b, "seq long, assetID string, title string, description string, filename string") \
        .selectExpr("seq", "cast(null as timestamp_ntz) as ts", "title", "description", "filename", "assetID")
    cdf = spark.createDataFrame(c, "seq long, assetID string").selectExpr("seq", "cast(null as timestamp_ntz) ts", "assetID")
    pdf = spark.createDataFrame(p, "seq long, assetID string").selectExpr("seq", "cast(null as timestamp_ntz) ts", "assetID")
    ldf = spark.createDataFrame(files, "path string, length long").selectExpr(
        "path", "cast(null as timestamp) modificationTime", "length")
    got = {r.assetID: r.status for r in edge.asset_lifecycle(bdf, cdf, pdf, ldf, SITES).collect()}
    assert got == {k: v for k, v in expected.items() if v is not None}
