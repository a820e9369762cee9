"""Newest tiles from the newest messages only."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001
from fieldlink.operators import activity

SCHEMA = "seq long, ts timestamp_ntz, service string, title string, description string, image_url string"


@pytest.mark.parametrize("share", [0.0, 0.02, 0.3, 1.0])
@pytest.mark.parametrize("n_rows", [0, 3, 80, 700])
def test_newest_of_equals_the_top_of_all_tiles(spark, share, n_rows):
    """However few messages give a tile; it asks for more until it is certain, never for all of a long history at once."""
    r = random.Random(n_rows)
    seqs = r.sample(range(10 * n_rows + 1), n_rows)
    rows = [(s, None, "S", f"t{s}", None, None) for s in seqs if r.random() < share]
    tiles = spark.createDataFrame(rows, SCHEMA)
    asked = []

    def tiles_from(seq):
        asked.append(sum(s >= seq for s in seqs))
        return tiles.filter(F.col("seq") >= seq)

    got = activity.newest_of(spark.createDataFrame([(s,) for s in seqs], "seq long"), tiles_from, n=5, first=4)
    assert [x.seq for x in got.collect()] == sorted((x[0] for x in rows), reverse=True)[:5]
    assert got.columns == activity.TILE_COLUMNS
    assert asked == [min(20 * 8**k, n_rows) for k in range(len(asked))]
    if share == 1.0:
        assert len(asked) == 1


def test_visible_tiles_read_no_older_days(spark):
    """The message topics are read from the days of the time-to-live on; nothing is checkpointed."""
    plan = E.queries()["activity_visible"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "PartitionFilters" in line and "dt#" in line and "value#" in line]
    bounded = [line for line in scans if "dt#" in line.split("PartitionFilters: [")[1].split("PushedFilters")[0]]
    assert len(bounded) >= 4 and "ExistingRDD" not in plan
