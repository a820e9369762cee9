"""Several queries of one session storing the same stand-in at once: one copy wins, all read it."""

import threading

import __spark_entry__ as E
from conftest import SF001


def test_concurrent_first_use_of_stored_inputs(spark):
    names = ["topic_consume", "asset_broadcast", "audit_replication", "malformed_messages"]
    res, errs = {}, []

    def run(n):
        try:
            res[n] = E.queries()[n](spark, SF001).count()
        except Exception as e:  # surfaced below
            errs.append((n, repr(e)))

    threads = [threading.Thread(target=run, args=(n,)) for n in names]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errs
    assert set(res) == set(names) and all(v > 0 for v in res.values())
    assert res == {n: E.queries()[n](spark, SF001).count() for n in names}
