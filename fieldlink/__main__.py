"""Run a site's services: ``python -m fieldlink <command> --base <folder> ...``.

Commands:
  hq       feed, download, broadcast and response services, counters (2 s period)
  edge     asset state, requests, audit listener, replica monitor, mirror lag, counters (3 s period)
  maintain fold the site's state folders and documents, delete topic files that all consumers have read
           and that are older than --topic-ttl-seconds, and what dead copies left (the last only here);
           hq and edge do the rest every --maintain-seconds
  pause    stop the site's replication until resume (the runner follows within a second)
  resume   go on with it from its position
  mirror   one mirror pass from the HQ files volume to the edge mirror
  publish  publish every asset waiting in "requesting..." once
  status   print the services' counters and the edge asset table
  init     create a site's folders and catalog tables (already there: fine)
  drop     drop a site's tables and folders (give the edge site first); with --peer-base both sites and HQ's volumes

Roots default to the values in ``fieldlink.config``; ``--once`` drains what is
there and stops (``availableNow``) instead of running on the period.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import functions as F

from fieldlink.config import TOPIC_TTL_SECONDS, Sites


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="fieldlink")
    ap.add_argument("command", choices=["hq", "edge", "maintain", "pause", "resume", "mirror", "publish", "status", "init", "drop"])
    ap.add_argument("--base", required=True, help="pipeline folder of this site (shared storage)")
    ap.add_argument("--feed", help="feed folder (hq)")
    ap.add_argument("--peer-base", help="the other site's pipeline folder (replication)")
    ap.add_argument("--hq-root")
    ap.add_argument("--edge-root")
    ap.add_argument("--source-images")
    ap.add_argument("--checkpoint", help="folder of the services' positions (default: below --base)")
    ap.add_argument("--master", default=None)
    ap.add_argument("--maintain-seconds", type=int, default=600, help="period of folding state (hq, edge)")
    ap.add_argument("--topic-ttl-seconds", type=int, default=TOPIC_TTL_SECONDS, help="retention of topic messages (hq, edge, maintain)")
    ap.add_argument("--once", action="store_true")
    a = ap.parse_args(argv)

    from fieldlink.config import EDGE, HQ
    from fieldlink.session import build_session, ship_package
    from fieldlink.sources import volumes
    from fieldlink.streaming import services as svc

    if a.command in ("pause", "resume"):  # a mark in the site's folder; needs no Spark
        (svc.pause_replication if a.command == "pause" else svc.resume_replication)(svc.Layout(a.base))
        return

    kw = {k: v for k, v in {"hq_root": a.hq_root, "edge_root": a.edge_root,
                            "source_images": a.source_images}.items() if v}
    sites = Sites(**kw)
    spark = build_session(a.master, app_name=f"fieldlink-{a.command}")
    ship_package(spark)
    layout = svc.Layout(a.base, sites, a.checkpoint)
    once = {"availableNow": True} if a.once else None

    if a.command in ("hq", "edge") and a.once:
        # Drain each stage in dependency order, so one run carries data end to end.
        peer = svc.Layout(a.peer_base, sites) if a.peer_base else None
        if a.command == "hq":
            steps = [lambda: svc.start_feed_service(spark, layout, a.feed, once),
                     lambda: svc.start_download_service(spark, layout, once),
                     lambda: svc.start_broadcast_service(spark, layout, once),
                     lambda: svc.start_response_service(spark, layout, once, layout.replica),
                     lambda: svc.start_site_counters(spark, layout, HQ, once)]
            if peer and not svc.replication_paused(layout):
                steps.insert(3, lambda: svc.start_replication(spark, layout, peer, "ASSET_BROADCAST", "HQ", once))
        else:
            steps = [lambda: svc.start_lifecycle_service(spark, layout, layout.replica, once),
                     lambda: svc.start_request_service(spark, layout, once),
                     lambda: svc.start_lifecycle_service(spark, layout, layout.replica, once),  # what was requested
                     lambda: svc.start_audit_listener(spark, layout, once),
                     lambda: svc.start_site_counters(spark, layout, EDGE, once),
                     lambda: svc.start_replica_monitor(spark, layout, once),
                     lambda: svc.start_mirror_lag_service(spark, layout, once)]
            if peer and not svc.replication_paused(layout):
                steps.append(lambda: svc.start_replication(spark, layout, peer, "ASSET_REQUEST", "EDGE", once))
        for step in steps:
            step().awaitTermination()
        site, foreign = (HQ, layout.replica) if a.command == "hq" else (EDGE, layout.replica)
        for q in svc.start_deadletter_service(spark, layout, site, once, foreign).values():
            q.awaitTermination()
        if a.command == "edge":
            svc.view_received(spark, layout)
        svc.maintain(spark, layout, a.topic_ttl_seconds)
    elif a.command in ("hq", "edge"):
        if a.command == "hq":
            qs = svc.start_hq(spark, layout, a.feed, svc.HQ_PERIOD, layout.replica)
            topic, origin, period = "ASSET_BROADCAST", HQ, svc.HQ_PERIOD
        else:
            qs = svc.start_edge(spark, layout, layout.replica, svc.EDGE_PERIOD)
            topic, origin, period = "ASSET_REQUEST", EDGE, svc.EDGE_PERIOD
        folded = time.monotonic()
        try:
            while all(q.isActive for q in qs.values()):
                if a.peer_base and svc.replication_paused(layout) == ("replication" in qs):
                    if "replication" in qs:
                        qs.pop("replication").stop()
                    else:
                        qs["replication"] = svc.start_replication(
                            spark, layout, svc.Layout(a.peer_base, sites), topic, origin, period)
                if time.monotonic() - folded >= a.maintain_seconds:
                    svc.maintain(spark, layout, a.topic_ttl_seconds)
                    folded = time.monotonic()
                time.sleep(1)
        finally:
            svc.stop_all(qs)
    elif a.command == "maintain":
        svc.maintain(spark, layout, a.topic_ttl_seconds)
        print(f"left by dead copies: {svc.sweep(spark, layout)} files deleted")
    elif a.command == "mirror":
        plan = volumes.mirror_diff(volumes.list_volume(spark, sites.hq_files), sites.hq_files,
                                   volumes.list_volume(spark, sites.edge_files, missing_ok=True), sites.edge_files)
        # The copies and deletes happen in this write, which runs every task.
        log = f"{a.base}/mirror_runs/run={time.time_ns()}"
        volumes.mirror_apply(plan, sites.edge_files, sites.hq_files).write.parquet(log)
        done = spark.read.parquet(log)
        for r in done.groupBy(F.when(F.col("src").isNull(), "delete").otherwise("copy").alias("action"), "ok").count().collect():
            print(f"{r['action']}: {r['count']} {'done' if r['ok'] else 'failed'}")
        for r in done.where("NOT ok").toLocalIterator():
            print(r["dst"], r["error"])
    elif a.command == "init":
        from fieldlink.config import (TOPIC_ASSET_BROADCAST, TOPIC_ASSET_REQUEST, TOPIC_IMAGE_DOWNLOAD,
                                      TOPIC_IMAGEFEED)
        from fieldlink.sources import catalog

        names = [TOPIC_IMAGEFEED, TOPIC_IMAGE_DOWNLOAD, TOPIC_ASSET_BROADCAST, TOPIC_ASSET_REQUEST]
        for f in catalog.init_catalog(spark, layout, topic_names=names):
            print(f)
    elif a.command == "drop":
        from fieldlink.sources import catalog

        layouts = [layout] + ([svc.Layout(a.peer_base, sites)] if a.peer_base else [])
        catalog.drop_catalog(spark, layouts, hq_volumes=len(layouts) > 1)
    elif a.command == "publish":
        for r in svc.publish_requests(spark, layout, int(time.time())).toLocalIterator():
            print(r["assetID"], r["title"], sep="\t")
    else:
        for site in (HQ, EDGE):
            print(site, *[f"{name}: {n}" for name, n in svc.site_counters(spark, layout, site).items()], sep="\t")
        for r in svc.asset_table(spark, layout).select("assetID", "title", "status").toLocalIterator():
            print(r["assetID"], r["title"], r["status"], sep="\t")
    spark.stop()


if __name__ == "__main__":
    main()
