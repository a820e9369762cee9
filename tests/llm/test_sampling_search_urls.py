"""Importance resampling, hard negatives and URL filters against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import CLASHING, ODD, SF01, llm, table, words  # noqa: F401
from pyspark.sql import functions as F

from fieldlink.llm import hard_negatives, importance, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- importance resampling ---------------------------------------------------------------------


def plain_features(text, most=3):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(ws), [" ".join(ws[i : i + n]) for n in range(1, most + 1) for i in range(len(ws) - n + 1)]


def plain_resample(docs, target, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, t in docs for f in plain_features(t)[1])
    t = Counter(bucket(f) for x in target for f in plain_features(x)[1])
    all_s, all_t, out = sum(s.values()), sum(t.values()), []
    for i, text in docs:
        n, fs = plain_features(text)
        w = sum(math.floor(1000 * math.log((t[bucket(f)] + 1) * (all_s + 10_000) / ((s[bucket(f)] + 1) * (all_t + 10_000)))) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    k = percent * len(fit) // 100
    return out, fit[:k]


@pytest.mark.parametrize("percent, least", [(5, 20), (60, 2)])
def test_resampling_equals_brute_force(llm, percent, least):
    rows = [(1000 + r["doc_id"], r["text"]) for r in llm.read.parquet(f"{SF01}/documents.parquet").limit(150).collect()]
    rows += ODD + [(20, "a-b_c. D,e\tÉé\u00a0x\x85y 日本 語 1,5"), (21, words(25, 3)), (22, words(25, 3))]
    target = [r["text"] for r in llm.read.parquet(f"{SF01}/benchmark.parquet").collect()] + [None]
    bench = llm.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(table(llm, rows), bench, percent=percent, least_words=least).collect()
    want, drawn = plain_resample(rows, target, percent, least)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(x[:4] for x in want)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(x[0], x[3]) for x in drawn]


def test_resampling_of_empty_tables(llm):
    none = table(llm, [])
    assert importance.resample(none, none).count() == 0
    one = importance.resample(table(llm, [(1, words(30))]), none, percent=100).collect()
    assert [(r["doc_id"], r["rank"], r["n_features"]) for r in one] == [(1, 1, 87)]


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_run_hashes_do_not_depend_on_the_pieces(block):
    raw = ("  one,two three \n" * 5 + "é" * 100 + " x ").encode()
    want = Counter(zlib.crc32(f.encode()) for f in plain_features(raw.decode(), 4)[1])
    got = Counter(h for runs in importance.run_hashes(raw, 4, block) for r in runs for h in r)
    assert got == want


def test_a_draw_resembles_the_target(llm):
    """Documents written with the target's words come first."""
    r = random.Random(1)
    own = [" ".join(r.choice(["red", "green", "blue"]) for _ in range(60)) for _ in range(20)]
    docs = [(i, words(60, i)) for i in range(400)] + [(1000 + i, t) for i, t in enumerate(own)]
    got = importance.resample(table(llm, docs), table(llm, [(1, t) for t in own] * 30)).where("rank IS NOT NULL").collect()
    assert len(got) == 21 and sum(x["doc_id"] >= 1000 for x in got) >= 19


# --- hard negatives ----------------------------------------------------------------------------


def plain_mine(rows, every, most=5):
    kept = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = Counter()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    rank = lambda c: (-c[0], c[1] is None, c[1] or 0)
    for n, (i, v, label) in enumerate(kept):
        if i is None or i % every:
            continue
        scored = [(dot(v, w), j, other == label) for m, (j, w, other) in enumerate(kept) if m != n]
        for p, pid, _ in sorted((c for c in scored if c[2]), key=rank)[:most]:
            fits = sorted((c for c in scored if not c[2] and 80 * p <= 100 * c[0] <= 100 * p), key=rank)[:most]
            out.update((i, pid, r, j, p, s) for r, (s, j, _) in enumerate(fits, 1))
    return out


def vectors(llm, rows):
    df = llm.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return df.select("*", *[F.lit("x").alias(c) for c in [*CLASHING, "cell", "page", "win"] if c != "label"])


def clustered(n, seed, width=8):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, width))
    x = np.concatenate([centre[rng.integers(0, 6, n // 2)] + rng.normal(size=(n // 2, width)) * 0.02, rng.normal(size=(n - n // 2, width))])
    return [(i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(rng.integers(0, 10))) for i, v in enumerate(x)]


@pytest.mark.parametrize("first, page_rows, centroids", [(40, 50, 6), (4096, None, None)])
def test_hard_negatives_equal_brute_force(llm, first, page_rows, centroids):
    rows = clustered(700, 3)
    rows += [(None, rows[0][1], 3), (701, None, 1), (702, rows[1][1], None), (703, [1.0, None] + [0.0] * 6, 1),
             (704, [float("nan")] * 8, 1), (705, [float("inf")] + [0.0] * 7, 1), (706, [], 2), (707, [0.5], 2)]
    rows += [(900 + i, rows[20][1], i % 4) for i in range(120)]  # one vector many times: ties
    got = hard_negatives.mine(vectors(llm, rows), every=20, first=first, page_rows=page_rows, centroids=centroids)
    assert Counter(map(tuple, got.collect())) == plain_mine(rows, 20)


def test_hard_negatives_with_repeated_rows_and_hot_vectors(llm):
    """A copy of an anchor is another row; scores do not tell the copies apart, ids and counts do."""
    rows = clustered(60, 4) * 2
    got = hard_negatives.mine(vectors(llm, rows), every=10, first=16, page_rows=16, centroids=3).collect()
    want = plain_mine(rows, 10)
    assert Counter((r["anchor_id"], r["rank"], r["negative_score"], r["positive_score"]) for r in got) == Counter(
        {k: v for k, v in Counter((a, r, s, p) for (a, _, r, _, p, s), n in want.items() for _ in range(n)).items()})


def test_hard_negatives_of_empty_and_single_rows(llm):
    assert hard_negatives.mine(vectors(llm, [])).count() == 0
    assert hard_negatives.mine(vectors(llm, [(0, [1.0, 0.0], 1), (3, None, 1)])).count() == 0


def test_products_beyond_doubles_are_exact(llm):
    big = [(i, [float(2 ** (20 + i % 3)), 1.0 + i / 256, float(i)], i % 2) for i in range(1, 13)] + [(0, [2.0**20, 3.0, 0.5], 1)]
    got = hard_negatives.mine(vectors(llm, big), every=4)
    assert Counter(map(tuple, got.collect())) == plain_mine(big, 4)


def test_cells_come_by_falling_bounds_and_bounds_hold():
    rng = np.random.default_rng(5)
    u, v = rng.normal(size=9), rng.normal(size=7)
    seen = list(hard_negatives.falling_cells(u, v))
    assert len({(i, j) for _, i, j in seen}) == 63 and [b for b, *_ in seen] == sorted((b for b, *_ in seen), reverse=True)
    x = np.floor(256 * rng.normal(size=(500, 10)))
    cells = hard_negatives.Cells(hard_negatives.Codebooks(x[:100], 5), 10)
    i, j, di, dj = cells.assign(x)
    for radius, at, d in ((cells.radii[0], i, di), (cells.radii[1], j, dj)):
        np.maximum.at(radius, at, d)
    for q in x[:50]:
        a, b = cells.bounds(q)
        assert (x @ q <= a[i] + b[j]).all()


def test_a_search_near_groups_reads_few_rows():
    """Anchors amid close rows are certain after a small part of the cells."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 16))
    x = np.floor(256 * (np.repeat(centre, 50, 0) + rng.normal(size=(2000, 16)) * 0.01))
    cells = hard_negatives.Cells(hard_negatives.Codebooks(x, 40), 16)
    i, j, di, dj = cells.assign(x)
    np.add.at(cells.counts, (i, j), 1)
    np.maximum.at(cells.radii[0], i, di)
    np.maximum.at(cells.radii[1], j, dj)
    cells.lay_out(300)
    best = np.sort(x @ x[0])[-6]
    at, rest, pages = cells.visit(x[0], 0, 200)
    assert rest < best and sum(int(cells.counts.flat[c]) for c in {c for cs in pages.values() for c in cs}) < 600


def test_pages_hold_every_cell_within_their_size():
    cells = hard_negatives.Cells(hard_negatives.Codebooks(np.arange(40.0).reshape(10, 4), 5), 4)
    cells.counts[:] = np.array([[0, 3, 9, 40, 1]] * len(cells.counts))
    cells.lay_out(10)
    load = Counter()
    for c, first in cells.first.items():
        n = int(cells.counts.flat[c])
        for p in range(first, first + cells.parts[c]):
            load[p] += n / cells.parts[c]
    assert max(load.values()) <= 10 and len(cells.first) == 4 * len(cells.counts)


# --- URL filters -------------------------------------------------------------------------------

URLS = ["https://Blog.Example.ORG/es/1?x=1", "http://example.org/en/12", "http://example.org/en/2#a", "http://notexample.org/es/1",
        "http://a.com/fr/1", "http://com/de/", "http://a.com/DE/1", "//x", "", None, "mailto:a@b.org", "http://", "http:///es/",
        "http://example.org", "http://example.org?/es/", "u://a.b.c.org:80/es/", "x://y://example.org/es/1", "http://É.com/fr/é",
        "http://" + "a." * 50_000 + "com/fr/1", "http://example.org/es/" + "x" * 200_000, "http://.org/", "http://org./",
        "ftp://example.org/es", "http://example.net/\n?"]


def plain_judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
        m = next((i for i, c in enumerate(rest) if i >= n and c in "?#"), len(rest))
        path = rest[n:m]
    fits = [(len((h + p).encode()), len(h.encode()), v == "block", h + p) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], default if best is None else "block" if best[2] else "allow"


@pytest.mark.parametrize("way", ["digests", "join"])
def test_urls_equal_brute_force(llm, way):
    rules = url_filter.RULES + [("b.c.org:80", "", "block"), ("É.com", "/fr/é", "block"), ("example.org", "/es/", "allow"),
                                ("net", "", "block"), ("com", "/fr/1", "block")]
    rows = [(i, u, "x") for i, u in enumerate(URLS + URLS[:3])]
    df = llm.createDataFrame(rows, "page_id long, url string, host string").repartition(3).withColumn("__p", F.lit(1)).withColumn("h", F.lit(2))
    got = url_filter.judge(df, [*rules, (None, "/", "block")], most_bytes=0 if way == "join" else 1 << 20)
    assert got.columns[:5] == ["page_id", "url", "host", "__p", "h"] and got.where("host = 'x'").count() == len(rows)
    seen = {r["page_id"]: (r["host_"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    assert seen == {i: plain_judge(u, rules) for i, u, _ in rows}


def test_urls_of_the_table_equal_brute_force_in_both_ways(llm):
    pages = llm.read.parquet(f"{SF01}/pages.parquet").select("page_id", "url")
    want = {r["page_id"]: plain_judge(r["url"], url_filter.RULES) for r in pages.collect()}
    for most in (0, 1 << 20):
        got = url_filter.judge(pages, url_filter.RULES, most_bytes=most).collect()
        assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == want


def test_urls_without_rows_or_rules(llm):
    none = llm.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, url_filter.RULES).count() == 0
    one = llm.createDataFrame([(None, "http://a.org/")], "page_id long, url string")
    for most in (0, 1 << 20):
        got = url_filter.judge(one, llm.createDataFrame([], "host string, path string, verdict string"), "block", most_bytes=most)
        assert [tuple(r) for r in got.select("rule", "verdict").collect()] == [(None, "block")]


def test_digests_that_collide_do_not_decide():
    same = lambda s: len(s) % 3
    rules = [(f"h{i}.org", f"/{'p' * i}", "block" if i % 2 else "allow") for i in range(40)]
    rule_set = url_filter.RuleSet(np.frombuffer(url_filter.RuleSet.build(rules, same), np.uint8), same)
    hosts = [h.encode() for h, _, _ in rules] + [b"h1.orh", b"x.h2.org"]
    paths = [p.encode() for _, p, _ in rules] + [b"/p", b"/pp/more"]
    found = rule_set.judge(hosts, paths)
    assert found[:40] == [((h + p).encode(), v == "block") for h, p, v in rules]
    assert found[40] is None and found[41] == (b"h2.org/pp", False)
