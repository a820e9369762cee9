"""Exact dedup, SimHash near-dedup and substring dedup against brute force."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldlink.llm import common, exact_dedup, simhash, substring_dedup

from llm_fixtures import ODD, SF01, llm, table, words  # noqa: F401


def lower(t):
    return (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def near_copies(seed=1):
    r, out = random.Random(seed), list(ODD[:9])
    for k in range(25):
        base = words(r.randint(3, 120), k + 10).split()
        for _ in range(r.randint(1, 4)):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = "changed"
            out.append((100 + len(out), " ".join(w)))
    return out


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact(llm, keep, weak):
    kw = {"content_hash": lambda c: F.length(c) % 3} if weak else {}
    got = exact_dedup.assign(table(llm, ODD), keep=keep, normalise=common.ascii_lower, **kw)
    groups = defaultdict(list)
    for i, t in ODD:
        groups[lower(t)].append(i)
    pick = {"min": min, "max": max}[keep]
    want = []
    for i, t in ODD:
        ids = [x for x in groups[lower(t)] if x is not None]
        k = pick(ids) if ids else None
        want.append((i, k, len(groups[lower(t)]), i == k, hashlib.sha256(lower(t).encode()).hexdigest()))
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_exact_deduplicate_leaves_one_row_a_text(llm):
    df = table(llm, ODD)
    got = exact_dedup.deduplicate(df, normalise=common.ascii_lower)
    assert got.columns == df.columns
    rows = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert sorted(lower(t) for _, t in rows) == sorted({lower(t) for _, t in ODD})
    assert all(i == min(j for j, s in ODD if j is not None and lower(s) == lower(t)) for i, t in rows)


def test_exact_contract_query_equals_sql(llm):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF01}/documents.parquet'")
    want = Counter(con.sql(exact_dedup.OP9_SQL).fetchall())
    assert Counter(map(tuple, exact_dedup.op9_exact_dedup(llm, SF01).collect())) == want


def plain_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(items, linked):
    low = {x: x for x in items}

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    for k, a in enumerate(items):
        for b in items[:k]:
            if linked(a, b):
                low[max(top(a), top(b))] = min(top(a), top(b))
    return {x: top(x) for x in items}


@pytest.mark.parametrize("block", [20_000, 4])
def test_simhash_components(llm, block, monkeypatch):
    rows = near_copies()
    real = simhash.links
    monkeypatch.setattr(simhash, "links", lambda reps, d: real(reps, d, block))
    got = simhash.near_groups(table(llm, rows))
    fps = [plain_fingerprint(t) for _, t in rows]
    root = classes(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), fp in zip(rows, fps):
        if i is not None:
            least[root[fp]] = min(i, least.get(root[fp], i))
    want = Counter((i, fp, least.get(root[fp])) for (i, _), fp in zip(rows, fps))
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got.collect()) == want
    assert len(set(root.values())) < len(set(fps)) < len(rows)
    kept = simhash.deduplicate(table(llm, rows))
    assert kept.count() == len({root[fp] for fp in fps})
    assert kept.columns == table(llm, rows).columns and kept.where("__row <> 'x'").count() == 0


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_trie_join_finds_every_pair(m):
    r = np.random.default_rng(3)
    centre = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    v = np.unique(np.concatenate([c ^ (np.uint64(1) << r.integers(0, 64, 12).astype(np.uint64)) ^ (
        np.uint64(1) << r.integers(0, 64, 12).astype(np.uint64)) for c in centre]))
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= 4}
    got = set()
    for s in range(m):
        turned = simhash.rotated(v, s * (64 // m))
        o = np.argsort(turned)
        a = turned[o]
        for i, j in simhash.trie_links(a, a, 64 // m, 4 // m, 4):
            got |= {(min(x, y), max(x, y)) for x, y in zip(o[i].tolist(), o[j].tolist())}
    assert got == want
    half = simhash.rotated(v, 0)
    a, b = np.sort(half[::2]), np.sort(half[1::2])
    cross = {(x, y) for i, j in simhash.trie_links(a, b, 64, 4, 4) for x, y in zip(a[i].tolist(), b[j].tolist())}
    assert cross == {(int(x), int(y)) for x in a for y in b if int(x ^ y).bit_count() <= 4}


def test_components_of_chains_stars_and_nothing(llm):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [
        (r.randrange(2000, 2060), r.randrange(2000, 2060)) for _ in range(40)] + [(5000, 5000)]
    df = llm.createDataFrame(edges, "u long, v long")
    linked = set(edges) | {(b, a) for a, b in edges}
    low = classes(sorted({x for e in edges for x in e}), lambda a, b: (a, b) in linked)
    got = {r["node"]: r["root"] for r in common.components(df).collect()}
    assert got == {k: v for k, v in low.items() if k != v}
    assert common.components(df.limit(0)).count() == 0


def units_by_hand(rows, unit, least):
    seen, gone = set(), Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for s, e in substring_dedup.units_of(t or "", unit):
            w = " ".join((t[s:e]).lower().split())
            if len(w.split()) >= least:
                if w in seen:
                    gone[(i, s, e)] += 1
                seen.add(w)
    return gone


@pytest.mark.parametrize("unit,least", [("line", 1), ("line", 4), ("sentence", 3), ("paragraph", 2)])
def test_substring_dedup(llm, unit, least):
    passage = words(60, 9) + ". " + words(12, 10) + "."
    rows = ODD + [(20, f"Intro one here. {passage} The end now."), (21, f"{passage}\nother line of words\n\nlast part"),
                  (22, "other  LINE of words\nother line of words\nx"), (23, f"Start. {passage}")]
    got = Counter((r["doc_id"], r["start"], r["end"]) for r in substring_dedup.repeated_units(
        table(llm, rows), unit, least).collect())
    assert got == units_by_hand(rows, unit, least)
    clean = {}
    for r in substring_dedup.deduplicate(table(llm, rows), unit, least).collect():
        cut = [(x["start"], x["end"]) for x in r["removed"]]
        assert cut == sorted(cut)
        clean.setdefault(r["doc_id"], []).append((r["text"], cut))
    for i, t in rows:
        assert any(kept == "".join(c for k, c in enumerate(t or "") if not any(s <= k < e for s, e in cut))
                   for kept, cut in clean[i])
    assert all("".join(t[s:e] for s, e in substring_dedup.units_of(t, unit)) == t for _, t in rows if t)


def test_substring_query_counts_by_document(llm, tmp_path):
    rows = [(1, "same sixteen words stand here in one long line of text that every document has today\nown"), (2, "x\nsame sixteen words stand here in one long line of text that every document has today")]
    table(llm, rows, 1).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_removed"], r["removed"]) for r in substring_dedup.op5_substring_dedup(llm, str(tmp_path)).collect()}
    assert got == {1: (0, ""), 2: (1, f"2:{2 + 84}")}


def test_substring_query_gives_a_row_for_each_row(llm, tmp_path):
    line = "same sixteen words stand here in one long line of text that every document has today"
    rows = [(7, line), (7, line), (8, "short"), (None, None)]
    table(llm, rows, 1).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["removed"]) for r in substring_dedup.op5_substring_dedup(llm, str(tmp_path)).collect())
    assert got == Counter({(7, ""): 1, (7, f"0:{len(line)}"): 1, (8, ""): 1, (None, ""): 1})


def test_dedup_does_not_depend_on_how_the_input_is_split(llm, tmp_path, monkeypatch):
    """The second read of the table is split in other places than the first."""
    rows = [r for r in near_copies(5) if r[0] is not None]
    path = str(tmp_path / "docs")
    table(llm, rows, 6).write.parquet(path)
    want = {r["doc_id"] for r in simhash.deduplicate(llm.read.parquet(path)).collect()}
    lines = [(k, f"line number {k % 9} of all the lines\nown {k}") for k in range(40)]
    lined = str(tmp_path / "lines")
    table(llm, lines, 6).write.parquet(lined)
    before = {r["doc_id"]: r["text"] for r in substring_dedup.deduplicate(llm.read.parquet(lined)).collect()}
    real = {m: m.staged for m in (simhash, substring_dedup)}

    def resplit(of):
        def staged(df, name):
            out = of(df, name)
            llm.conf.set("spark.sql.files.maxPartitionBytes", "64")
            return out
        return staged

    old = llm.conf.get("spark.sql.files.maxPartitionBytes")
    for m, of in real.items():
        monkeypatch.setattr(m, "staged", resplit(of))
    try:
        assert {r["doc_id"] for r in simhash.deduplicate(llm.read.parquet(path)).collect()} == want
        llm.conf.set("spark.sql.files.maxPartitionBytes", old)
        after = {r["doc_id"]: r["text"] for r in substring_dedup.deduplicate(llm.read.parquet(lined)).collect()}
    finally:
        llm.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert after == before


def test_empty_tables(llm):
    none = table(llm, [])
    assert exact_dedup.assign(none).count() == exact_dedup.deduplicate(none).count() == 0
    assert simhash.near_groups(none).count() == simhash.deduplicate(none).count() == 0
    assert substring_dedup.deduplicate(none).count() == 0


def passages_lost(rows):
    """Of (id, text) rows with ids in order: the spans each loses, without Spark."""
    seen, out = set(), {}
    for i, t in rows:
        own, spans = {}, []
        for s, e, w in substring_dedup.passages_of(t, substring_dedup.PASSAGE_WORDS):
            w = " ".join(w)
            if w in seen or s >= own.setdefault(w, e):
                spans.append((s, e))
        seen |= set(own)
        gone = sorted({k for s, e in spans for k in range(s, e)})
        edges = [k for k in gone if k - 1 not in gone], [k + 1 for k in gone if k + 1 not in gone]
        out[i] = ",".join(f"{s}:{e}" for s, e in zip(*edges))
    return out


def test_substring_query_removes_passages_of_short_sentences(llm, tmp_path):
    talk = "He came in. She saw. Who was it? Nobody knew. A door shut. Then rain fell. All slept."
    items = "- two eggs\n- some flour\n\n- milk\n- a pinch of salt\n- sugar\n- one lemon\n"
    han = "天地玄黃宇宙洪荒。日月盈昃辰宿列張。寒來暑往秋收冬藏。閏餘成歲律呂調陽。"
    rows = [(1, f"First own words. {talk} Last own words."), (2, f"Other beginning here. {talk} Other end."),
            (3, f"List one\n{items}end of one"), (4, f"List two\n{items}end of two"), (5, f"甲乙。{han}丙丁。"),
            (6, f"戊己。{han}庚辛。"), (7, "Thank you all. And one thing said only here today."),
            (8, "Thank you all. Another thing that nobody else has said."), (9, "ha. " * 40),
            (10, "A long sentence of many more words that stands here on its own and goes on. Oh no.\n" * 3),
            (11, "Short line alone\nsome text of the first document"), (12, "Short line alone\nand other words of the second")]
    table(llm, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["removed"] for r in substring_dedup.op5_substring_dedup(llm, str(tmp_path)).collect()}
    assert got == passages_lost(rows)
    for i, part in ((2, talk + " "), (4, items), (6, han)):
        at = rows[i - 1][1].index(part)
        assert got[i] == f"{at}:{at + len(part)}"
    # First copies, a short sentence inside other lines, and a short line beside others.
    assert [got[i] for i in (1, 3, 5, 7, 8, 11, 12)] == [""] * 7
    line = len(rows[9][1]) // 3
    assert got[9] == "64:160" and got[10] == f"{line}:{3 * line}"  # the first sixteen words, the first line stay


def test_passages_equal_all_repeated_runs_of_sentences(llm):
    """Independent of the operator: every run of whole sentences of 16 words that an earlier document holds goes."""
    import random

    r = random.Random(8)
    pool = [" ".join(f"w{r.randrange(10**6)}" for _ in range(r.choice([1, 2, 3, 5, 9, 18]))) for _ in range(60)]
    texts, seen, want = [], set(), {}
    for i in range(120):
        at = r.randrange(50)
        own = [f"own{i} {k} {r.randrange(10**9)}" for k in range(r.randrange(4))]
        own[r.randrange(len(own) + 1):0] = pool[at : at + r.randrange(12)]
        texts.append([(s, r.choice([". ", ".\n", "! ", "?\n"])) for s in own])
    for i, sentences in enumerate(texts):
        spans, at, gone, runs = [], 0, set(), set()
        for s, stop in sentences:
            spans.append((at, at + len(s + stop)))
            at += len(s + stop)
        for a in range(len(sentences)):
            for b in range(a + 1, len(sentences) + 1):
                part = " ".join((s + stop.strip()).lower() for s, stop in sentences[a:b])
                if len(part.split()) >= 16:
                    runs.add(part)
                    if part in seen:
                        gone.update(range(spans[a][0], spans[b - 1][1]))
        seen |= runs
        want[i] = gone
    rows = table(llm, [(i, "".join(s + stop for s, stop in t)) for i, t in enumerate(texts)])
    got = substring_dedup.removals(substring_dedup.numbered(rows), "passage", 16).collect()
    assert {x["doc_id"]: {k for s in x["removed"] for k in range(s["start"], s["end"])} for x in got} == want
    assert sum(map(bool, want.values())) > 20


def test_paragraphs_of_a_long_text_are_cut_as_before():
    import random
    import re

    old, r = re.compile(r"(?:[^\n]|\n(?!\s*\n))+(?:\n\s*)?|\n\s*"), random.Random(9)
    for _ in range(3000):
        t = "".join(r.choice(["a", "b ", "\n", "\n\n", " ", "\t", "\u2028"]) for _ in range(r.randrange(30)))
        assert [m.span() for m in old.finditer(t)] == [m.span() for m in substring_dedup.UNITS["paragraph"].finditer(t)]
