"""SentencePiece, PII, packing, fingerprints, quality, sharding and licences against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_fixtures import ODD, SF01, llm, table, words  # noqa: F401
from pyspark.sql import functions as F

from fieldlink.llm import cutting_stock, license_scan, packing, pii, piecewise, quality, sharding, subwords, tokens


# --- SentencePiece -----------------------------------------------------------------------------


def test_subwords_equal_the_library_and_round_trip(llm):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=subwords.default_model())
    rows = ODD + [(30, "  two  spaces\tand\ttabs \n\n x"), (31, "日本語 😀 é́ a\x00b"), (32, "12 345.67 <s> </s>")]
    rows += [(100 + r["doc_id"], r["text"]) for r in llm.read.parquet(f"{SF01}/documents.parquet").limit(60).collect()]
    enc = subwords.encode(table(llm, rows), subwords.default_model())
    got = Counter((r["doc_id"], bytes(r["ids"])) for r in enc.collect())
    assert got == Counter((i, np.array(sp.encode(t or ""), "<u4").tobytes()) for i, t in rows)
    back = subwords.decode(enc, subwords.default_model())
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t in rows)
    d = subwords.digests(table(llm, rows), subwords.default_model())
    assert d.where("NOT round_trip").count() == 0 and d.count() == len(rows)
    assert subwords.encode(table(llm, []), subwords.default_model()).count() == 0


def test_subword_states_are_the_prefixes_own_segmentation():
    v = subwords.Vocabulary(subwords.default_model())
    for w in ["▁international", "▁internet", "▁interna", "ñandú", "▁▁▁x"]:
        v.encode_words([w])
        ids = [v.ids[p] for p in v.merges(w)]
        assert np.frombuffer(v.words[w], "<u4").tolist() == ids


# --- PII ---------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            total = sum(d if n % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for n, d in enumerate(reversed(digits)))
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 12 <= len(digits) <= 19 and total % 10 == 0
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_plain_patterns():
    r = random.Random(2)
    for _ in range(4000):
        t = "".join(r.choice(["a", "b.c", "@", ".", "1", "22", "255", "4845168114407329", "-", " ", "+", "(", ")", "é"])
                    for _ in range(r.randint(1, 25)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_best_segments_equal_enumeration():
    r = random.Random(3)
    for _ in range(200):
        segs = [pii.Segment(s := r.randrange(12), s + r.randint(1, 5), r.randrange(4), (r.randrange(20),)) for _ in range(7)]
        w = [[r.uniform(-2, 3) for _ in pii.FEATURES] for _ in pii.KINDS]
        worth = lambda c: sum(pii._score(s, w) for s in c)
        best = max((worth(c) for n in range(8) for c in itertools.combinations(segs, n)
                    if all(a.end <= b.start for a, b in itertools.pairwise(sorted(c)))))
        got = pii.best_segments(segs, w)
        assert all(a.end <= b.start for a, b in itertools.pairwise(got)) and math.isclose(worth(got), best, abs_tol=1e-9)


def test_pii_query_and_masking(llm, tmp_path):
    rows = ODD + [(40, "mail a.b@x.example.com, call +1 (555) 010-4477 é from 10.0.0.255 or 999.1.1.1"),
                  (41, "card 4845168114407329 no 4845168114407328 and 7536784127813050 4845168114407329"), (42, "none 12 34")]
    rows += [(100 + k, f"{words(5, k)} {words(1, k)}@mail{k % 9}.example.com +1 (0{k % 10}7) 555-{1000 + k}") for k in range(60)]
    df = table(llm, rows).repartition(1)
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    import hashlib

    weights = pii.fit(df)
    for r in pii.op3_pii(llm, str(tmp_path)).collect():
        text = next(t or "" for i, t in rows if i == r["doc_id"])
        base = plain_spans(text)
        s = [f"{list(PLAIN)[k]}:{a}:{b}" for a, b, k in base]
        assert hashlib.sha256(",".join(s).encode()).hexdigest() == r["base_sha256"]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[2] == n for x in base) for n in range(4)]
        every = [x for x in r["spans"].split(",") if x]
        assert set(s) <= set(every)
        for extra in set(every) - set(s):
            _, a, b = extra.split(":")
            assert all(int(b) <= c or int(a) >= d for c, d, _ in base)
    clean = {r["doc_id"]: r["m"] for r in df.select("doc_id", pii.masker(weights)("text").alias("m")).collect()}
    assert clean[40].startswith("mail [EMAIL], call [PHONE] é from [IP] or 999") and clean[42] == "none 12 34" and clean[1] is None
    assert pii.find(table(llm, []), weights).count() == 0
    assert pii.fit(table(llm, [])) == [[0.0] * len(pii.FEATURES)] * 4


def test_pii_long_texts_take_linear_time():
    import time

    t0 = time.time()
    for t in ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "+1" + "(" * 300_000, "a@" * 100_000, "1." * 100_000]:
        pii.spans_of(t, [[0.1] * len(pii.FEATURES)] * 4)
    assert time.time() - t0 < 60


# --- packing -----------------------------------------------------------------------------------


def test_knapsack_prices_like_enumeration():
    r = np.random.default_rng(1)
    for _ in range(20):
        sizes, duals, room = np.sort(r.choice(np.arange(1, 12), 4, replace=False)), r.random(4), 13
        worth, pattern = cutting_stock.price(duals, sizes, room)
        best = max(float(duals @ np.array(c)) for c in itertools.product(*[range(room // s + 1) for s in sizes])
                   if sizes @ np.array(c) <= room)
        assert math.isclose(worth, best) and math.isclose(float(duals @ pattern), best) and sizes @ pattern <= room


def test_patterns_cover_the_histogram_with_few_bins():
    r = np.random.default_rng(2)
    hist = {int(s): int(r.integers(1, 300)) for s in r.choice(np.arange(1, 257), 90, replace=False)}
    sizes, used = cutting_stock.patterns(hist, 256)
    have = sum(p * n for p, n in used)
    assert (have >= np.array([hist[s] for s in sizes])).all() and all(sizes @ p <= 256 for p, _ in used)
    program = cutting_stock.solve(sizes, np.array([hist[s] for s in sizes], float), 256)
    best = sum(x for _, x in program)  # no whole solution has fewer
    assert best - 1e-6 <= sum(n for _, n in used) <= best + len(sizes) / 2
    assert cutting_stock.patterns({}, 256)[1] == []


def check_packed(rows, docs, room=4096):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for i, t in docs:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        for s in range(0, len(ids), room):
            want[(i, s, len(ids[s : s + room]), zlib.crc32(ids[s : s + room].tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= room
    total = sum(r["length"] for r in rows)
    return total, sum(room for s in seqs)


def test_packing_rows(llm):
    docs = ODD + [(50 + k, "same length " * 20) for k in range(200)]
    rows = packing.pack(table(llm, docs), packing.default_tokenizer()).collect()
    check_packed(rows, docs)
    assert packing.pack(table(llm, []), packing.default_tokenizer()).count() == 0


def test_packing_query_pads_little(llm):
    docs = [(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{SF01}/documents.parquet").collect()]
    total, padded = check_packed(packing.op4_packing(llm, SF01).collect(), docs)
    assert padded <= 1.04 * total


def test_word_encoder_equals_the_tokenizer_when_its_cache_is_small(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    e = tokens.WordEncoder(packing.default_tokenizer())
    texts = [words(300, k).title() + ". İx. <|endoftext|>A, «b». é. ΣΑΣ. 3,4 <|ENDOFTEXT|> x\x85y" for k in range(400)]
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)] == want


# --- fingerprints ------------------------------------------------------------------------------


def test_common_subsequence_equals_the_table():
    r = random.Random(5)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(1, 20))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert piecewise._common(a, b) == t[-1][-1]


def test_fingerprint_of_a_long_text_does_not_depend_on_blocks(monkeypatch):
    text = words(20_000, 3)
    whole = piecewise.fingerprint(text)
    monkeypatch.setattr(piecewise, "BLOCK", 1000)
    assert piecewise.fingerprint(text) == whole


@pytest.mark.parametrize("parts", [1, 3])
def test_fingerprints_follow_descending_ids(llm, parts):
    import hashlib

    rows = [(i, t) for i, t in ODD if i not in (7, None)] + [(1000 + 7 * k, words(20 + k, k)) for k in range(150)]
    order = sorted(rows, key=lambda r: -r[0])
    want = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        edited = t[: n - n // 2] + nxt[: n // 2]
        fp, ep, np_ = map(piecewise.fingerprint, (t, edited, nxt))
        want[i] = (n, hashlib.sha256(edited.encode()).hexdigest(), fp, ep, piecewise.likeness(fp, ep), piecewise.likeness(fp, np_))
    got = {r["doc_id"]: tuple(r)[1:] for r in piecewise.with_next(table(llm, rows, parts)).collect()}
    assert got == want
    long = [v for i, v in want.items() if i >= 1400]
    assert np.mean([v[4] for v in long]) > 0.4 and np.mean([v[5] for v in long]) < 0.1


def test_fingerprints_of_repeated_and_null_ids(llm):
    got = piecewise.with_next(table(llm, ODD)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in ODD)
    nulls = piecewise.with_next(table(llm, [(None, "a b"), (None, "c")])).collect()
    assert len(nulls) == 2 and piecewise.with_next(table(llm, [])).count() == 0
    one = piecewise.with_next(table(llm, [(1, "only one")])).collect()
    assert one[0]["near_next"] == 1.0


def test_likeness_of_short_and_of_widely_edited_signatures():
    assert piecewise.likeness("3:ABC:AB", "3:ABCD:CD") == 6 / 7  # under four chunks on a side
    a = piecewise.ALPHABET
    spread = "".join("-" if i % 4 == 3 else c for i, c in enumerate(a))  # no four in a row are left
    assert piecewise.likeness(f"3:{a}:", f"3:{spread}:") == 0.75
    r = np.random.default_rng(3)
    draw = lambda: "3:" + "".join(r.choice(list(a), 64)) + ":"
    assert np.mean([piecewise.likeness(draw(), draw()) for _ in range(200)]) < 0.01


@pytest.mark.parametrize("room", [10, 300, 4100])
def test_packing_in_rooms_that_units_do_not_divide(llm, room):
    docs = [(k, words(3 * k + 1, k)) for k in range(60)] + [(99, words(5000, 99))]
    rows = packing.pack(table(llm, docs), packing.default_tokenizer(), room).collect()
    held, total = Counter(), Counter()
    for r in rows:
        held[r["sequence_id"]] += r["length"]
        total[r["doc_id"]] += r["length"]
    assert max(held.values()) <= room and all(total[r["doc_id"]] == r["doc_tokens"] for r in rows)
    assert len(held) <= 1.2 * -(-sum(held.values()) // room) + 1 or room == 10


# --- quality -----------------------------------------------------------------------------------


def test_marginals_equal_enumeration():
    r = np.random.default_rng(4)
    counts = np.array([3, 1, 4, 2])
    starts = np.cumsum(counts) - counts
    gain, move = r.normal(size=counts.sum()), r.normal(size=(2, 2))
    p, pairs, _ = quality.marginals(gain, move, starts, counts)
    seen = np.zeros((2, 2))
    for s, c in zip(starts, counts):
        mass, good, moved = 0.0, np.zeros(c), np.zeros((2, 2))
        for y in itertools.product([0, 1], repeat=int(c)):
            e = math.exp(sum((1 if v else -1) * gain[s + k] / 2 for k, v in enumerate(y)) + sum(
                move[a, b] for a, b in itertools.pairwise(y)))
            mass += e
            good += e * np.array(y)
            for a, b in itertools.pairwise(y):
                moved[a, b] += e
        assert np.allclose(p[s : s + c], good / mass)
        seen += moved / mass
    assert np.allclose(pairs, seen)


def test_quality_on_the_held_out_fold(llm):
    got = quality.op7_quality_classifier(llm, SF01)
    truth = {r["doc_id"]: r["quality"] for r in llm.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == llm.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert good and bad and np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97 and np.mean([s < 0.3 for s in bad]) > 0.8


def test_quality_ignores_held_out_labels_and_other_columns(llm):
    docs, labels = llm.read.parquet(f"{SF01}/documents.parquet"), llm.read.parquet(f"{SF01}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(
        F.col("quality")))
    a, b = quality.fit(docs, labels, 100), quality.fit(docs.select("doc_id", "text"), flipped, 100)
    assert np.allclose(a.weights, b.weights) and a.bias == b.bias
    got = quality.score(table(llm, ODD), a).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    by_text = defaultdict(set)
    for r, in [(r,) for r in got]:
        by_text[r["doc_id"]].add(r["score"])
    assert all(len(v) == 1 for k, v in by_text.items() if k == 7)
    assert quality.fit(docs, labels.limit(0)) is None
    assert quality.score(table(llm, []), a).count() == 0 and quality.score(table(llm, ODD), None).where("score = 0.5").count() == len(ODD)


# --- sharding ----------------------------------------------------------------------------------


def draw(key, level, child, weight):
    h = 42
    for x in (key, level, child):
        h = h if x is None else xxhash.xxh64_intdigest(int(x).to_bytes(8, "little", signed=True), h)
    return -math.log(((h >> 12) + 0.5) / (1 << 52)) / weight


def shard_of(key, tree):
    regions = {s.region for s in tree}
    weigh = lambda ss: sum(s.weight for s in ss)
    pick = lambda level, kids: next(iter(kids)) if len(kids) == 1 else min(kids, key=lambda k: draw(key, level, k, kids[k]))
    g = pick(1, {r: weigh(s for s in tree if s.region == r) for r in regions})
    k = pick(1000 + g, {r: weigh(s for s in tree if (s.region, s.rack) == (g, r)) for r in {s.rack for s in tree if s.region == g}})
    return pick(1_000_000 + 1000 * g + k, {s.shard: s.weight for s in tree if (s.region, s.rack) == (g, k)})


def test_sharding(llm):
    rows = ODD + [(500 + k, words(k % 9, k)) for k in range(800)]
    tree = sharding.even_tree(16)
    got = sharding.assign(table(llm, rows), tree, sharding.grown_tree(tree)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", shard_of(i, tree),
                    shard_of(i, sharding.grown_tree(tree))) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 16
    assert any(r["grown_shard"] == 16 for r in got)
    assert sharding.assign(table(llm, []), tree, sharding.grown_tree(tree)).count() == 0


def test_a_changed_weight_moves_rows_only_through_its_subtree(llm):
    import dataclasses

    tree = sharding.even_tree(16)
    heavy = [dataclasses.replace(s, weight=3.0) if s.shard == 5 else s for s in tree]
    df = llm.range(3000).withColumnRenamed("id", "k")
    both = sharding.place(sharding.place(df, "k", tree, "a"), "k", heavy, "b").where("a <> b").collect()
    region = {s.shard: s.region for s in tree}
    assert both and all(region[r["b"]] == region[5] for r in both)
    assert all(r["b"] == 5 for r in both if region[r["a"]] == region[5] and r["a"] // 2 == 2)


# --- licences ----------------------------------------------------------------------------------


def test_license_scan(llm):
    r = random.Random(6)
    vocab = ["cc", "by", "CC", "all", "rights", "reserved", "general", "Public", "license", "x", "nc", "4", "0", "é", "the"]
    seps = [" ", "-", ". ", "\n", "--"]
    rows = ODD + [(60 + k, "".join(r.choice(vocab) + r.choice(seps) for _ in range(r.randint(0, 40)))) for k in range(300)]
    rows += [(900, "Licensed under CC BY-NC 4.0."), (901, "Released under the MIT License."),
             (902, "This work is licensed under the GNU General Public License, version 3."),
             (903, "Licensed under the Apache License, Version 2.0. " * 3), (904, "the mitten license by all")]
    df = table(llm, rows)
    df.select("doc_id", "text").createOrReplaceTempView("lic")
    found = license_scan.scan(df).collect()
    assert len(found) == len(rows)
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    want = Counter()
    for i, t in rows:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        at = sorted(k for p in phrases.values() for k in range(len(ws)) if ws[k : k + len(p)] == p)
        labels = tuple(sorted(n for n, p in phrases.items() if any(ws[k : k + len(p)] == p for k in range(len(ws)))))
        want[(i, len(ws), tuple(at), labels)] += 1
    assert Counter((x["doc_id"], x["n_words"], tuple(x["places"]), tuple(sorted({
        m["label"] for m in x["matches"] if m["base"]}))) for x in found) == want
    labels = {x["doc_id"]: {m["label"] for m in x["matches"]} for x in found}
    assert labels[900] == {"cc-by", "cc-by-nc"} and labels[901] == {"mit"} and labels[902] == {"gpl", "gpl-3.0"}
    assert labels[903] == {"apache-2.0"} and labels[904] == set()
    for x in found:  # every notice stands where it is said to
        ws = license_words(next(t for i, t in rows if i == x["doc_id"]))
        for m in x["matches"]:
            assert any(t.label == m["label"] and ws[m["start"] + t.key_at : m["start"] + t.key_at + len(t.key.split())] == t.key.split()
                       for t in license_scan.TEMPLATES if m["start"] + t.key_at >= 0)
    assert license_scan.scan(table(llm, [])).count() == 0


def license_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def test_license_query_has_defined_values_without_words(llm, tmp_path):
    table(llm, [(1, None), (2, "All rights reserved. all RIGHTS reserved")], 1).select("doc_id", "text").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.op10_license_scans(llm, str(tmp_path)).collect()}
    assert got == {1: (0, 0, None, None, "", "", 0.0), 2: (6, 2, 0, 3, "reserved", "reserved", 1.0)}


def test_license_is_found_without_the_rarest_words(llm):
    """The words of the key phrase are common; a text has it, but other words where the three rarest would stand."""
    t = next(t for t in license_scan.TEMPLATES if t.label == "bsd")
    rows = [(k, "source and binary forms") for k in range(50)]
    text = " ".join("other" if w in ("are", "in", "modification") else w for w in t.words)
    rows.append((99, "Some words before. " + text))
    df = table(llm, rows)
    idf = license_scan.word_rarity(df, license_scan.TEMPLATES)
    assert sorted(sorted(set(t.words), key=lambda w: (-idf[w], w))[:3]) == ["are", "in", "modification"]
    found = {r["doc_id"]: [(m["label"], m["start"]) for m in r["matches"]] for r in license_scan.scan(df).collect()}
    assert found[99] == [("bsd", 3)] and not any(found[k] for k in range(50))
