"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlink.llm.common import documents, id_and_text, staged

#: The kinds in the order that ties take.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
GROUP = re.compile(r"[0-9]+")
GAP = re.compile(r"[ .()/-]{0,3}")
#: Bounds of a segment that the field proposes itself; base spans have none.
MOST_GROUPS, MOST_CHARS = 8, 64


class Segment(NamedTuple):
    start: int
    end: int
    kind: int
    features: tuple[int, ...]


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum((int(c) * 2 - 9 if c > "4" else int(c) * 2) for c in digits[-2::-2])) % 10 == 0


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping per kind, by start, then kind.

    The email pattern is applied from each @ outwards, which finds the same
    matches in time linear in the text.
    """
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), 0))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if GROUP.search(text):
        out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if _octets(m.group())]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text)
                    if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


#: Names of the whole-span features; each kind has its own weight for each.
FEATURES = ("bias", "left edge", "right edge", "whole run", "checksum", "octets", "plus", "brackets", "dots only",
            "one separator", "mixed separators", "one group", "two or three groups", "four groups", "digits under 9",
            "digits 9 to 12", "digits 13 to 16", "digits over 16", "domain ends in letters", "three labels")
AT = {n: i for i, n in enumerate(FEATURES)}


def _edges(text: str, start: int, end: int) -> list[int]:
    out = []
    if start == 0 or not (text[start - 1].isalnum() or text[start - 1] in "@_"):
        out.append(AT["left edge"])
    if end >= len(text) or not (text[end].isalnum() or text[end] in "@_"):
        out.append(AT["right edge"])
    return out


def _numeric(text: str, groups: list[tuple[int, int]], start: int, end: int, chain: int) -> tuple[int, ...]:
    digits = "".join(text[a:b] for a, b in groups)
    between = [text[groups[i][1] : groups[i + 1][0]] for i in range(len(groups) - 1)]
    n, k = len(digits), len(groups)
    f = [AT["bias"], *_edges(text, start, end)]
    f.append(AT["digits under 9"] if n < 9 else AT["digits 9 to 12"] if n <= 12 else AT["digits 13 to 16"] if n <= 16
             else AT["digits over 16"])
    if k == chain:
        f.append(AT["whole run"])
    if k == 1:
        f.append(AT["one group"])
    elif k <= 3:
        f.append(AT["two or three groups"])
    elif k == 4:
        f.append(AT["four groups"])
    if between:
        f.append(AT["one separator"] if len(set(between)) == 1 else AT["mixed separators"])
        if set(between) == {"."}:
            f.append(AT["dots only"])
            if k == 4 and _octets(text[groups[0][0] : groups[-1][1]]):
                f.append(AT["octets"])
    if text[start] == "+":
        f.append(AT["plus"])
    if "(" in text[start:end]:
        f.append(AT["brackets"])
    if luhn(digits):
        f.append(AT["checksum"])
    return tuple(f)


def proposals(text: str) -> list[Segment]:
    """Candidate segments: runs of up to MOST_GROUPS digit groups, and parts around an @."""
    out: list[Segment] = []
    at = text.find("@")
    while at >= 0:
        start = at
        while start > 0 and at - start < MOST_CHARS and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1, at + 1 + MOST_CHARS)):
            starts = [start, *[i + 1 for i in range(start, at - 1) if text[i] in "._%+-"]][:4]
            labels = m.group().split(".")
            ends = [at + 1 + len(".".join(labels[:k])) for k in range(len(labels), 1, -1)][:4]
            for s in starts:
                for e in ends:
                    tail = text[at + 1 : e].split(".")
                    f = [AT["bias"], *_edges(text, s, e)]
                    f += [AT["whole run"]] * (s == start and e == m.end())
                    f += [AT["domain ends in letters"]] * (tail[-1].isalpha() and len(tail[-1]) > 1)
                    f += [AT["three labels"]] * (len(tail) >= 3)
                    out.append(Segment(s, e, 0, tuple(f)))
        at = text.find("@", at + 1)
    chain: list[tuple[int, int]] = []

    def close() -> None:
        for i in range(len(chain)):
            for j in range(i, min(len(chain), i + MOST_GROUPS)):
                a, b = chain[i][0], chain[j][1]
                n = sum(e - s for s, e in chain[i : j + 1])
                if b - a > MOST_CHARS or n > 19:
                    break
                if n < 7 and j - i != 3:
                    continue
                starts = [a]
                if i == 0 or text[a - 1] in "+(":
                    k = a
                    while k > 0 and text[k - 1] in "+(" and a - k < 2:
                        k -= 1
                    starts += [k] * (k < a)
                for s in starts:
                    f = _numeric(text, chain[i : j + 1], s, b, len(chain))
                    if j - i == 3 and s == a:
                        out.append(Segment(s, b, 1, f))
                    if 12 <= n <= 19 and s == a:
                        out.append(Segment(s, b, 2, f))
                    if 7 <= n <= 15:
                        out.append(Segment(s, b, 3, f))

    for m in GROUP.finditer(text):
        if chain and not (GAP.fullmatch(text, chain[-1][1], m.start())):
            close()
            chain = []
        chain.append(m.span())
        if len(chain) > 4 * MOST_GROUPS:  # a long table of numbers: what is behind can't be part of a later segment
            close()
            chain = chain[-MOST_GROUPS + 1 :]
    close()
    return sorted(set(out))


def _score(seg: Segment, weights: list[list[float]]) -> float:
    w = weights[seg.kind]
    return sum(w[f] for f in seg.features)


def best_segments(segments: list[Segment], weights: list[list[float]]) -> list[Segment]:
    """The highest-scoring labelling of the text into segments and other characters.

    A character outside any segment scores 0, so the dynamic program needs the
    segments' ends only: best up to an end is the best so far or a segment
    plus the best up to its start.
    """
    ends, best, back = [-1], [0.0], [None]
    for seg in sorted(segments, key=lambda s: (s.end, s.start, s.kind)):
        s = _score(seg, weights)
        if s <= 0:
            continue
        before = bisect_right(ends, seg.start) - 1
        if best[before] + s > best[-1]:
            if ends[-1] == seg.end:
                best[-1], back[-1] = best[before] + s, (seg, before)
            else:
                ends.append(seg.end)
                best.append(best[before] + s)
                back.append((seg, before))
    out, k = [], len(ends) - 1
    while k > 0:
        seg, k = back[k]
        out.append(seg)
    return out[::-1]


def clusters(segments: list[Segment]) -> list[list[Segment]]:
    """Segments in runs that overlap; no labelling ties one run to another."""
    out: list[list[Segment]] = []
    reach = -1
    for seg in sorted(segments):
        if seg.start >= reach:
            out.append([])
        out[-1].append(seg)
        reach = max(reach, seg.end)
    return out


def fit_weights(lattices: list[tuple[list[Segment], list[bool]]], epochs: int = 12, rate: float = 0.3) -> list[list[float]]:
    """Maximum likelihood of the marked segmentations by stochastic gradient steps.

    Each lattice is one cluster of overlapping segments with those of the
    silver segmentation marked; expectations come from forward and backward
    sums over all segmentations of the cluster.
    """
    weights = [[0.0] * len(FEATURES) for _ in KINDS]
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for segments, gold in lattices:
            score = [_score(s, weights) for s in segments]
            points = sorted({p for s in segments for p in (s.start, s.end)})
            at = {p: i for i, p in enumerate(points)}
            fore, back = [0.0] + [-math.inf] * (len(points) - 1), [-math.inf] * (len(points) - 1) + [0.0]
            add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y))) if min(x, y) > -math.inf else max(x, y)
            into: dict[int, list[int]] = {}
            outof: dict[int, list[int]] = {}
            for i, s in enumerate(segments):
                into.setdefault(at[s.end], []).append(i)
                outof.setdefault(at[s.start], []).append(i)
            for p in range(1, len(points)):
                fore[p] = fore[p - 1]
                for i in into.get(p, ()):
                    fore[p] = add(fore[p], fore[at[segments[i].start]] + score[i])
            for p in range(len(points) - 2, -1, -1):
                back[p] = back[p + 1]
                for i in outof.get(p, ()):
                    back[p] = add(back[p], back[at[segments[i].end]] + score[i])
            for i, s in enumerate(segments):
                p = math.exp(min(0.0, fore[at[s.start]] + score[i] + back[at[s.end]] - fore[-1]))
                g = float(gold[i]) - p
                if abs(g) > 1e-6:
                    w = weights[s.kind]
                    for f in s.features:
                        w[f] += step * (g - 1e-4 * w[f])
    return weights


def silver(text: str) -> list[tuple[list[Segment], list[bool]]]:
    """Lattices of a text with its base spans marked, the first of overlapping ones."""
    gold, reach = set(), -1
    for s, e, k in base_spans(text):
        if s >= reach:
            gold.add((s, e, k))
            reach = e
    return [(c, [(s.start, s.end, s.kind) in gold for s in c]) for c in clusters(proposals(text))]


def fit(docs: DataFrame, texts: int = 1500, most_chars: int = 100_000, text_col: str = "text") -> list[list[float]]:
    """Weights learnt from a bounded sample: ``texts`` different texts with a digit or an @.

    The sample takes the smallest text hashes among texts of up to
    ``most_chars`` characters. The base patterns mark its segments (there are
    no other labels); only the lattices come to the driver.
    """
    rows = docs.select(docs[text_col].alias("text")).where(F.col("text").rlike("[0-9@]") & (F.length("text") <= most_chars))
    rows = rows.withColumn("h", F.xxhash64("text"))
    picked = staged(rows.select("h").distinct().orderBy("h").limit(texts), "pii-sample")
    sample = rows.join(F.broadcast(picked), "h").groupBy("h").agg(F.first("text").alias("text"))

    def lattices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(int(h), n, s.start, s.end, s.kind, list(s.features), g) for h, t in zip(f["h"], f["text"])
                   for n, (segs, gold) in enumerate(silver(t)[:50]) for s, g in zip(segs[:200], gold[:200])]
            yield pd.DataFrame(out, columns=["h", "n", "start", "end", "kind", "features", "gold"])

    got: dict[tuple[int, int], tuple[list, list]] = {}
    table = sample.mapInPandas(lattices, "h long, n int, start int, end int, kind int, features array<int>, gold boolean")
    for r in sorted(table.collect(), key=lambda r: (r["h"], r["n"], r["start"], r["end"], r["kind"])):
        segs, gold = got.setdefault((r["h"], r["n"]), ([], []))
        segs.append(Segment(r["start"], r["end"], r["kind"], tuple(r["features"])))
        gold.append(r["gold"])
    return fit_weights(list(got.values()))


def spans_of(text: str, weights: list[list[float]]) -> list[tuple[int, int, int, bool]]:
    """(start, end, kind, base) of the base spans and of the field's segments clear of them."""
    if "@" not in text and not GROUP.search(text):
        return []
    base = base_spans(text)
    out = [(s, e, kind, True) for s, e, kind in base]
    runs: list[list[int]] = []  # what base spans cover, as separate intervals
    for s, e, _ in base:
        if runs and s < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    starts = [s for s, _ in runs]
    for group in clusters(proposals(text)):
        for seg in best_segments(group, weights):
            k = bisect_left(starts, seg.end) - 1
            if k < 0 or runs[k][1] <= seg.start:
                out.append((seg.start, seg.end, seg.kind, False))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end, kind, _ = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][1])
            k += 1
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def masker(weights: list[list[float]]):
    """Column function: a text with its personal data masked; null stays null."""
    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, spans_of(t, weights)) for t in texts], dtype=object)

    return mask


def find(docs: DataFrame, weights: list[list[float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` of every row.

    ``spans``: array of (kind, start, end, base) in code points, by start,
    then kind. A null or empty text has none. Texts are read whole; a row
    needs time linear in its text. Repeated rows and null ids are handled like
    any other row; an empty table gives an empty result; other columns are
    ignored.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "spans": [
                [{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, e, k, b in spans_of(t, weights)]
                for t in f["text"]]})

    return rows.mapInPandas(look, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents; the counts and the hash are of base spans."""
    docs = documents(spark, sf_dir)
    found = find(docs, fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
