"""SimHash near-dedup: fingerprints, and a binary trie joined with itself."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlink.llm.common import components, documents, id_and_text, staged, unused

BITS = 64
#: Hashes counted at a time, which bounds a very long text's memory.
BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash over shingles of ``words`` words, as an unsigned 64-bit number.

    A-Z are lower-cased and words are split at ASCII white space. A bit is set
    if it is set in over half the shingles' XXH64. A text of fewer words is one
    shingle; one without words (or null) has fingerprint 0.
    """
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined, at = b" ".join(tokens), 0
    starts, ends = [], []
    for t in tokens:
        starts.append(at)
        ends.append(at + len(t))
        at += len(t) + 1
    ends = ends[min(words, len(tokens)) - 1 :]
    h64, n = xxhash.xxh64_intdigest, len(ends)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, BLOCK):
        h = np.array([h64(joined[a:b], seed) for a, b in zip(starts[k : k + BLOCK], ends[k : k + BLOCK])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in range(BITS) if 2 * int(ones[i]) > n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``doc_id, digest, fp`` of every row: the text's MD5 and the 64 bits as a long."""
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = np.array([fingerprint(t, words) for t in f["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": f["doc_id"], "digest": f["digest"], "fp": fp})

    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text")
    return rows.mapInPandas(of, f"doc_id {dict(rows.dtypes)['doc_id']}, digest binary, fp long")


# --- the join of the trie with itself ---------------------------------------------------------


def segments_for(n: int, distance: int) -> int:
    """Of how many rotations the join is made for n fingerprints; any number gives the same links.

    With m segments, two fingerprints within ``distance`` differ by at most
    distance // m bits in one segment, so a trie that starts with that segment
    has that small budget there. The estimate is the node pairs visited.
    """
    def cost(m: int) -> float:
        width = BITS // m
        near = sum(math.comb(width, e) for e in range(distance // m + 1))
        return m * (min(near, max(n, 1)) + near * n / 2.0**width)

    return min(range(1, distance // 2 + 2), key=cost)


def rotated(fp: np.ndarray, by: int) -> np.ndarray:
    """The 64 bits turned left, so that the segment that begins ``by`` bits down comes first."""
    fp = fp.view(np.uint64) if fp.dtype != np.uint64 else fp
    return fp if by == 0 else (fp << np.uint64(by)) | (fp >> np.uint64(BITS - by))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_links(a: np.ndarray, b: np.ndarray, head: int, head_budget: int, budget: int, start: int = 0,
               step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of sorted unsigned arrays with a[i], b[j] at most ``budget`` bits apart.

    The arrays are binary tries in preorder: a node is the run of values that
    share a prefix. Node pairs descend together; each carries the bits its
    prefixes differ in so far, and is dropped over ``budget`` (over
    ``head_budget`` within the first ``head`` bits). ``a is b`` joins a trie
    with itself and gives every pair once. Pairs wait on a stack and are taken
    ``step`` at a time, so memory stays bounded.
    """
    self_join = a is b
    if not len(a) or not len(b):
        return
    stack = [(start, np.array([[0, len(a), 0, len(b), int(_popcount((a[:1] ^ b[:1]) >> np.uint64(BITS - start))[0]) if start else 0]], np.int64))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > step:
            stack.append((depth, pairs[step:]))
            pairs = pairs[:step]
        if self_join:
            single = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 0] == pairs[:, 2]) & (pairs[:, 3] - pairs[:, 2] == 1)
            pairs = pairs[~single]
        # Small node pairs are compared value by value; that visits the same leaves.
        size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        small = size <= 16
        if depth >= BITS:
            small[:] = True
        if small.any():
            leaf, n = pairs[small], size[small]
            for k in range(0, len(leaf), step // 16):
                lf, m = leaf[k : k + step // 16], n[k : k + step // 16]
                pos = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                right = np.repeat(lf[:, 3] - lf[:, 2], m)
                i = np.repeat(lf[:, 0], m) + pos // right
                j = np.repeat(lf[:, 2], m) + pos % right
                ok = _popcount(a[i] ^ b[j]) <= budget
                if self_join:
                    ok &= (i < j)
                if ok.any():
                    yield i[ok], j[ok]
            pairs = pairs[~small]
        if not len(pairs):
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)

        def split(v, lo, hi):
            """Where the values with the next bit set begin in each run lo..hi."""
            rest = np.uint64((1 << (BITS - 1 - depth)) - 1)
            want = (v[lo] & ~(rest | bit)) | bit
            left, right = lo.copy(), hi.copy()
            while True:
                open_ = left < right
                if not open_.any():
                    return left
                mid = (left + right) // 2
                low = np.zeros(len(lo), bool)
                low[open_] = v[mid[open_]] < want[open_]
                left = np.where(open_ & low, mid + 1, left)
                right = np.where(open_ & ~low, mid, right)

        ma, mb = split(a, pairs[:, 0], pairs[:, 1]), split(b, pairs[:, 2], pairs[:, 3])
        most = head_budget if depth + 1 <= head else budget
        kids = []
        for x, y in ((0, 0), (0, 1), (1, 0), (1, 1)):
            la, ha = (pairs[:, 0], ma) if x == 0 else (ma, pairs[:, 1])
            lb, hb = (pairs[:, 2], mb) if y == 0 else (mb, pairs[:, 3])
            kid = np.column_stack([la, ha, lb, hb, pairs[:, 4] + (x != y)])
            ok = (ha > la) & (hb > lb) & (kid[:, 4] <= most)
            if self_join and (x, y) == (1, 0):  # of a node with itself, (0, 1) has these pairs
                ok &= ~((pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] == pairs[:, 3]))
            kids.append(kid[ok])
        stack.append((depth + 1, np.concatenate(kids)))


class Sets:
    """Disjoint sets over 0..n-1, joined by arrays of links."""

    def __init__(self, n: int):
        self.low = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            p, q = self.low[i], self.low[j]
            apart = p != q
            if not apart.any():
                return
            i, j, p, q = i[apart], j[apart], p[apart], q[apart]
            np.minimum.at(self.low, np.maximum(p, q), np.minimum(p, q))
            while True:  # flatten
                up = self.low[self.low]
                if (up == self.low).all():
                    break
                self.low = up


def links(reps: DataFrame, distance: int = 4, block: int = 20_000) -> DataFrame:
    """Links ``(u, v)`` that join the distinct fingerprints ``fp`` of ``reps`` as all pairs would.

    For each rotation the upper levels of the trie are walked in the plan: a
    fingerprint goes to every pair of upper nodes, its own and one within the
    segment's budget, that holds fingerprints on both sides. A node with over
    ``block`` fingerprints is cut into blocks and the pairs of blocks are
    dealt to different tasks. A task walks its node pairs down to the leaves
    and returns the links of a spanning forest, not all pairs.
    """
    n = reps.count()
    m = segments_for(n, distance)
    width, near = BITS // m, distance // m
    top = min(width, 16, max(6, math.ceil(math.log2(max(n, block) / block))))
    masks = [x for x in range(1 << top) if x.bit_count() <= near]
    fp = F.col("fp")

    def turned(by: int):
        return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))

    rot = reps.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), turned(s * width).alias("r"))
                                                for s in range(m)])).alias("x")).select("fp", "x.*")
    rot = rot.withColumn("p", F.shiftrightunsigned("r", BITS - top))
    rot = rot.withColumn("at", F.pmod(F.xxhash64("fp"), F.lit(1 << 30)))
    nodes = staged(rot.groupBy("s", "p").agg(F.ceil(F.count("*") / block).cast("int").alias("k")), "trie-nodes")
    pairs = rot.withColumn("q", F.explode(F.array(*[F.col("p").bitwiseXOR(F.lit(x).cast("long")) for x in masks])))
    pairs = (pairs.join(nodes.withColumnRenamed("k", "kp"), ["s", "p"])
             .join(nodes.select("s", F.col("p").alias("q"), F.col("k").alias("kq")), ["s", "q"]))
    pairs = pairs.withColumn("x", F.pmod("at", "kp").cast("int"))
    pairs = pairs.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("kq") - 1)))
    right = F.when(F.col("p") == F.col("q"), F.col("x") > F.col("y")).otherwise(F.col("p") > F.col("q"))
    both = lambda a, b: (F.when(right, F.col(b)).otherwise(F.col(a)), F.when(right, F.col(a)).otherwise(F.col(b)))
    (na, nb), (ba, bb) = both("p", "q"), both("x", "y")
    pairs = pairs.select("s", na.alias("na"), nb.alias("nb"), ba.alias("ba"), bb.alias("bb"), right.alias("right"), "fp")

    def walk(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        s, na, nb, ba, bb = key
        fp = f["fp"].to_numpy().view(np.uint64)
        turn, side = rotated(fp, int(s) * width), f["right"].to_numpy()
        same = na == nb and ba == bb
        order = [np.flatnonzero(~side), np.flatnonzero(side)]
        order = [o[np.argsort(turn[o], kind="stable")] for o in (order[:1] if same else order)]
        a = turn[order[0]]
        b = a if same else turn[order[1]]
        sets = Sets(len(fp))
        for i, j in trie_links(a, b, width, near, distance):
            sets.join(order[0][i], order[0 if same else 1][j])
        out = np.flatnonzero(sets.low != np.arange(len(fp)))
        return pd.DataFrame({"u": fp[out].view(np.int64), "v": fp[sets.low[out]].view(np.int64)})

    return pairs.groupBy("s", "na", "nb", "ba", "bb").applyInPandas(walk, "u long, v long")


def smallest_ids(roots: DataFrame) -> DataFrame:
    """``fp, root, component_id`` of rows ``(fp, first_id, root)``: the smallest id of each root.

    The ids are written before the join, so that a root with most of the rows is split over tasks.
    """
    least = staged(roots.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-ids")
    return roots.join(least, "root").select("fp", "root", "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                distance: int = 4) -> DataFrame:
    """``doc_id, digest, fp, root, component_id``: one row per input row.

    Documents whose fingerprints are at most ``distance`` bits apart are
    linked; ``component_id`` is the smallest id reachable over links and
    ``root`` the component's own number. Equal
    fingerprints are joined as one, so copies make no pairs. Null and empty
    texts have fingerprint 0 and link like any other. Rows that repeat an id
    each get their row; null ids are never the smallest (a component of null
    ids only has a null id). An empty table gives an empty result; other
    columns are ignored.
    """
    marked = staged(fingerprints(docs, id_col, text_col, words), "fingerprints")
    reps = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    edges = staged(links(reps.select("fp"), distance).distinct(), "fingerprint-links")
    roots = staged(reps.join(components(edges), F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    labels = staged(smallest_ids(roots), "fingerprint-components")
    return marked.join(labels, "fp", "left").select("doc_id", "digest", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                distance: int = 4) -> DataFrame:
    """One row of each component of near copies, with all columns: the smallest id.

    Of rows that share that id the one whose text has the smallest digest
    stays, and one of rows that repeat both. The rows that stay are named by
    id and digest, not by their place, so a second read of ``docs`` may be
    split differently (executors come and go).
    """
    groups = near_groups(docs, id_col, text_col, words, distance)
    firsts = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", "digest").agg(
        F.count("*").alias("n"))
    stay = staged(firsts.groupBy("root").agg(F.min(F.struct("digest", "doc_id", "n")).alias("s")).select("s.*"), "near-kept")
    digest = unused(docs, "__digest")
    marked = docs.withColumn(digest, F.unhex(F.md5(F.coalesce(docs[text_col], F.lit("")))))
    kept = marked.join(stay, marked[id_col].eqNullSafe(stay["doc_id"]) & (marked[digest] == stay["digest"]), "left_semi")
    if not stay.where("n > 1").isEmpty():  # rows that repeat an id and its text
        kept = kept.dropDuplicates([id_col, digest])
    return kept.select(docs.columns)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract query: 4-word shingles, links at 4 or fewer differing bits."""
    found = near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
