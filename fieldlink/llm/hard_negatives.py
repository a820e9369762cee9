"""Hard-negative mining over an inverted multi-index.

Vectors are cut in halves, and a codebook for each half gives every row a cell
(i, j). For an anchor, no row of a cell can score more than the sum of two
half bounds: the half anchor's product with the centroid plus its norm times
the centroid's radius. A heap visits the cells by falling sums; a search ends
when the next bound shows that no row which was not seen can change it. All
results are therefore exact; the codebooks only decide how much is read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlink.llm.common import staged

#: Rows that the codebooks are fitted on; centroids a half; rows of a cell aimed at.
SAMPLE, MOST_CENTROIDS, CELL_ROWS = 20_000, 256, 64
#: Rows an anchor looks at in the first round, and how much more in each later one.
FIRST, GROWTH = 4096, 16
#: Rows and anchors that meet in one group, and scores computed at a time.
PAGE, ANCHORS, SLICE = 32_768, 4096, 4_000_000
#: Products of whole numbers are exact in doubles as long as sums stay below this.
EXACT = 2.0**53
ROWS = "row long, vec_id long, label long, vec binary"


def prepared(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             relabel: int = 7, labels: int = 10, scale: int = 256) -> DataFrame:
    """``vec_id, label, vector``: rows that take part, relabelled, with components floor(scale * x).

    Rows with a null label, a null vector, or a null or non-finite component
    are left out; an empty vector is one of zeros. Where the id is divisible by
    ``relabel`` the label becomes the next of ``labels``.
    """
    v = embeddings.select(embeddings[id_col].cast("long").alias("vec_id"), embeddings[label_col].cast("long").alias("label"),
                          embeddings[vector_col].cast("array<double>").alias("vector"))
    v = v.where("label IS NOT NULL AND vector IS NOT NULL "
                "AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))")
    moved = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    # The floor stays a double, as a component may be larger than a long; doubles that large are whole.
    grid = F.transform("vector", lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return v.select("vec_id", moved.alias("label"), grid.alias("vector"))


class Codebooks:
    """Centroids of both halves, fitted by Lloyd's steps on a sample of rows."""

    def __init__(self, sample: np.ndarray, centroids: int, steps: int = 8, seed: int = 42):
        self.half = sample.shape[1] // 2
        rng = np.random.default_rng(seed)
        self.books = []
        for part in (sample[:, : self.half], sample[:, self.half :]):
            distinct = np.unique(part, axis=0)
            book = distinct[rng.permutation(len(distinct))[:centroids]]
            for _ in range(steps):
                near, _ = nearest(part, book)
                sums = np.zeros_like(book)
                np.add.at(sums, near, part)
                n = np.bincount(near, minlength=len(book))
                book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
            self.books.append(book)

def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest centroid and the distance to it."""
    near = np.empty(len(x), np.int64)
    for a in range(0, len(x), 4096):
        b = x[a : a + 4096]
        near[a : a + 4096] = np.argmin((book**2).sum(1)[None, :] - 2 * (b @ book.T), axis=1)
    return near, np.sqrt(((x - book[near]) ** 2).sum(1))


def vectors(raw, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(-1, width)


def falling_cells(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """All pairs (i, j) by falling ``first[i] + second[j]``: the multi-sequence heap."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    u, v = first[a].tolist(), second[b].tolist()
    a, b = a.tolist(), b.tolist()
    heap = [(-(u[0] + v[0]), 0, 0)]
    while heap:
        bound, x, y = heapq.heappop(heap)
        yield -bound, a[x], b[y]
        # Every pair is pushed once: by the pair before it in its row, the first of a row by the first of the row before.
        if x + 1 < len(u):
            heapq.heappush(heap, (-(u[x + 1] + v[y]), x + 1, y))
        if x == 0 and y + 1 < len(v):
            heapq.heappush(heap, (-(u[0] + v[y + 1]), 0, y + 1))


class Cells:
    """What a search knows of the cells: codebooks, radii, rows a cell, and the pages that hold them."""

    def __init__(self, codebooks: Codebooks, width: int):
        self.books, self.half, self.width = codebooks.books, codebooks.half, width
        self.counts = np.zeros([len(b) for b in self.books], np.int64)
        self.radii = [np.zeros(len(b)) for b in self.books]

    def assign(self, x: np.ndarray) -> list[np.ndarray]:
        """``i, j`` and the distances to both centroids."""
        (i, di), (j, dj) = nearest(x[:, : self.half], self.books[0]), nearest(x[:, self.half :], self.books[1])
        return [i.astype(np.int32), j.astype(np.int32), di, dj]

    def lay_out(self, page_rows: int) -> None:
        """First page and number of pages of each cell that has rows."""
        self.first, self.parts, page, room = {}, {}, 0, page_rows
        for c in np.flatnonzero(self.counts).tolist():
            n = int(self.counts.flat[c])
            if n > room:
                page, room = page + (room < page_rows), page_rows
            self.first[c], self.parts[c] = page, -(-n // page_rows)
            if n > page_rows:
                page += self.parts[c]
            else:
                room -= n

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """Half bounds of the products with a row, rounded up a little."""
        out = []
        for part, book, radius in zip((x[: self.half], x[self.half :]), self.books, self.radii):
            norm = np.sqrt((part**2).sum())
            out.append(part @ book.T + norm * radius + 1e-9 * (norm * (radius + np.sqrt((book**2).sum(1))) + 1))
        return out

    def visit(self, x: np.ndarray, seen: int, budget: int) -> tuple[int, float, dict[int, list[int]]]:
        """The cells after the first ``seen`` until ``budget`` rows are reached, by page, and the bound of the next one."""
        left, pages, at = budget, {}, 0
        for bound, i, j in falling_cells(*self.bounds(x)):
            n = int(self.counts[i, j])
            if not n:
                continue
            if at < seen:
                at += 1
                continue
            if left <= 0:
                return at, bound, pages
            at, left, cell = at + 1, left - n, i * self.counts.shape[1] + j
            for page in range(self.first[cell], self.first[cell] + self.parts[cell]):
                pages.setdefault(page, []).append(cell)
        return at, -np.inf, pages


class Index:
    """The rows by cell, written as a table, and the cells.

    Cells are dealt to pages of at most ``page_rows`` rows: small cells share
    a page, a large one is dealt to several by a hash, so no group grows with
    a cell.
    """

    def __init__(self, rows: DataFrame, width: int, codebooks: Codebooks, page_rows: int = PAGE):
        self.cells = cells = Cells(codebooks, width)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = cells.assign(vectors(b.column("vec").to_pylist(), width))
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, found)], [*b.schema.names, "i", "j", "di", "dj"])

        assigned = staged(rows.mapInArrow(assign, f"{ROWS}, i int, j int, di double, dj double"), "index-rows")
        # One row a cell, MOST_CENTROIDS squared at most.
        for r in assigned.groupBy("i", "j").agg(F.count("*").alias("n"), F.max("di").alias("a"), F.max("dj").alias("b")).collect():
            cells.counts[r["i"], r["j"]] = r["n"]
            cells.radii[0][r["i"]] = max(cells.radii[0][r["i"]], r["a"])
            cells.radii[1][r["j"]] = max(cells.radii[1][r["j"]], r["b"])
        cells.lay_out(page_rows)
        pages = rows.sparkSession.createDataFrame([(c, cells.first[c], cells.parts[c]) for c in cells.first],
                                                  "cell int, first long, parts long")
        cell = (F.col("i") * cells.counts.shape[1] + F.col("j")).cast("int").alias("cell")
        self.rows = staged(assigned.select("row", "vec_id", "label", "vec", cell).join(F.broadcast(pages), "cell").select(
            "row", "vec_id", "label", "vec", "cell",
            (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).alias("page")), "index-pages")


def _visits(index: Index, state: DataFrame, budget: int) -> DataFrame:
    """``row, seen, rest, visits``: the cells that each anchor looks at next, by page, and the bound of what follows."""
    cells = index.cells

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row, raw, seen in zip(f["row"], f["vec"], f["seen"]):
                at, rest, pages = cells.visit(vectors([raw], cells.width)[0], seen, budget)
                out.append((row, at, rest, [{"page": p, "cells": c} for p, c in pages.items()]))
            yield pd.DataFrame(out, columns=["row", "seen", "rest", "visits"])

    schema = "row long, seen int, rest double, visits array<struct<page: long, cells: array<int>>>"
    return state.select("row", "vec", "seen").mapInPandas(run, schema)


FOUND = "anchor long, win int, score long, vec_id long, row long"
FOUND_ARROW = pa.schema([("anchor", pa.int64()), ("win", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()),
                         ("row", pa.int64())])


def _scored(index: Index, visits: DataFrame, anchors: DataFrame, most: int) -> DataFrame:
    """The ``most`` best rows of each anchor and window in the cells that it visits, by page.

    Pages meet anchors in groups of at most ``PAGE`` rows and ``ANCHORS``
    anchors. Window -1 asks for rows of the anchor's label but for itself;
    windows 0, 1, ... for others whose score lies between ``lo`` and ``hi``.
    """
    parts = max(1, -(-anchors.count() // ANCHORS))
    part = F.pmod(F.xxhash64("row"), F.lit(parts))
    asked = visits.join(anchors, "row").select("row", "label", "vec", "lo", "hi", F.explode("visits").alias("v")).select(
        F.col("v.page").alias("page"), part.alias("part"), "row", "label", "vec", "lo", "hi", F.col("v.cells").alias("cells"))
    pairs = asked.select("page", F.col("part").alias("with")).distinct()
    rows = index.rows.join(pairs, "page")
    width = index.cells.width

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            x, q = (vectors(t.column("vec").to_pylist(), width) for t in (left, right))
            label, row = left.column("label").to_numpy(), left.column("row").to_numpy()
            names = left.column("vec_id").to_pylist()
            ids = left.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()  # only to sort: null ids last
            cell, cells = np.unique(left.column("cell").to_numpy(), return_inverse=True)
            exact = width * (np.abs(x).max() + 1) * (np.abs(q).max() + 1) < EXACT
            step = max(1, SLICE // len(x))
            for a in range(0, len(q), step):
                scores = q[a : a + step] @ x.T if exact else _wide_products(q[a : a + step], x)
                for score, ask in zip(scores, right.slice(a, step).select(["row", "label", "lo", "hi", "cells"]).to_pylist()):
                    seen = np.isin(cell, ask["cells"])[cells]
                    if ask["lo"]:
                        other = seen & (label != ask["label"])
                        windows = [(w, other & (score >= b) & (score <= t)) for w, (b, t) in enumerate(zip(ask["lo"], ask["hi"]))]
                    else:
                        windows = [(-1, seen & (label == ask["label"]) & (row != ask["row"]))]
                    for w, fits in windows:
                        at = np.flatnonzero(fits)
                        if exact and len(at) > most:  # what can't be among the best needs no sorting
                            at = at[score[at] >= np.partition(score[at], len(at) - most)[len(at) - most]]
                        at = sorted(at.tolist(), key=lambda k: (-score[k], ids[k], row[k]))[:most]
                        out += [(ask["row"], w, int(score[k]), names[k], int(row[k])) for k in at]
        columns = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, FOUND_ARROW)], schema=FOUND_ARROW)

    return rows.groupBy("page", "with").cogroup(asked.groupBy("page", "part")).applyInArrow(run, FOUND)


def _wide_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products of components that doubles can't add exactly."""
    whole = lambda m: np.array([[int(c) for c in r] for r in m.tolist()], object).reshape(m.shape)
    return whole(q) @ whole(x).T


def _best(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("anchor", "win").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)


def search(index: Index, anchors: DataFrame, most: int, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """``anchor, win, score, vec_id, row, nth``: the ``most`` best rows for every window of every anchor.

    ``anchors``: ``row, label, vec, lo, hi``; empty ``lo`` and ``hi`` ask for
    the best rows of the same label. Rounds go on for the anchors whose
    windows are not certain yet: a window is, when it has ``most`` rows that
    score more than any row outside the cells seen, or when no such row can
    reach its lower end. Each round looks at ``growth`` times as many rows.
    """
    spark = anchors.sparkSession
    state = anchors.withColumn("seen", F.lit(0))
    found, budget = spark.createDataFrame([], FOUND), first
    done = []
    while True:
        state = staged(state, "search-open")
        if state.isEmpty():
            break
        visits = staged(_visits(index, state, budget), "search-visits")
        here = _scored(index, visits, state, most)
        found = staged(_best(here.unionByName(found), most), "search-found")
        full = found.where(F.col("nth") == most).select(F.col("anchor").alias("row"), "win", F.col("score").alias("last"))
        wins = state.select("row", F.when(F.size("lo") == 0, F.array(F.struct(F.lit(-1).alias("win"), F.lit(None).cast("long").alias("lo"),
                                                                             F.lit(None).cast("long").alias("hi"))))
                            .otherwise(F.expr("transform(lo, (b, n) -> struct(n AS win, b AS lo, hi[n] AS hi))")).alias("w"))
        sure = (wins.select("row", F.explode("w").alias("w")).select("row", "w.*").join(full, ["row", "win"], "left")
                .join(visits.select("row", "seen", "rest"), "row")
                .groupBy("row", "seen").agg(F.min(F.coalesce(
                    (F.col("rest") == float("-inf")) | (F.col("last") > F.col("rest")) | (F.col("lo") > F.col("rest"))
                    | (F.col("lo") > F.col("hi")), F.lit(False))).alias("sure")))
        sure = staged(sure, "search-sure")
        done.append(found.join(sure.where("sure").withColumnRenamed("row", "anchor"), "anchor", "left_semi"))
        unsure = sure.where("NOT sure").select("row", "seen")
        state = state.drop("seen").join(unsure, "row")
        found = found.join(unsure.select(F.col("row").alias("anchor")), "anchor", "left_semi").drop("nth")
        budget *= growth
    out = done[0] if done else found.withColumn("nth", F.lit(0))
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def build(rows: DataFrame, centroids: int | None = None, page_rows: int | None = None) -> tuple[DataFrame, Index | None]:
    """The written rows (``row, vec_id, label, vec``) of :func:`prepared` ones, and their index (None without rows).

    The codebooks are fitted on ``SAMPLE`` rows at most, in the order of a
    hash of their ids; every row is indexed. Shorter vectors are filled up with
    zeros to the longest one's length.
    """
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "index-input")
    about = rows.agg(F.max(F.size("vector")).alias("width"), F.count("*").alias("n")).first()
    if not about["n"]:
        return rows.select("row", "vec_id", "label", F.lit(b"").alias("vec")), None
    width, n = max(2, about["width"]), about["n"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            filled = [np.array(v + [0.0] * (width - len(v)), "<f8").tobytes() for v in b.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "vec_id", "label")), pa.array(filled, pa.binary())],
                                             ["row", "vec_id", "label", "vec"])

    table = staged(rows.select("row", "vec_id", "label", "vector").mapInArrow(packed, ROWS), "index-vectors")
    if centroids is None:
        centroids = min(MOST_CENTROIDS, max(2, round((n / CELL_ROWS) ** 0.5)))
    # A hash of the row picks twice the sample in expectation, so that the exact limit has few rows to sort.
    picked = table.where(F.pmod(F.xxhash64("vec_id", "row"), F.lit(max(1, n // (2 * SAMPLE)))) == 0)
    picked = picked.orderBy(F.xxhash64("vec_id", "row")).limit(SAMPLE).select("vec").collect()
    books = Codebooks(vectors([r["vec"] for r in picked], width), centroids)
    if page_rows is None:  # enough pages for all cores, none larger than PAGE
        page_rows = min(PAGE, max(1024, n // (4 * rows.sparkSession.sparkContext.defaultParallelism)))
    return table, Index(table, width, books, page_rows)


def mine(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80,
         centroids: int | None = None, page_rows: int | None = None, first: int = FIRST, **how) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, all but rank long.

    Anchors are rows whose id is divisible by ``every``; their positives are
    the best ``positives`` other rows of their label. For each of them come
    the best ``negatives`` rows of other labels that score at least ``low``
    and at most 100 per cent of it, by falling score, ties by smaller id (null
    ids last). Scores are whole-number products; one above 2^63 is an error.
    Repeated rows are rows of their own: each may be an anchor, and a copy of
    an anchor may be its positive. An empty table gives an empty result; other
    columns are ignored.
    """
    table, index = build(prepared(embeddings, **how), centroids, page_rows)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if index is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    none = F.array().cast("array<long>")
    chosen = table.where(F.col("vec_id") % every == 0)
    best = search(index, chosen.select("row", "label", "vec", none.alias("lo"), none.alias("hi")), positives, first)
    best = staged(best.select(F.col("anchor").alias("row"), "nth", "score", "vec_id"), "positives")
    # 100 * negative >= low * positive, in whole numbers; a window is empty where the positive's score is negative.
    windows = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("nth", "score"))).alias("p")).select(
        "row", F.expr(f"transform(p, x -> CAST(ceil(CAST(x.score AS decimal(20)) * {low} / 100) AS long))").alias("lo"),
        F.expr("transform(p, x -> x.score)").alias("hi"))
    asked = chosen.select("row", "label", "vec").join(windows, "row")
    found = search(index, asked, negatives, first)
    anchor = table.select("row", F.col("vec_id").alias("anchor_id"))
    return (found.select(F.col("anchor").alias("row"), (F.col("win") + 1).alias("at"), F.col("nth").alias("rank"),
                         F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(best.select("row", F.col("nth").alias("at"), F.col("vec_id").alias("positive_id"),
                              F.col("score").alias("positive_score")), ["row", "at"])
            .join(anchor, "row")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
                    "negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: hard negatives of all anchors of ``embeddings``."""
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
WHERE rank <= 5
"""
