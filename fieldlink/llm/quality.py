"""Quality classifier: a linear-chain conditional random field over a document's lines."""

from __future__ import annotations

import dataclasses
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlink.llm.common import documents, id_and_text, staged
from fieldlink.llm.cutting_stock import inverted, times

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = b"0123456789"
SYMBOLS = b"*$%&#@^~<>{}[]\\|=_/+;"
OWN = 11  # features of a line itself; those of the line before and after follow
WIDE = 3 * OWN


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each line that is not blank: OWN features, and its length in bytes.

    A text without such lines is one line of zero features and length 1.
    """
    rows, lengths, seen = [], [], set()
    for raw in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words = raw.split()
        if not words:
            continue
        n, size = len(words), len(raw)
        letters = size - len(raw.translate(None, LETTERS)) or 1
        rows.append((
            min(n, 400) / 100, (size - len(raw.translate(None, UPPER))) / letters,
            min(3.0, (size - len(raw.translate(None, SYMBOLS))) / n), min(2.0, raw.count(b"|") / n),
            min(2.0, raw.count(b"!") / n), len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / n,
            min(3.0, size / n / 10), (size - len(raw.translate(None, DIGITS))) / size,
            min(1.0, raw.count(b".") / n), float(raw in seen)))
        seen.add(raw)
        lengths.append(size)
    if not rows:
        return np.zeros((1, OWN)), np.ones(1)
    return np.array(rows), np.array(lengths, float)


def with_neighbours(own: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features beside those of the line before and the line after (zeros at a document's ends)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[starts] = 0
    after[starts + counts - 1] = 0
    return np.hstack([own, before, after])


def _two(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    return x[:, :1] * a[0] + x[:, 1:] * a[1]


def marginals(gain: np.ndarray, move: np.ndarray, starts: np.ndarray, counts: np.ndarray):
    """Forward-backward over all documents at once.

    ``gain``: each line's log-odds for good; ``move``: 2x2 transition weights
    (0 bad, 1 good). Returns P(good) per line, the expected transitions and
    the log of each document's partition sum.
    """
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    e = np.exp(np.clip(gain, -30, 30) / 2)
    node = np.column_stack([1 / e, e])
    a = np.exp(move)
    alpha, beta, scale = np.zeros((len(gain), 2)), np.ones((len(gain), 2)), np.ones(len(gain))
    active = [np.searchsorted(-counts, -t, side="left") for t in range(int(counts[0]) if len(counts) else 0)]
    for t, k in enumerate(active):
        at = starts[:k] + t
        f = node[at] if t == 0 else _two(alpha[at - 1], a) * node[at]
        scale[at] = f.sum(1)
        alpha[at] = f / scale[at][:, None]
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        right = beta[at] * node[at] / scale[at][:, None]
        pairs += a * np.einsum("ni,nj->ij", alpha[at - 1], right)
        beta[at - 1] = _two(right, a.T)
    p = alpha * beta
    log_z = np.zeros(len(order))
    log_z[order] = np.add.reduceat(np.log(scale), starts) if len(gain) and (np.diff(starts) > 0).all() else [
        np.log(scale[s : s + c]).sum() for s, c in zip(starts, counts)]
    return p[:, 1] / p.sum(1), pairs, log_z


@dataclasses.dataclass(frozen=True)
class Model:
    weights: np.ndarray  # WIDE + 1, the last is the bias
    move: np.ndarray  # 2x2
    mean: np.ndarray
    spread: np.ndarray
    slope: float  # of the document's score on the logit of its good share
    bias: float

    def lines(self, own: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (with_neighbours(own, starts, counts) - self.mean) / self.spread
        return times(x, self.weights[:-1]) + self.weights[-1]

    def good_share(self, own, lengths, starts, counts) -> np.ndarray:
        """Length-weighted mean of the lines' P(good), by document."""
        p, _, _ = marginals(self.lines(own, starts, counts), self.move, starts, counts)
        doc = np.repeat(np.arange(len(counts)), counts)
        return np.bincount(doc, p * lengths, len(counts)) / np.bincount(doc, lengths, len(counts))

    def score(self, own, lengths, starts, counts) -> np.ndarray:
        s = np.clip(self.good_share(own, lengths, starts, counts), 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(s / (1 - s)) + self.bias, -30, 30)))


def _flat(parts: list[tuple[np.ndarray, np.ndarray]]):
    counts = np.array([len(x) for x, _ in parts], int)
    return (np.vstack([x for x, _ in parts]), np.concatenate([n for _, n in parts]), np.cumsum(counts) - counts, counts)


def fit_model(parts: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, share_good: float = 0.5,
              rounds: int = 3, steps: int = 120) -> Model:
    """Fit on labelled documents (their line features) whose lines have no labels.

    All lines of a good document are good. A bad document's lines start as bad; after
    each round those that the model finds good with its neighbours, all but the
    worst one, change over. Gradient steps (Adam) on the log-likelihood of
    the chain; then a logistic fit of document labels on the good share, with
    classes weighted to ``share_good``.
    """
    own, lengths, starts, counts = _flat(parts)
    doc = np.repeat(np.arange(len(counts)), counts)
    x = with_neighbours(own, starts, counts)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    x = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    y = good[doc].astype(float)
    weigh = np.where(good[doc], 0.5 / max(good.mean(), 1e-9), 0.5 / max(1 - good.mean(), 1e-9))
    w, move = np.zeros(WIDE + 1), np.zeros((2, 2))
    inner = np.ones(len(x), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    for _ in range(rounds):
        m = [np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
        for t in range(1, steps + 1):
            p, pairs, _ = marginals(times(x, w), move, starts, counts)
            gw = times((y - p) * weigh, x) / len(x) - 1e-3 * w
            gm = (seen - pairs) / len(x) - 1e-3 * move
            for g, v, k in ((gw, w, 0), (gm, move, 2)):
                m[k] = 0.9 * m[k] + 0.1 * g
                m[k + 1] = 0.99 * m[k + 1] + 0.01 * g * g
                v += 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(m[k + 1] / (1 - 0.99**t)) + 1e-8)
        p, _, _ = marginals(times(x, w), move, starts, counts)
        worst = np.full(len(counts), np.inf)
        np.minimum.at(worst, doc, p)
        y = np.where(good[doc], 1.0, ((p > 0.5) & (p > worst[doc])).astype(float))
    model = Model(w, move, mean, spread, 1.0, 0.0)
    s = np.clip(model.good_share(own, lengths, starts, counts), 1e-4, 1 - 1e-4)
    z, b = np.log(s / (1 - s)), np.zeros(2)
    zz = np.column_stack([z, np.ones(len(z))])
    rows = np.where(good, share_good / max(good.mean(), 1e-9), (1 - share_good) / max(1 - good.mean(), 1e-9))
    for _ in range(50):  # Newton
        q = 1 / (1 + np.exp(-np.clip(times(zz, b), -30, 30)))
        g = times(rows * (good - q), zz) - 1e-2 * b
        h = np.einsum("ni,n,nj->ij", zz, rows * q * (1 - q), zz) + 1e-2 * np.eye(2)
        b = b + np.clip(times(inverted(h), g), -2, 2)
    return dataclasses.replace(model, slope=float(max(b[0], 1e-3)), bias=float(b[1]))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, most_lines: int = 200) -> Model | None:
    """Fit on a bounded sample: at most ``per_class`` documents of each label with at most ``most_lines`` lines.

    The sample takes labelled documents outside the held-out fold by the
    smallest hash of their id. Only their line features, never ids or other
    columns, come to the driver. An id that is labelled both ways counts as
    label 0; of rows that repeat an id the smallest text is taken. Without
    documents of both labels there is nothing to learn and the result is None.
    """
    rows = id_and_text(docs, "doc_id", "text")
    known = labels.select(labels["doc_id"].alias("__id"), labels["quality"].alias("__good")).where(
        "__good IS NOT NULL AND __id IS NOT NULL").groupBy("__id").agg(F.min("__good").alias("__good"))
    known = known.where(~held_out(F.col("__id")))
    tally = {r["__good"]: r["count"] for r in known.groupBy("__good").count().collect()}
    picked = None
    for label in (0, 1):
        some = known.where(F.col("__good") == label).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    picked = staged(picked, "labelled")  # at most 2 * per_class rows
    sample = rows.join(F.broadcast(picked), rows["doc_id"] == picked["__id"]).groupBy("__id").agg(
        F.min("text").alias("text"), F.min("__good").alias("__good")).select("text", "__good")  # one row an id

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text, good in zip(f["text"], f["__good"]):
                x, n = line_features(text)
                if len(x) <= most_lines:
                    out.append((int(good), x.ravel().tolist(), n.tolist()))
            yield pd.DataFrame(out, columns=["good", "x", "n"])

    got = sample.mapInPandas(measure, "good int, x array<double>, n array<double>").collect()
    got = sorted(got, key=lambda r: (r["good"], r["n"], r["x"]))
    good = np.array([r["good"] == 1 for r in got], bool)
    if not len(good) or good.all() or not good.any():
        return None
    parts = [(np.array(r["x"]).reshape(-1, OWN), np.array(r["n"])) for r in got]
    return fit_model(parts, good, tally[1] / (tally[0] + tally[1]))


def scorer(model: Model | None):
    """Column function: the score of a text; 0.5 without a model (nothing to learn from)."""
    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        out = []
        for k in range(0, len(texts), 1000):
            parts = [line_features(t) for t in texts.iloc[k : k + 1000]]
            out.append(model.score(*_flat(parts)) if model else np.full(len(parts), 0.5))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return judge


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` of every row.

    Texts are read whole, all lines of a batch's documents in one
    forward-backward pass. A null or empty text counts as one line without
    words. Repeated rows score alike; null ids are kept; an empty table gives
    an empty result; other columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("score", scorer(model)("text"))
    return rows.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
