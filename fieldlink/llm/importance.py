"""Target-distribution importance resampling: hashed n-gram gains and a Gumbel top-k draw.

A 256-byte table lower-cases A-Z and blanks separators right in the UTF-8
bytes, ``bytes.split`` yields the words, and ``zlib.crc32`` seeded with the
hash of a run gives the hash of the run that is one word longer.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlink.llm.common import documents, staged
from fieldlink.plans.ordering import with_position

#: A-Z to a-z; other ASCII than letters and digits to a space; all else (every byte of a wider character) stays.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are split at a time; a longer text goes through in pieces that end between words.
BLOCK = 1 << 20


def run_hashes(raw: bytes, most: int, block: int = BLOCK) -> Iterator[list[list[int]]]:
    """CRC-32 of all runs of 1 to ``most`` consecutive words, joined by one space.

    For each piece of the text: a list for each run length, in which every run
    stands in the piece where its last word is.
    """
    clean, at, tail = raw.translate(TABLE), 0, []
    while at < len(clean):
        end = clean.find(b" ", at + block) if at + block < len(clean) else -1
        end = len(clean) if end < 0 else end
        words = tail + clean[at:end].split()
        at, old = end, len(tail)
        seeds = list(map(crc32, words))
        out = [seeds[old:]]
        if most > 1:
            spaced = list(map(b" ".__add__, words))
            for k in range(1, most):
                seeds = list(map(crc32, spaced[k:], seeds))
                out.append(seeds[max(old - k, 0):])
        yield out
        tail = words[-(most - 1):] if most > 1 else []


def _buckets(runs: list[list[int]], buckets: int) -> np.ndarray:
    return np.concatenate([np.array(r, np.int64) for r in runs]) % buckets


def _texts(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("text")


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = 10_000, most: int = 3) -> np.ndarray:
    """How many features of all texts fall into each bucket.

    Every task counts its texts in a Counter of at most ``buckets`` entries;
    the sums by bucket are all that is shuffled, and ``buckets`` numbers reach
    the driver whatever the size of the table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            for raw in batch.column("text"):
                for runs in run_hashes(raw.as_py(), most):
                    total.update(_buckets(runs, buckets).tolist())
        yield pa.RecordBatch.from_pydict({"bucket": list(total), "n": list(total.values())},
                                         pa.schema([("bucket", pa.int64()), ("n", pa.int64())]))

    counted = docs.select(_texts(docs, text_col)).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 * ln of the smoothed ratio of the target's share to the corpus's)."""
    size, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + size) / ((s + 1) * (all_t + size))))
                     for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def scores(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most: int = 3,
           seed: int = 42) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score``, one row per input row.

    ``weight`` is the sum of the gains of a text's features and ``score`` adds
    Gumbel noise that follows from the seed and the id alone, so the rows with
    the highest scores are a draw without replacement by exp(weight / 1000).
    A null or empty text has no features and weight 0; a null id has the noise
    of the empty string, and rows that repeat an id have the same noise.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))), 256)
    rows = docs.select(docs[id_col].alias("doc_id"), _texts(docs, text_col),
                       F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("draw"))
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for raw in batch.column("text"):
                words = features = total = 0
                for runs in run_hashes(raw.as_py(), most):
                    found = _buckets(runs, buckets)
                    words += len(runs[0])
                    features += len(found)
                    total += int(gain[found].sum())
                n_words.append(words)
                n_features.append(features)
                weight.append(total)
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in batch.column("draw").to_pylist()]
            longs = [n_words, n_features, weight, [w + e for w, e in zip(weight, noise)]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in longs]],
                                             ["doc_id", "n_words", "n_features", "weight", "score"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def highest(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows with the highest scores, with ``rank`` 1, 2, 3...; ties go to smaller ids, null ids last.

    An approximate quantile cuts off most rows that can't be drawn; if fewer
    than ``k`` rows reach it (which its error bound excludes), all are ranked.
    What is left is sorted by ranges of (score, id), so no task ranks it alone.
    Rows that repeat a score and id stand in the order of ``__row``.
    """
    n = scored.count()
    if n and k:
        share = max(0.0, 1 - k / n - 0.001)
        cut = scored.agg(F.percentile_approx("score", share, 10_000)).first()[0]
        likely = scored.where(F.col("score") >= cut)
        scored = likely if likely.count() >= k else scored
    ranked = with_position(scored, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("__row")], "rank")
    return ranked.where(F.col("rank") <= k)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000,
             most: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text") -> DataFrame:
    """Draw ``percent`` of the documents so that they resemble ``target``.

    Every row of ``docs`` comes back as ``doc_id, n_words, n_features, weight,
    score, rank``; ``rank`` is null where a row was not drawn. Of the N rows
    with at least ``least_words`` words, floor(percent * N / 100) are drawn by
    score. All texts are counted and scored whole. An empty table gives an
    empty result, an empty target gains that favour rare features; repeated
    rows are rows of their own; other columns are ignored.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, most), bucket_counts(target, target_text, buckets, most))
    scored = scores(docs, gain, id_col, text_col, most, seed)
    scored = staged(scored.withColumn("__row", F.monotonically_increasing_id()), "resampling-scores")
    fit = F.col("n_words") >= least_words
    k = percent * scored.where(fit).count() // 100
    drawn = staged(highest(scored.where(fit), k).select("__row", "rank"), "resampling-drawn")
    return scored.join(drawn, "__row", "left").select(
        "doc_id", "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Contract query: 5 % of all documents towards the benchmark's texts."""
    drawn = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
