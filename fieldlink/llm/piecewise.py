"""Document fingerprints by context-triggered piecewise hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlink.llm.common import documents, id_and_text

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, SMALLEST, MOST = 7, 3, 64
#: A run of this many equal signature characters, or of all of a shorter one, is no chance.
RUN = 4
#: Bytes hashed at a time, which bounds a very long text's memory.
BLOCK = 1 << 20


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW bytes at every byte (fewer at the start), as uint32."""
    x = data.astype(np.uint32) + np.uint32(1)
    h, power = x.copy(), 1
    for j in range(1, WINDOW):
        power = power * 0x01000193 & 0xFFFFFFFF
        h[j:] += x[:-j] * np.uint32(power)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def _trigger(hashes: list[tuple[int, np.ndarray]], size: int) -> np.ndarray:
    return np.concatenate([at + np.flatnonzero(h % np.uint32(size) == size - 1) for at, h in hashes])


def _blocks(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(data), BLOCK):
        lead = min(at, WINDOW - 1)
        yield at, rolling(data[at - lead : at + BLOCK])[lead:]


def _signature(raw: bytes, cuts: np.ndarray) -> str:
    """One character per chunk; the last chunk takes all that follows the MOST-1st boundary."""
    ends = [int(c) + 1 for c in cuts[: MOST - 1]]
    if not ends or ends[-1] != len(raw):
        ends.append(len(raw))
    start, out = 0, []
    for end in ends:
        out.append(ALPHABET[xxhash.xxh32_intdigest(raw[start:end]) & 63])
        start = end
    return "".join(out)


def fingerprint(text: str | None) -> str:
    """``size:signature:signature at twice the size`` of the whole text.

    The block size is the smallest 3 * 2^i for which 64 blocks cover the
    text, halved while the signature has under 32 characters. A null or empty
    text gives ``3::``.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return f"{SMALLEST}::"
    data = np.frombuffer(raw, np.uint8)
    size = SMALLEST
    while size * MOST < len(raw):
        size *= 2
    hashes = list(_blocks(data)) if len(raw) <= BLOCK else None
    scan = lambda s: _trigger(hashes, s) if hashes else np.concatenate([_trigger([x], s) for x in _blocks(data)])
    cuts = scan(size)
    while len(cuts) < MOST // 2 - 1 and size > SMALLEST:
        size //= 2
        cuts = scan(size)
    return f"{size}:{_signature(raw, cuts)}:{_signature(raw, scan(2 * size))}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, all columns of a row in one integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    """1 - edit distance (insertions and deletions) / both lengths; 0 where that may be chance.

    Without a common run it must reach 1/4 + 1/sqrt(mean length), which
    signatures of unrelated texts do not: they share a fifth or less on average.
    """
    if a == b or not a or not b:
        return 1.0 if a == b != "" else 0.0
    share = 2 * _common(a, b) / (len(a) + len(b))
    if share >= 0.25 + ((len(a) + len(b)) / 2) ** -0.5:
        return share
    run = min(RUN, len(a), len(b))
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    return share if any(b[i : i + run] in runs for i in range(len(b) - run + 1)) else 0.0


def likeness(x: str, y: str) -> float:
    """0 to 1, over signatures of a block size that both fingerprints have."""
    if x == y:
        return 1.0
    (p, a1, a2), (q, b1, b2) = x.split(":"), y.split(":")
    p, q = int(p), int(q)
    if p == q:
        return max(_alike(a1, b1), _alike(a2, b2))
    if p == 2 * q:
        return _alike(a1, b2)
    return _alike(a2, b1) if q == 2 * p else 0.0


OUT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def _row(doc_id, text: str, fp: str, after: str, after_fp: str) -> tuple:
    n = len(text)
    edited = text[: n - n // 2] + after[: n // 2]
    own = fingerprint(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, n, digest, fp, own, likeness(fp, own), likeness(fp, after_fp)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edit with the next document, and their likeness.

    Columns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. The next document follows in descending id order
    (null ids last; rows that repeat an id in the order of a hash of the text;
    after the last row the first). A null text counts as empty. A single row is
    its own next. An empty table gives an empty result; other columns are
    ignored.

    Ids alone are range-partitioned first; each range's largest id opens a
    bucket. Texts are then shuffled once, to their bucket, sorted there and
    read in order, holding one row back; the row that opens a bucket goes to
    the bucket before as well. Memory is bounded by a batch however many rows
    a bucket has.
    """
    spark, rows = docs.sparkSession, id_and_text(docs, id_col, text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.select("doc_id").where("doc_id IS NOT NULL").repartitionByRange(4 * parts, F.desc("doc_id"))
    heads = ranges.groupBy(F.spark_partition_id()).agg(F.max("doc_id").alias("head")).orderBy(F.desc("head"))
    heads = [r["head"] for r in heads.collect()]  # as many as there are ranges
    ascending = np.array(heads[::-1])

    @F.pandas_udf("array<int>")
    def buckets(ids: pd.Series) -> pd.Series:
        """The row's bucket, then, for a row that opens one, the bucket before."""
        last = max(len(ascending) - 1, 0)
        null = ids.isna().to_numpy()
        v = np.full(len(ids), last)
        opens = np.zeros(len(ids), bool)
        if len(ascending) and not null.all():
            known = ids[~pd.Series(null, index=ids.index)].to_numpy().astype(ascending.dtype)
            at = np.searchsorted(ascending, known, side="left")
            v[~null] = last - at
            opens[~null] = ascending[np.minimum(at, last)] == known
        return pd.Series([[b, (b or last + 1) - 1] if o else [b] for b, o in zip(v.tolist(), opens)])

    dealt = rows.select("doc_id", "text", F.posexplode(buckets("doc_id")).alias("closes", "bucket"))
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions(
        "bucket", "closes", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = first = None  # (doc_id, text, fingerprint)
        bucket, closed = None, False
        for f in frames:
            out = []
            for doc_id, text, closes, b in zip(f["doc_id"], f["text"], f["closes"], f["bucket"]):
                if b != bucket:
                    if held is not None:  # a bucket of null ids only
                        out.append(_row(*held, *first[1:]))
                    held, first, bucket, closed = None, None, b, False
                if closed:
                    continue
                row = (doc_id, text, fingerprint(text))
                if held is not None:
                    out.append(_row(*held, *row[1:]))
                closed = bool(closes)
                held = None if closed else row
                first = first or row
            yield _frame(out, f["doc_id"].dtype)
        if held is not None:
            yield _frame([_row(*held, *first[1:])], f["doc_id"].dtype)

    kind = dict(rows.dtypes)["doc_id"]
    return dealt.mapInPandas(read, f"doc_id {kind}, {OUT}")


def _frame(rows: list[tuple], kind) -> pd.DataFrame:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pd.DataFrame(rows, columns=names)


def op6_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents."""
    return with_next(documents(spark, sf_dir))
