"""Packing documents into token sequences by cutting stock."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlink.llm import cutting_stock
from fieldlink.llm.common import documents, id_and_text, staged

#: Tokens of one unit of length in the histogram, at most; a room of under 256 units has smaller ones.
UNIT = 16
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, __split int, __at long"


def pieces(docs: DataFrame, tokenizer: str, room: int = 4096, end_id: int = 2, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per piece of each document's ids (the text's, then ``end_id``): full sequences and the rest."""
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", "text", F.spark_partition_id().alias("__split"), F.monotonically_increasing_id().alias("__at"))
    tail = int(end_id).to_bytes(4, "little")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from fieldlink.llm.tokens import encoder

        enc = encoder(tokenizer)
        for f in frames:
            out = []
            for k in range(0, len(f), 500):
                g = f.iloc[k : k + 500]
                for doc_id, split, at, ids in zip(g["doc_id"], g["__split"], g["__at"], enc.encode(g["text"].tolist())):
                    ids += tail
                    n = len(ids) // 4
                    for s in range(0, n, room):
                        e = min(s + room, n)
                        out.append((doc_id, s, e - s, zlib.crc32(ids[4 * s : 4 * e]), n, split, at))
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "__split", "__at"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInPandas(cut, f"doc_id {kind}, {PIECES}")


def pack(docs: DataFrame, tokenizer: str, room: int = 4096, end_id: int = 2, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Sequences of at most ``room`` tokens; one row per piece.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    A document's ids are cut into full sequences and a rest. The rests'
    lengths, in units of up to 16 tokens rounded up, make a histogram of at
    most ``room / 16`` or 511 sizes; a rest larger than the room's whole units
    is a sequence of its own; column generation on the driver turns it into
    patterns with multiplicities (the histogram and the patterns are bounded
    by ``room``, not by the corpus). Documents of one size are ranked without
    gaps, by input split and place, and a rank's pattern, and so its sequence,
    follows by arithmetic. A size that a third of all documents have is ranked
    in as many tasks as there are splits.

    A null or empty text has the end id alone. Rows that repeat an id are
    packed as documents of their own; null ids are kept. An empty table gives
    an empty result; other columns are ignored.
    """
    if room < 1:
        raise ValueError(f"a sequence of {room} tokens has no room")
    unit = max(1, min(UNIT, room // 256))
    most = room // unit  # larger pieces are alone
    size = F.ceil(F.col("length") / unit).cast("int")
    cut = staged(pieces(docs, tokenizer, room, end_id, id_col, text_col).withColumn("size", F.when(
        (F.col("length") == room) | (size > most), F.lit(most + 1)).otherwise(size)), "pieces")
    histogram = {r["size"]: r["count"] for r in cut.where(F.col("size") <= most).groupBy("size").count().collect()}
    sizes, used = cutting_stock.patterns(histogram, most)
    # Of each size: from which rank on, how many in each copy, and the first copy's sequence.
    table: dict[int, list[tuple[int, int, int]]] = {}
    upto, first = dict.fromkeys(sizes.tolist(), 0), 0
    for pattern, n in used:
        for k in np.flatnonzero(pattern):
            s, a = int(sizes[k]), int(pattern[k])
            table.setdefault(s, []).append((upto[s], a, first))
            upto[s] += a * n
        first += n
    lookup = {s: np.array(rows, np.int64).T for s, rows in table.items()}
    whole_from = first

    @F.pandas_udf("long")
    def sequence(size: pd.Series, rank: pd.Series) -> pd.Series:
        size, rank = size.to_numpy(), rank.to_numpy()
        out = whole_from + rank  # a full piece is a sequence of its own
        for s in np.unique(size[size <= most]):
            at = size == s
            begin, each, base = lookup[int(s)]
            k = np.searchsorted(begin, rank[at], side="right") - 1
            out[at] = base[k] + (rank[at] - begin[k]) // each[k]
        return pd.Series(out)

    counts = cut.groupBy("size", "__split").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "__split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("size", "__split").orderBy("__at", "start")) - 1
    ranked = cut.withColumn("__nth", nth).join(offsets, ["size", "__split"])
    ranked = ranked.withColumn("sequence_id", sequence("size", F.col("__before") + F.col("__nth")))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "__at", "start").rowsBetween(
        Window.unboundedPreceding, -1)
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents: sequences of at most 4096 tokens."""
    return pack(documents(spark, sf_dir), default_tokenizer())
