"""Substring dedup: hash normalised units, keep the earliest of each, remove the rest."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlink.llm.common import documents, id_and_text, staged

#: How a text falls into units; each takes the separator that follows it.
UNITS = {
    "line": re.compile(r"[^\n]*\n|[^\n]+"),
    "paragraph": re.compile(r"(?:[^\n]+|\n(?!\s*\n))+(?:\n\s*)?|\n\s*"),
    # Lines, cut after sentence ends as well, so a passage inside a line is seen.
    "sentence": re.compile(r"[^\n.!?]*(?:[.!?]+(?!\s)[^\n.!?]*)*(?:[.!?]+[^\S\n]*\n?|\n|\Z)"),
}
#: Sentences as above, with the full stops of unspaced scripts, after which no space stands.
SENTENCE = re.compile(r"[^\n.!?。！？]*(?:[.!?]+(?!\s)[^\n.!?。！？]*)*(?:[.!?]+[^\S\n]*\n?|[。！？]+[^\S\n]*\n?|\n|\Z)")
#: Characters of scripts that are written without spaces; UNSPACED_WORD of them count as a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
UNSPACED_WORD = 2
#: Words of the shortest passage of the registered query. Of sf0.01's documents without a passage of 51 words that stood
#: before, 55 % lose nothing at 8 words with lines of any length, 65 % at 8, 87 % at 12, 92 % at 16, 94 % at 32; those
#: with one lose something at each of these.
PASSAGE_WORDS = 16


def units_of(text: str, unit: str) -> Iterator[tuple[int, int]]:
    """(start, end) in code points of each unit; together they are the text."""
    for m in UNITS[unit].finditer(text):
        if m.end() > m.start():
            yield m.span()


def normalised(piece: str) -> list[str]:
    """Words of a unit in lower case, without white space."""
    return piece.lower().split()


def passages_of(text: str, min_words: int) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of what a text can share with an earlier one; the pieces overlap.

    From each sentence on, and back from each sentence, the fewest whole
    sentences with ``min_words`` words: any run of sentences with so many
    words, however short each of them is, is a union of such pieces, wherever
    it begins. Besides, every line and paragraph of so many words as a whole;
    a shorter one counts only as a part of a run.
    """
    words: list[str] = []
    sentences, first, sizes = [], [], [0]  # without blank ones; first word of each, and words so far
    unspaced = UNSPACED.search(text) is not None
    for m in SENTENCE.finditer(text):
        if own := normalised(m.group()):
            sentences.append(m.span())
            first.append(len(words))
            words += own
            size = len(own)
            if unspaced:
                size = max(size, len(UNSPACED.findall(m.group())) // UNSPACED_WORD)
            sizes.append(sizes[-1] + size)
    first.append(len(words))
    n = len(sentences)
    runs = []
    j = 0
    for i in range(n):  # the fewest from i on
        while j < n and sizes[j] - sizes[i] < min_words:
            j += 1
        if sizes[j] - sizes[i] < min_words:
            break
        runs.append((i, j))
    i = 0
    for j in range(1, n + 1):  # the fewest up to j
        while sizes[j] - sizes[i + 1] >= min_words and i + 1 < j:
            i += 1
        if sizes[j] - sizes[i] >= min_words:
            runs.append((i, j))
    for unit in ("line", "paragraph"):  # both end where a sentence does
        i = 0
        for _, end in units_of(text, unit):
            j = bisect_right(sentences, end, lo=i, key=lambda s: s[1])
            if j > i and sizes[j] - sizes[i] >= min_words:
                runs.append((i, j))
            i = j
    for i, j in sorted(set(runs)):
        yield sentences[i][0], sentences[j - 1][1], words[first[i] : first[j]]


def pieces_of(text: str, unit: str, min_words: int) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of the units that are hashed; ``unit`` is one of UNITS or ``passage``."""
    if unit == "passage":
        yield from passages_of(text, min_words)
        return
    for s, e in units_of(text, unit):
        words = normalised(text[s:e])
        if len(words) >= min_words:
            yield s, e, words


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row, text``: each row with a number of its own, in input order."""
    return id_and_text(docs, id_col, text_col).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")


def units(rows: DataFrame, unit: str, min_words: int) -> DataFrame:
    """A row per unit of at least ``min_words`` words (``passage``: see :func:`passages_of`): where it stands and a 128-bit digest.

    Of ``numbered`` rows. ``again``: the same text has the digest before,
    clear of this unit, so a unit never takes part of its own first copy. Each of them also gives one row that is no unit,
    with ``start`` -1, so rows without units are not lost.
    """
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), 500):
                g = f.iloc[k : k + 500]
                at, starts, ends, again, digests = [], [], [], [], []
                for n, text in enumerate(g["text"]):
                    seen = {}  # digest to the end of its first unit
                    for s, e, words in pieces_of(text, unit, min_words):
                        d = xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))
                        at.append(n)
                        starts.append(s)
                        ends.append(e)
                        again.append(s >= seen.setdefault(d, e) > 0)
                        digests.append(d)
                h = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
                at = np.array(at, int)
                yield pd.DataFrame({"doc_id": g["doc_id"].take(at).reset_index(drop=True),
                                    "row": g["row"].to_numpy()[at], "start": starts, "end": ends, "again": again,
                                    "h1": h[:, 0], "h2": h[:, 1]})
                yield pd.DataFrame({"doc_id": g["doc_id"], "row": g["row"], "start": -1, "end": -1, "again": False,
                                    "h1": 0, "h2": 0})

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInPandas(cut, f"doc_id {kind}, row long, start int, end int, again boolean, h1 long, h2 long")


def repeated_units(docs: DataFrame, unit: str = "line", min_words: int = 1, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Units that an earlier one repeats: ``doc_id, row, start, end`` with original offsets.

    Units are ranked by document id, then place; the earliest unit with a
    digest stays. Digests are grouped over all documents with map-side
    combined aggregates; units meet their group in joins whose left side AQE
    splits, so a line that a third of all documents hold needs no single task.
    Rows that repeat an id are ranked by input place. Units of null-id rows
    rank last.
    """
    return _repeated(staged(units(numbered(docs, id_col, text_col), unit, min_words), "units"))


def _repeated(found: DataFrame) -> DataFrame:
    found = found.where("start >= 0")
    groups = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
    # Written first: a join straight on an aggregate could not split a hot digest.
    groups = staged(groups.drop("n"), "unit-groups")
    shared = staged(found.join(groups, ["h1", "h2"]), "shared-units")
    first = shared.where(F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("h1", "h2").agg(
        F.min("row").alias("first_row"))
    first = staged(first, "first-units")
    return shared.join(first, ["h1", "h2"], "left").where(
        (F.col("row") != F.col("first_row")) | F.col("again")).select("doc_id", "row", "start", "end")


def joined(starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Pieces that overlap or touch made one; they come in order of their starts."""
    out = []
    for s, e in zip(starts, ends):
        reach = np.maximum.accumulate(e)
        new = np.flatnonzero(np.r_[True, s[1:] > reach[:-1]])
        last = np.r_[new[1:] - 1, len(s) - 1]
        out.append([{"start": a, "end": b} for a, b in zip(s[new].tolist(), reach[last].tolist())])
    return pd.Series(out, dtype=object)


def removals(rows: DataFrame, unit: str = "line", min_words: int = 1) -> DataFrame:
    """``doc_id, row, removed`` of every ``numbered`` row: the (start, end) it loses, by start; none is an empty array.

    Units other than passages are disjoint and stay apart; passages that
    overlap or touch are joined. What a removed passage says stands earlier
    and, if that place is removed too, earlier still, so nothing is lost.
    """
    found = staged(units(rows, unit, min_words), "units")
    gone = _repeated(found).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    if unit == "passage":
        join = F.pandas_udf(joined, "array<struct<start:int,end:int>>")
        gone = gone.select("row", join("removed.start", "removed.end").alias("removed"))
    return found.where("start < 0").select("doc_id", "row").join(gone, "row", "left").select(
        "doc_id", "row", F.coalesce("removed", F.array().cast("array<struct<start:int,end:int>>")).alias("removed"))


def deduplicate(docs: DataFrame, unit: str = "line", min_words: int = 1, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Every row's ``doc_id, text`` without repeated units, and the ``removed`` original offsets.

    A null text counts as empty; an empty table gives an empty result. The
    numbered rows are written first: both reads of them see the same numbers.
    """
    rows = staged(numbered(docs, id_col, text_col), "numbered")
    gone = removals(rows, unit, min_words).drop("doc_id")
    # The kept pieces lie between the removed ones.
    ends = F.concat(F.transform("removed", lambda s: s["start"]), F.array(F.length("text")))
    begins = F.concat(F.array(F.lit(0)), F.transform("removed", lambda s: s["end"]))
    text = F.col("text")
    kept = F.array_join(F.zip_with(begins, ends, lambda b, e: text.substr(b + 1, e - b)), "")
    return rows.join(gone, "row").select("doc_id", F.when(F.size("removed") == 0, text).otherwise(kept).alias("text"),
                                         "removed")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated passages over all documents: what each document loses.

    Runs of whole sentences, lines and paragraphs of ``PASSAGE_WORDS`` words or
    more. ``doc_id, n_removed, removed_chars, removed`` (``start:end``, comma-joined;
    code points of the original text), one row per document.
    """
    gone = removals(numbered(documents(spark, sf_dir)), "passage", PASSAGE_WORDS)
    return gone.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.aggregate(
        "removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("removed_chars"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("removed"))
