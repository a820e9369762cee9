"""License scans with a positional index of rare licence words."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlink.llm.common import ascii_lower, documents, id_and_text

#: What stands between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Start positions may lie before the text; they are kept above zero by this.
SHIFT = 1 << 20


@dataclasses.dataclass(frozen=True)
class Template:
    label: str
    text: str  # lower-case words
    key: str  # the mandatory phrase, words of the text that stand together
    base: bool = False  # an exact phrase whose places are reported

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key.split()
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


# The three phrases of the contract, then common public licence notices.
TEMPLATES = [
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee",
             "use copy modify and or distribute"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "source and binary forms"),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2",
             "gnu general public license version 2"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3",
             "gnu general public license version 3"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "released into the public domain"),
    Template("reserved", "copyright c all rights reserved", "all rights reserved"),
]


def words_of(text: Column) -> Column:
    """The words of a text in order; none for an empty text."""
    return F.filter(F.split(ascii_lower(text), BETWEEN), lambda w: w != "")


def word_rarity(docs: DataFrame, templates: list[Template], text_col: str = "text") -> dict[str, float]:
    """ln((N + 1) / (df + 1)) + 1 of each template word, over all documents.

    The rows brought to the driver are as many as the templates have different
    words, whatever the corpus holds.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    rows = id_and_text(docs, text_col, text_col).select(words_of(F.col("text")).alias("words"))
    own = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    # The empty word counts the documents.
    tally = rows.select(F.explode(F.concat(F.array(F.lit("")), own)).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in tally.collect()}
    n = df.get("", 0)
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary}


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text",
         rare: int = 3, min_share: float = 0.6) -> DataFrame:
    """``doc_id, n_words, places, matches`` for every row of ``docs``.

    ``rare`` words of each template with the highest IDF (over all documents)
    and the rarest word of its key phrase form a positional index; a base
    phrase is looked up by its rarest word.
    Every place where a text has an indexed word gives the template starts
    that would put it there; equal starts from several words fall together.
    At each start the template's words are compared by relative position, and
    the IDF share that matches must reach ``min_share`` (all of it for a base
    phrase) and the key phrase must stand there word by word. As each
    match holds the rarest word of its key phrase, no place is missed.

    ``matches``: array of (label, start, share, base); ``places``: sorted
    starts of base phrases. A null or empty text has no words and empty
    arrays; repeated rows, null ids and ties are scanned like any other row;
    other columns are ignored. One pass in a row's own arrays, linear in its
    words; no shuffle.
    """
    idf = word_rarity(docs, templates, text_col)
    postings: dict[str, list[tuple[int, int]]] = {}
    for n, t in enumerate(templates):
        rarest = lambda ws: sorted(set(ws), key=lambda w: (-idf[w], w))
        indexed = rarest(t.words)[: 1 if t.base else rare] + rarest(t.key.split())[:1]
        for at, w in enumerate(t.words):
            if w in indexed:
                postings.setdefault(w, []).append((n, at))
    wide = 1 << 32
    index = F.create_map(*[x for w, ps in sorted(postings.items())
                           for x in (F.lit(w), F.array(*[F.lit(n * wide + SHIFT - at).cast("long") for n, at in ps]))])
    rows = id_and_text(docs, id_col, text_col).select("doc_id", words_of(F.col("text")).alias("words"))
    # Positions of indexed words, as (position, word).
    rows = rows.withColumn("hits", F.filter(F.transform("words", lambda w, i: F.when(
        w.isin(sorted(postings)), F.struct(i.cast("long").alias("i"), w.alias("w")))), lambda h: h.isNotNull()))
    rows = rows.withColumn("starts", F.array_distinct(F.flatten(F.transform(
        "hits", lambda h: F.transform(index[h["w"]], lambda p: p + h["i"])))))

    def match(start: Column) -> Column:
        out = None
        n, at = F.floor(start / F.lit(wide)), (start % F.lit(wide) - F.lit(SHIFT)).cast("int")
        for k, t in enumerate(templates):
            total = sum(idf[w] for w in t.words)
            share = sum((F.when(F.get("words", at + F.lit(j)) == w, F.lit(idf[w] / total)).otherwise(F.lit(0.0))
                         for j, w in enumerate(t.words)), F.lit(0.0))
            key = t.key.split()
            key_ok = F.lit(True)
            for j, w in enumerate(key):
                key_ok = key_ok & F.coalesce(F.get("words", at + F.lit(t.key_at + j)) == w, F.lit(False))
            one = F.when(key_ok & (share >= F.lit(0.999999 if t.base else min_share)), F.struct(
                F.lit(t.label).alias("label"), at.alias("start"), F.least(share, F.lit(1.0)).alias("share"),
                F.lit(t.base).alias("base")))
            out = F.when(n == k, one) if out is None else out.when(n == k, one)
        return out

    rows = rows.withColumn("matches", F.filter(F.transform("starts", match), lambda m: m.isNotNull()))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "matches", F.array_sort(F.transform(
        F.filter("matches", lambda m: m["base"]), lambda m: m["start"].cast("long"))).alias("places"))


def op10_license_scans(spark, sf_dir: str) -> DataFrame:
    """Contract query over all documents.

    ``score``: the best IDF share of a template at one place whose key phrase
    stands there; 0 without any.
    """
    found = scan(documents(spark, sf_dir))
    label = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"), label(F.filter("matches", lambda m: m["base"])).alias("base_labels"),
        label(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"))
