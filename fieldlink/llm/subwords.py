"""SentencePiece encoding and decoding with forward scores shared along a trie of words."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlink.llm.common import documents, id_and_text

SPACE = "▁"
#: Words and piece pairs kept per worker; of a full cache of words the shorter half stays. Words of some texts that are looked up at a time.
CACHE, PAIRS, TOGETHER = 400_000, 2_000_000, 200_000
#: Keys of a trie node beside its children.
PIECE, FITS = 0, 1
WORD = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


class Vocabulary:
    """Pieces and scores of a model with byte fallback, read through the library."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.score, self.byte, self.raw = {}, {}, {}, []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
                self.raw.append(piece.replace(SPACE, " ").encode())
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or any("\n" in p and p != "\n" for p in self.ids):
            raise ValueError("a piece spans words; texts of this model can't be cut into words")
        self.words: dict[str, bytes] = {}
        # The pieces as a trie: a node has its children by character, the piece that ends there, and for every piece
        # that may stand before it whether the two are left apart.
        self.root: dict = {}
        for piece in self.ids:
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[PIECE], node[FITS] = piece, {}
        self.pairs = 0

    def merges(self, text: str) -> list[str]:
        """Pieces of a short string by merging the best-scored neighbours, leftmost first."""
        parts, of, none = list(text), self.score.get, -np.inf
        scores = [of(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores:
            best = max(scores)
            if best == none:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = of(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = of(parts[i] + parts[i + 1], none)
        return parts

    def fits(self, before: str | None, node: dict) -> bool:
        """Whether the model leaves this neighbour and the node's piece apart (and the piece whole)."""
        piece = node[PIECE]
        if self.pairs >= PAIRS:
            self._forget(self.root)
            self.pairs = 0
        self.pairs += 1
        ok = self.merges((before or "") + piece) == ([before, piece] if before else [piece])
        node[FITS][before] = ok
        return ok

    def _forget(self, node: dict) -> None:
        node.get(FITS, {}).clear()
        for c, child in node.items():
            if isinstance(c, str):
                self._forget(child)

    def encode_words(self, words: list[str]) -> None:
        """Ids of words not known yet, as little-endian unsigned 32-bit bytes in ``self.words``.

        The words in sorted order are a depth-first walk of their trie. A
        node's forward state is the last piece of its prefix's best
        segmentation; it follows from the states above it alone, since the
        pieces of a prefix that ends at a piece boundary stay the same
        whatever follows. Beside it stand the pieces that go on here: the
        places where one may have begun, with their node in the trie of
        pieces. A word starts from the states it shares with the word before.
        """
        ids, root, fits = self.ids, self.root, self.fits
        last: list[str] = []  # the piece that ends at each character of the current path
        going: list[list] = []  # and (start, node) of the pieces that go on behind it, earliest start first
        prior = ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(prior, word):
                if a != b:
                    break
                shared += 1
            del last[shared:], going[shared:]
            alive = going[-1] if shared else []
            for end in range(shared, len(word)):
                c, found, nxt = word[end], None, []
                for start, node in alive:
                    node = node.get(c)
                    if node is not None:
                        nxt.append((start, node))
                        if found is None and PIECE in node:
                            before = last[start - 1] if start else None
                            if before is not None and before not in ids:
                                before = None
                            ok = node[FITS].get(before)
                            if ok or (ok is None and fits(before, node)):
                                found = node[PIECE]
                node = root.get(c)
                if node is not None:
                    nxt.append((end, node))
                if found is None:  # the character itself; outside the vocabulary it becomes bytes, merged with nothing
                    found = c
                last.append(found)
                going.append(nxt)
                alive = nxt
            out, end = [], len(word)
            while end:
                piece = last[end - 1]
                out += [ids[piece]] if piece in ids else [self.byte[b] for b in reversed(piece.encode())]
                end -= len(piece)
            out.reverse()
            self.words[word] = array("I", out).tobytes()
            prior = word

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts: the words of the marked text one after another."""
        out, held, n = [], [], 0
        for i, t in enumerate(texts):
            held.append(WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [])
            n += len(held[-1])
            if n > TOGETHER or i + 1 == len(texts):
                out += self._look_up(held)
                held, n = [], 0
        return out

    def _look_up(self, texts: list[list[str]]) -> list[bytes]:
        known, words = self.words, list(chain.from_iterable(texts))
        ids = list(map(known.get, words))
        missing = [k for k, x in enumerate(ids) if x is None]
        if missing:
            new = {words[k] for k in missing}
            if len(known) + len(new) > CACHE:
                stay = sorted(known.items(), key=lambda x: len(x[0]))[: CACHE // 2]
                known.clear()
                known.update(stay)
            self.encode_words(list(new))
            for k in missing:
                ids[k] = known[words[k]]
        at, out = 0, []
        for ws in texts:
            out.append(b"".join(ids[at : at + len(ws)]))
            at += len(ws)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces put together, marks read as spaces, without the first."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").removeprefix(" ")


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The worker's vocabulary; one per file."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row: little-endian unsigned 32-bit piece ids in one binary value.

    The ids are those of the library's own encoder. No shuffle: words are
    sorted into a trie for some hundred texts at a time, with a bounded cache
    of words across them. A null or empty text has no ids; rows, null ids and
    repeated rows are kept as they are; other columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc = vocabulary(model)
        for f in frames:
            for k in range(0, len(f), 500):
                g = f.iloc[k : k + 500]
                yield pd.DataFrame({"doc_id": g["doc_id"], "ids": voc.encode(g["text"].tolist())})

    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from ids as ``encode`` gives them; null ids give an empty text."""
    rows = encoded.select(encoded[id_col].alias("doc_id"), F.coalesce(encoded[ids_col], F.lit(b"")).alias("ids"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc = vocabulary(model)
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "text": [voc.decode(bytes(x)) for x in f["ids"]]})

    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_ids, ids_crc32, decoded_crc32, round_trip``: encoding and decoding in one pass."""
    rows = id_and_text(docs, id_col, text_col)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc = vocabulary(model)
        for f in frames:
            out = []
            for k in range(0, len(f), 500):
                g = f.iloc[k : k + 500]
                for doc_id, text, ids in zip(g["doc_id"], g["text"], voc.encode(g["text"].tolist())):
                    back = voc.decode(ids)
                    out.append((doc_id, len(ids) // 4, zlib.crc32(ids), zlib.crc32(back.encode()), back == text))
            yield pd.DataFrame(out, columns=["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "round_trip"])

    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_ids long, ids_crc32 long, decoded_crc32 long, "
                                 "round_trip boolean")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All documents: number and checksum of their piece ids, and whether decoding gives the text back."""
    return digests(documents(spark, sf_dir), default_model())
