"""Token ids of whole texts as the ``tokenizers`` library gives them.

White space never joins what stands around it, so the ids of a text are those
of its words in order, and a word needs splitting once while a bounded cache
holds it. New words in Latin letters are split by ``tiktoken`` with the
tokenizer's own merges, others by the library.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import accumulate, chain

import numpy as np

#: Words kept per worker; of a full cache the shorter half stays, as short words come again more often.
CACHE = 500_000
#: Length of the longest word that is kept.
LONG = 12


#: Last of the simple characters, and those before it that Python and the library may class differently.
LATIN, APART = 0x24F, set(map(chr, range(0x1C, 0x20)))
#: Words of some texts that are looked up at a time, and new ones that are split at a time.
TOGETHER, NEW = 200_000, 20_000


class LatinEncoder:
    """Ids of words whose characters are simple: the same in NFC, lower-cased to one character, none combining.

    A byte-pair tokenizer that marks the ends of words has every piece end in
    ``</w>``; here a blank stands for that mark, since no piece holds one. The
    blank joins the byte before it first, then the merges follow by their rank.
    As every merged token has one pair that makes it, ranks by token and ranks
    by pair are the same.
    """

    NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]

    def __init__(self, config: dict):
        import tiktoken

        model, split = config["model"], config["pre_tokenizer"]["pretokenizers"][0]
        suffix = model["end_of_word_suffix"]
        letter = _byte_letters()
        of = {c: b for b, c in letter.items()}
        self.simple = {c for c in map(chr, range(LATIN + 1)) if c not in APART and unicodedata.normalize("NFC", c) == c
                       and len(c.lower()) == 1 and ord(c.lower()) <= LATIN}
        kinds = {k: "".join(re.escape(c) for c in sorted(self.simple) if unicodedata.category(c)[0] == k) for k in "LN"}
        pattern = split["pattern"]["Regex"].replace(r"\p{L}", kinds["L"]).replace(r"\p{N}", kinds["N"])
        self.pieces = re.compile(pattern).findall
        self.odd = re.compile("[^" + "".join(re.escape(c) for c in sorted(self.simple)) + "]").search
        def raw(token: str) -> bytes:
            end = token.endswith(suffix)
            return bytes(of[c] for c in (token[: -len(suffix)] if end else token)) + b" " * end

        ranks, vocab = {bytes([b]): b for b in range(256)}, model["vocab"]
        ranks |= {bytes([b]) + b" ": 256 + b for b in range(256) if b != 32}
        ids = np.zeros(512 + len(model["merges"]), "<u4")
        for b in range(256):
            ids[b], ids[256 + b] = vocab[letter[b]], vocab[letter[b] + suffix]
        for k, pair in enumerate(model["merges"], 512):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            token = raw(a + b)
            if token in ranks:
                raise ValueError("two pairs make one token")
            ranks[token], ids[k] = k, vocab[a + b]
        self.ids, self.ends = ids, np.zeros(len(ids), bool)
        for token, k in ranks.items():
            self.ends[k] = token.endswith(b" ")
        self.merge = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    @classmethod
    def of(cls, config: dict) -> LatinEncoder | None:
        """The encoder of a tokenizer file that works as this class does, else None."""
        model, pre = config["model"], (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
        fits = (model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("dropout")
                and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
                and (config.get("normalizer") or {}).get("normalizers") == cls.NORMAL and len(pre) == 2
                and pre[0]["type"] == "Split" and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
                and "Regex" in pre[0]["pattern"] and pre[1]["type"] == "ByteLevel"
                and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"])
        try:
            return cls(config) if fits else None
        except (KeyError, ValueError):
            return None

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-cased words of simple characters, white space none of them."""
        found = [[w] if w.isascii() and w.isalpha() else self.pieces(w) for w in words]
        ranks = self.merge(" ".join(chain.from_iterable(found)) + " ")
        raw = self.ids[ranks].tobytes()
        # Where each piece ends, and the last one of each word.
        at = np.concatenate([[0], np.flatnonzero(self.ends[ranks]) + 1])[list(accumulate(map(len, found), initial=0))]
        cuts = (4 * at).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


class WordEncoder:
    """Ids of a tokenizer whose pre-tokenizer drops white space and whose normaliser lower-cases.

    White space never joins what stands around it, so the ids of a text are
    those of its words in order. Words not known yet are encoded by the
    library together and kept as little-endian unsigned 32-bit bytes: words of
    letters in one text, told apart by the pieces that end a word; others with
    a special token between them. A word of ASCII letters and the full stop or
    comma behind it are apart to the pre-tokenizer too, so their ids are joined.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            self.latin = LatinEncoder.of(json.load(f))
        self.tokenizer, self.plain, self.known = Tokenizer.from_file(path), Tokenizer.from_file(path), {}
        # Lower-case ASCII words of letters need no normalising and are one word each to the pre-tokenizer.
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.between, self.marker = max(special.items(), key=lambda x: x[1])
        #: A word with one of these may hold a special token.
        self.begins = {t[:2].encode() for t in special}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        # Lower-casing A-Z beforehand changes nothing where the normaliser does it anyway.
        sample = "quick brown zebras"
        self.lowers = self._ids("Q") == self._ids("q") and (self._array(sample, self.plain) == self._array(sample)).all()
        stops = {c: self._ids(c.decode()) for c in (b".", b",")}
        self.stops = {c: ids for c, ids in stops.items() if self._ids("qz" + c.decode()) == self._ids("qz") + ids}

    def _array(self, text: str, tokenizer=None) -> np.ndarray:
        found = (tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)
        return np.array(found[0].ids, "<u4")

    def _ids(self, text: str) -> bytes:
        return self._array(text).tobytes()

    def _learn(self, words: set[bytes]) -> None:
        known, stops, begins = self.known, self.stops, self.begins
        letters, wide, other, ended, odd = set(), set(), [], [], []
        for w in words:
            stem = w[:-1] if w[-1:] in stops else w
            if stem.isalpha() and stem.islower():  # of bytes: ASCII letters
                if stem not in known:
                    letters.add(stem)
            elif stem is w and w.decode().isalpha():
                # Not with a stop: the normal form of a letter may end in a mark that is one piece with the stop.
                wide.add(w)
            elif any(m in w for m in begins):
                odd.append(w)
                continue
            else:
                other.append(w)
                continue
            if stem is not w:
                ended.append(w)
        for w in odd:
            known[w] = self._ids(w.decode())
        if not self.lowers:
            wide |= letters
            letters = set()
        for tokenizer, group in ((self.plain, list(letters)), (self.tokenizer, list(wide))):
            for at in range(0, len(group), 20_000):
                some = group[at : at + 20_000]
                ids = self._array(b" ".join(some).decode(), tokenizer)
                cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                if len(cuts) != len(some):  # not a word's end for each word
                    other += some
                    continue
                raw, start = ids.tobytes(), 0
                for w, cut in zip(some, cuts):
                    known[w] = raw[4 * start : 4 * cut]
                    start = cut
        for at in range(0, len(other), 20_000):
            some = other[at : at + 20_000]
            ids = self._array(self.between.join([w.decode() for w in some]))
            raw, start = ids.tobytes(), 0
            for w, cut in zip(some, [*np.flatnonzero(ids == self.marker).tolist(), len(ids)], strict=True):
                known[w] = raw[4 * start : 4 * cut]
                start = cut + 1
        for w in ended:
            known[w] = known[w[:-1]] + stops[w[-1:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts."""
        begins = [m.decode() for m in self.begins]
        simple = [self.latin is not None and not self.latin.odd(t) and not any(m in t for m in begins) for t in texts]
        out: list[bytes] = [b""] * len(texts)
        for kind in (True, False):
            at = [i for i, s in enumerate(simple) if s == kind]
            held, n = [], 0
            for i in at:
                if kind:
                    words = texts[i].lower().split()
                else:
                    raw = texts[i].encode()
                    words = (raw.lower() if self.lowers and not any(m in raw for m in self.begins) else raw).split()
                held.append((i, words))
                n += len(words)
                if n > TOGETHER or i == at[-1]:
                    self._look_up(held, self._learn_simple if kind else self._learn, out)
                    held, n = [], 0
        return out

    def _learn_simple(self, words: set[str]) -> None:
        new = list(words)
        for k in range(0, len(new), NEW):
            self.known.update(zip(new[k : k + NEW], self.latin.words(new[k : k + NEW])))

    def _look_up(self, texts: list[tuple[int, list]], learn, out: list[bytes]) -> None:
        """Join the words' ids of some texts, after those not known yet were learnt together."""
        known, words = self.known, list(chain.from_iterable(ws for _, ws in texts))
        ids = list(map(known.get, words))
        missing = [k for k, x in enumerate(ids) if x is None]
        if missing:
            new = {words[k] for k in missing}
            if len(known) + len(new) > CACHE:
                stay = sorted(known.items(), key=lambda x: len(x[0]))[: CACHE // 2]
                known.clear()
                known.update(stay)
            learn(new)
            for k in missing:
                ids[k] = known[words[k]]
            for w in new:  # a long word hardly comes again
                if len(w) > LONG:
                    known.pop(w, None)
        at = 0
        for i, ws in texts:
            out[i] = b"".join(ids[at : at + len(ws)])
            at += len(ws)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder; one per file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
