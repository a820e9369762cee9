"""Token ids against the library on every kind of character."""

import random

import numpy as np
import pytest

from fieldlink.llm import packing, tokens

PATH = packing.default_tokenizer()


@pytest.fixture(scope="module")
def enc():
    return tokens.WordEncoder(PATH)


def library(enc, texts):
    return [np.array(x.ids, "<u4").tobytes() for x in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_every_letter_before_either_stop(enc):
    texts = [f"x {chr(c)}{stop}" for c in range(0x80, 0x20000) if chr(c).isalpha() for stop in ".,"]
    assert enc.encode(texts) == library(enc, texts)
    assert enc.encode(["Bu bir test: Aİ. Sonra Bİ, bitti."]) == library(enc, ["Bu bir test: Aİ. Sonra Bİ, bitti."])


def test_every_simple_character_alone_and_beside_others(enc):
    assert enc.latin is not None
    some = sorted(enc.latin.simple) + sorted(tokens.APART) + ["İ", "́", "한", "क़"]
    texts = [f"{a}{b}{c}" for a in ("", "a", "1", ".", "'") for b in some for c in ("", "a", "1", ".", "s", "'s")]
    assert enc.encode(texts) == library(enc, texts)


def test_mixed_scripts_in_one_call(enc):
    r = random.Random(3)
    alphabets = ["abcdefgh", "ABCdef'", "éàçÜß", "авгД", "ابت", "कखग़", "한국어", "日本", "123", ".,;!?-", " \t\n \u0085", "'s'll", "İıſ", "é"]
    texts = ["".join(r.choice(r.choice(alphabets)) for _ in range(r.randint(0, 60))) for _ in range(8000)]
    texts += ["<|endoftext|> a <|startoftext|>b", "<| x", "", " ", "don't we'll I'M 1.5 a1b2", "a" * 50_000, "é" * 5000 + "."]
    assert enc.encode(texts) == library(enc, texts)


def test_every_token_of_the_vocabulary_is_reached(enc):
    """What makes ranks by token and by pair agree: the text of each Latin token gives the token itself or the same ids."""
    of = {c: b for b, c in tokens._byte_letters().items()}
    texts = []
    for token in enc.tokenizer.get_vocab():
        try:
            texts.append(bytes(of[c] for c in token.removesuffix("</w>")).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    assert len(texts) > 40_000 and enc.encode(texts) == library(enc, texts)


def test_a_full_cache_changes_nothing(enc, monkeypatch):
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcdeé.,") for _ in range(r.randint(1, 6))) for _ in range(40)) for _ in range(300)]
    want = library(enc, texts)
    monkeypatch.setattr(tokens, "CACHE", 500)
    monkeypatch.setattr(tokens, "TOGETHER", 100)
    small = tokens.WordEncoder(PATH)
    assert small.encode(texts) == want and small.encode(texts[::-1]) == want[::-1]


def test_a_tokenizer_of_another_kind_takes_the_library_alone():
    import public_tokenizers  # noqa: F401

    import json

    with open(PATH, encoding="utf-8") as f:
        config = json.load(f)
    for key, value in [("normalizer", None), ("pre_tokenizer", None)]:
        assert tokens.LatinEncoder.of({**config, key: value}) is None
    assert tokens.LatinEncoder.of({**config, "model": {**config["model"], "type": "WordPiece"}}) is None
