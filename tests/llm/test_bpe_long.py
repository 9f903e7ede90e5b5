"""Many long words, and words longer than a call takes, against the library that has the same vocabulary."""

import random
import time

import public_tokenizers
import pytest

from brookledger.llm import bpe

LATIN, THAI = "abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0xE01, 0xE2F)))
CHINESE = "".join(map(chr, range(0x4E00, 0x5000)))


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def known(codec):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={}).encode_ordinary


@pytest.mark.parametrize("letters,n", [(LATIN, 60), (THAI, 20), (CHINESE, 21)])
def test_twenty_thousand_words_in_one_text(codec, known, letters, n):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices(letters, k=n)) for _ in range(20_000))
    (ids,) = codec.encode([text])
    assert ids.tolist() == known(text) and codec.decode([ids]) == [text.encode()]


def test_a_million_letters(codec, known):
    """Some 20 seconds on one core of the machine that this was written on."""
    word = "".join(random.Random(2).choices(LATIN, k=1_000_000))
    began = time.thread_time()
    (ids,) = codec.encode([word])
    assert ids.tolist() == known(word) and time.thread_time() - began < 300


@pytest.mark.parametrize("letters", [LATIN, "etaoin", THAI, CHINESE, "a", "ab", "aAé本", "-=_#", " "])
def test_segments(codec, known, letters, monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 600)
    rng = random.Random(letters)
    words = ["".join(rng.choices(letters, k=n)) for n in (66, 599, 601, 1500)] + ["x" * rng.randint(600, 900) + letters[:3]]
    codec.known.clear(), codec.before.clear()
    for word, ids in zip(words, codec.encode(words)):
        assert ids.tolist() == known(word), word[:60]
