"""Words of letters go to the tokenizer's model directly; ids are the library's."""

import random

import numpy as np
import public_tokenizers

from corpusloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_have_the_librarys_ids():
    words = packing.WordTokenizer(PATH)
    assert words.plain
    rng = random.Random(3)
    near = packing.LETTERS + packing.LETTERS.upper() + "\u00aa\u00ba\u00b5\u00d7\u00f7\u0130\u0131\u0149\u0178\u017f\u03a3\u03c3\u03c2\u0301\u0308'.,-1\u212a\u00df"
    texts = ["".join(rng.choices(packing.LETTERS[:26], k=rng.randrange(1, 12))) for _ in range(300)]
    texts += ["".join(rng.choices(near, k=rng.randrange(1, 12))) for _ in range(1500)]
    texts += ["".join(rng.choices(packing.LETTERS + packing.LETTERS.upper(), k=rng.randrange(1, 90))) for _ in range(500)]
    texts += list(near) + ["e\u0301te\u0301", "I\u0307", "STRASSE", "Stra\u00dfe", "\u1e9e", "<|endoftext|>", "a<|startoftext|>b"] + [" ".join(rng.choices(texts, k=6)) for _ in range(200)]
    for text in texts:
        want = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode_bytes(text), "<u4").tolist() == want, text


def test_a_word_of_letters_does_not_take_the_whole_way(monkeypatch):
    """Each new word was normalized, split and aligned by the library, which took half of op3_packing's time."""
    words = packing.WordTokenizer(PATH)
    asked = []
    monkeypatch.setattr(words, "_ids", lambda word: asked.append(word) or b"")
    words.encode_bytes("Einzu\u00dfen ci\u00f3nllcido THE onantiat \u00c9eaueau, 42 x")
    assert not [w for w in asked if w.isalpha()]
