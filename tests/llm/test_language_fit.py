"""What the language model learns of long documents and of many languages."""

import random

from corpusloom.llm import language_id


def test_documents_have_equal_shares():
    assert language_id.equal_shares(["a" * 100, "bb", "c" * 100], 24) == "a" * 10 + "\nbb\n" + "c" * 10
    assert language_id.equal_shares(["ab", "cd"], 99) == "ab\ncd" and language_id.equal_shares([], 9) == ""
    assert len(language_id.equal_shares(["abc"] * 60, 7)) <= 7
    model = language_id.fit({"a": ["abcabc " * 10_000, "xyzzy quux"], "b": ["k"]})
    assert language_id.phrases(model, ["xyzzy quux"])[0][0] == 1


def test_all_languages_are_learned():
    rng = random.Random(1)
    texts = {f"l{i:03}": "".join(rng.choice("abcdefghijklmnop ") for _ in range(200)) for i in range(300)}
    model = language_id.fit({k: [t] for k, t in texts.items()})
    assert language_id.classify(model, [t[20:180] for t in texts.values()])[0] == sorted(texts)
