"""The tokenizer's memo stays within its bytes, inside one text too, and gives the tokenizer's ids."""

import random

from barlab.llm import tokens


def test_bounded_within_one_text(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_BYTES", 20_000)
    known = tokens.WordTokenizer(tokens.default_vocabulary())
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdeé!") for _ in range(rng.randint(1, 9))) for _ in range(3000)) + " " + "x" * 5000 + " " + "éü" * 300
    got = list(known.ids([text, None, text]))
    want = known.model.encode(text, add_special_tokens=False).ids
    assert [list(memoryview(g).cast("H")) for g in got] == [want, [], want]
    assert known.held <= 20_000 + 2 * (200 + 3 * 64)
    assert all(len(w) <= 64 for w in [*known.memo, *known.parts])
