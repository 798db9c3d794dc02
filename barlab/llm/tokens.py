"""Token ids of whole texts in Arrow batches, with a bounded memo of words per Python worker.

The vocabulary drops white space and its splitting pattern never crosses it, so
the ids of a text are the ids of its words, one after the other. Only words
that a worker has not met go to the model. Latin words with nothing but
punctuation behind them go there in their two parts; all others pass the whole
tokenizer.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

#: Bytes that a worker's memo may take, by a rough count; beyond it the memo starts anew, which costs time and no results.
MEMO_BYTES = 200_000_000
#: What an entry takes besides its letters, and the longest word that is kept.
_ENTRY, _LONGEST = 200, 64

_LATIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-/:-@\[-^`{-~]*)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 16-bit integers."""
    return struct.pack(f"<{len(ids)}H", *ids)


def _byte_letters() -> dict[int, str]:
    """The printable sign of each byte in byte-level vocabularies, rebuilt from its rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of texts as little-endian unsigned 16-bit integers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        if self.model.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit in 16 bits")
        self.pieces = self.model.model.tokenize
        self.letters = _byte_letters()
        self.memo: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.held = 0

    def _part(self, part: str) -> bytes:
        """A run of letters in lower case, or a run of punctuation, that was not met before."""
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        got = _packed([t.id for t in self.pieces(shown)])
        if len(part) <= _LONGEST:
            self.parts[part] = got
            self.held += _ENTRY + len(part)
        return got

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if found := _LATIN.fullmatch(text):
            core, tail = found.groups()
            lower = core.lower()
            if lower.isalpha():
                get = self.parts.get
                got = get(lower) or self._part(lower)
                return got + (get(tail) or self._part(tail)) if tail else got
        return _packed(self.model.encode(text, add_special_tokens=False).ids)

    def _learnt(self, word: bytes) -> bytes:
        """The ids of a word that the memo lacks; it starts anew when full, within a text too."""
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.parts.clear()
            self.held = 0
        got = self._word(word)
        if len(word) <= _LONGEST:
            self.memo[word] = got
            self.held += _ENTRY + 2 * len(word)
        return got

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text; a null text has none."""
        get, learnt = self.memo.get, self._learnt
        for text in texts:
            parts = (text or "").encode().split()  # white space of ASCII only; the tokenizer drops the rest itself
            found = list(map(get, parts))
            for i in range(found.count(None)):
                at = found.index(None) if not i else found.index(None, at + 1)
                found[at] = get(parts[at]) or learnt(parts[at])  # it may have come before in this text
            yield b"".join(found)


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker and vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
