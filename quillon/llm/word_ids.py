"""Token ids of whole texts by the tokenizers library, word by word with a cache.

The tokenizer in use splits at white space and drops it, so a text's ids are the ids of its space-separated words, one
after the other (the space, tab, line feed and carriage return that are split at here are white space to it too, and its
normaliser joins nothing across them). Texts repeat words often, so each task has the library encode a word once.

A word of letters alone that its normaliser would leave as it is (composed, lower case) is one pre-token; for these the
library's BPE model is called on the word's bytes without the steps before it. A capital of A-Z counts as its small
letter, and a mark after a letter is a pre-token of its own, so ``Word`` and ``word,`` need no further call. All other
words, and words with ``<|`` (special tokens are found before the text is normalised), go through the whole tokenizer.
"""

from __future__ import annotations

import os
import unicodedata
from array import array

from quillon.llm.text_arrays import lengths, slices

#: Words in a generation of a task's cache; the last full generation is kept too, and its words move over as they are met.
CACHE_WORDS = 250_000
LONG_WORD = 100
_MARKS = frozenset(".,;:!?")


def _byte_letters() -> dict[int, str]:
    """The visible stand-in of each byte in byte-level vocabularies: printable bytes are themselves, the others count up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder(dict):
    """Word to ids, as little-endian unsigned 32-bit integers; words are added when they are looked up."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.before: dict[str, bytes] = {}
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self._ids(word)
        if len(word) <= LONG_WORD:
            self[word] = ids
        return ids

    def _ids(self, word: str) -> bytes:
        if "<|" in word:
            return self._whole(word)
        if word[-1] in _MARKS and len(word) > 1 and self._stays(word[-2]):
            return self[word[:-1]] + self[word[-1]]
        if not word.isalpha():
            return self._whole(word)
        if word.isascii():
            small = word.lower()
            seen = small
        else:
            data = word.encode().lower()  # A-Z alone
            small = data.decode()
            if small.lower() != small or not unicodedata.is_normalized("NFC", small):
                return self._whole(word)
            seen = data.decode("latin-1").translate(self.letters)
        if small != word:
            return self[small]
        return _bytes([t.id for t in self.model.tokenize(seen)])

    @staticmethod
    def _stays(letter: str) -> bool:
        """Whether a letter is still one, and at the end, when it is composed and made small."""
        return letter.isalpha() and (letter.isascii() or letter.lower().isalpha() and unicodedata.is_normalized("NFC", letter))

    def _whole(self, word: str) -> bytes:
        return _bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        if len(self) > CACHE_WORDS:
            self.before = {}  # let go before the copy is made
            self.before = dict(self)
            self.clear()
            self[""] = b""
        get = self.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) if t else b"" for t in texts]


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if out.itemsize != 4 or _BIG:
        raise RuntimeError("needs 32-bit little-endian unsigned integers")
    return out.tobytes()


_BIG = array("H", [1]).tobytes() != b"\x01\x00"
_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def text_rows(batch, column: str):
    """Slices of a record batch with their texts as Python strings."""
    for a, b in slices(lengths(batch.column(column))):
        part = batch.slice(a, b - a)
        yield part, part.column(column).to_pylist()
