"""SentencePiece encoding and decoding of BPE models with a prefix table.

BPE has this property: if a text's tokens are t1 .. tn, then those of each prefix that ends with ti are t1 .. ti, and a
row of tokens is a text's encoding exactly if each token encodes itself and each neighbouring pair encodes itself (is
compatible). So each prefix has one last token: of the vocabulary's pieces that end there (found by an Aho-Corasick
automaton), the one that is compatible with the last token of the prefix before it. The table of last tokens is filled
from left to right in time linear in the text, however long its words are, and the ids are read from it backwards.

No piece of the model joins a space mark to what stands before it, so a text falls into words that start with space
marks, and each word's ids depend on it alone; a task keeps the ids of the words that it has seen.

Defined cases: null is an empty text, and empty texts have no ids; characters outside the vocabulary become their UTF-8
bytes' tokens; control tokens' names in a text are ordinary text; repeated rows, null ids and other columns do no harm;
a very long text is encoded whole.

Scale: map-only. A task holds some 4 MB of texts at a time with their ids, and its word cache (two generations of
CACHE_WORDS); a single text takes some 25 times its bytes (430 MB were measured for one of 19 MB).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.word_ids import text_rows

MARK = "▁"
#: Words in a generation of a task's cache.
CACHE_WORDS = 400_000
CACHE_PAIRS = 1_000_000
LONG_WORD = 100
_ENDS = ".,;:!?"
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceModel:
    """The pieces of a SentencePiece BPE model, encoding by prefix table, and decoding."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = lib.get_piece_size()
        special = [lib.is_control(i) or lib.is_unknown(i) for i in range(self.size)]
        names = [lib.id_to_piece(i) for i in range(self.size)]
        self.rank = {name: (-lib.get_score(i), i) for i, name in enumerate(names) if not special[i] and not lib.is_byte(i)}
        self.id = {name: i for name, (_, i) in self.rank.items()}
        self.byte_id = {int(names[i][3:5], 16): i for i in range(self.size) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        self.shown = [b"" if lib.is_control(i) else b" \xe2\x81\x87 " if lib.is_unknown(i) else bytes([int(n[3:5], 16)]) if lib.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.bytewise = np.array([lib.is_byte(i) for i in range(self.size)])
        self.automaton = ahocorasick.Automaton()
        for name in self.rank:
            if len(name) == 1 or self.merged(name) == [name]:  # others are never made
                self.automaton.add_word(name, name)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Neighbouring characters within pieces: between others no token reaches.
        self.inner = {name[i : i + 2] for name in self.rank for i in range(len(name) - 1)}
        self.ends = {c: (",".join(map(str, ids)), len(ids), self.joined(ids)) for c in _ENDS for ids in [self.word_ids(c)]}
        self.seen = _Seen(self)

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the best pair first, leftmost among equals. For short texts."""
        parts, rank = list(text), self.rank
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r[0] < best):
                    best, at = r[0], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
            got = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return got

    def tokens(self, word: str) -> list[str]:
        """Tokens of a word (or any text) by the prefix table."""
        last: list[str | None] = [None] * len(word)
        pairs, compatible = self.pairs, self.compatible
        for end, piece in self.automaton.iter(word):  # ends ascend, and the longest piece of an end comes first
            if last[end] is not None:
                continue
            begin = end - len(piece)
            if begin < 0:  # the whole prefix is one token
                last[end] = piece
                continue
            if (left := last[begin]) is None:
                left = last[begin] = word[begin]  # not in the vocabulary
            ok = pairs.get((left, piece))
            if ok or ok is None and compatible(left, piece):
                last[end] = piece
        out, end = [], len(word) - 1
        while end >= 0:
            piece = last[end] or word[end]
            out.append(piece)
            end -= len(piece)
        out.reverse()
        return out

    def word_ids(self, word: str) -> list[int]:
        ids = []
        for token in self.tokens(word):
            own = self.id.get(token)
            if own is not None:
                ids.append(own)
            elif self.byte_id:
                ids += [self.byte_id[b] for b in token.encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def words(self, text: str) -> list[str]:
        return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for word in self.words(text) for i in self.word_ids(word)]

    def decode(self, ids) -> str:
        """The text of ids: pieces with marks as spaces, without the space put before the text; bytes that form no character show as U+FFFD."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        data = self.joined(ids.tolist())
        return data[1:] if data[:1] == " " and not self.bytewise[ids[0]] else data

    def joined(self, ids: list[int]) -> str:
        return b"".join([self.shown[i] for i in ids]).decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the decoded text."""
        if not text:
            return 0, _sha(""), _sha("")
        if "  " in text or MARK in text or text[0] == " ":
            words = self.words(text)
        else:
            words = text.split(" ")  # without their marks
        names, numbers, shown = zip(*map(self.seen.__getitem__, words), strict=True)
        return sum(numbers), _sha(",".join(names)), _sha("".join(shown)[1:])  # the first word starts with the mark put before the text


class _Seen(dict):
    """Of each word (with its marks, or without its only one): ids in decimal joined by commas, their number, the text they decode to. Words are added when they are looked up; two generations are kept."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model, self.before = model, {}

    def __missing__(self, word: str) -> tuple[str, int, str]:
        got = self.before.get(word)
        if got is None:
            model = self.model
            if word[-2:] not in model.inner and word[-1:] in _ENDS and len(word) > 1:
                a, b = self[word[:-1]], model.ends[word[-1]]
                got = (f"{a[0]},{b[0]}", a[1] + b[1], a[2] + b[2])
            else:
                ids = model.word_ids(word if word[:1] == MARK else MARK + word)
                got = (",".join(map(str, ids)), len(ids), model.joined(ids))
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = got
        return got


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One for each Python worker and file."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, encoded and decoded."""

    def run(batches):
        own = model(path)
        for batch in batches:
            for rows, texts in text_rows(batch, "text"):
                n, ids, decoded = zip(*[own.digest(t or "") for t in texts], strict=True)
                yield pa.RecordBatch.from_arrays([rows.column("doc"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], [doc_id, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(run, f"{doc_id} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of each document."""

    def run(batches):
        own = model(path)
        for batch in batches:
            for rows, texts in text_rows(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column("doc"), pa.array([own.encode(t or "") for t in texts], pa.list_(pa.int32()))], [doc_id, "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(run, f"{doc_id} long, ids array<int>")


def decoded(encoded_docs: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids."""

    def run(batches):
        own = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], [doc_id, "text"])

    return encoded_docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(ids).alias("ids")).mapInArrow(run, f"{doc_id} long, text string")
