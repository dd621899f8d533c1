"""Whole texts to token ids by the `tokenizers` library, a word at a time.

Both tokenizers cut a text before they merge, and never across the places used
here, so a text's ids are the ids of its parts one after the other. Parts recur,
so each task keeps the ids of the parts it has met, up to a fixed number.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxweave.llm.common import begin

MEMO_ENTRIES = 700_000
SLICE_CHARS = 1 << 20
#: At the end of a part, and never one token with the letters before them.
MARKS = ".,;:!?%*&$#()"
#: A space with a character other than white space behind it always begins a new part.
_BREAK = re.compile(r" (?=\S)")
_IRREGULAR = re.compile(r" (?!\S)")


def _slices(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > SLICE_CHARS:
        found = _BREAK.search(text, start + SLICE_CHARS)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


_BYTES = _byte_letters()


class _Ids(dict):
    """Ids by part of a text; what isn't there yet is encoded by the library."""

    def __init__(self, tokenizer, lead: str, lower: bool, first: _Ids | None = None):
        super().__init__({} if lead else {"": b""})
        self.tokenizer, self.model, self.lead, self.lower = tokenizer, tokenizer.model, lead, lower
        self.first = first or self

    def __missing__(self, part: str) -> bytes:
        line, _, next_line = part.partition("\n")
        if line and next_line and not line[-1].isspace() and not next_line[0].isspace():
            return self[line] + self.first["\n"] + self.first[next_line]
        word = part.rstrip(MARKS)
        if word != part and word.isalpha():  # letters and marks are different tokens
            found = self[word] + self.first[part[len(word) :]]
        elif part.isalpha() and max(part) <= "\xff":
            found = self._word(part)
        else:
            found = self._library(self.lead + part)
        self[part] = found
        return found

    def _word(self, word: str) -> bytes:
        """One run of letters is one pre-token, so only the merges are left to do."""
        text = word.lower() if self.lower else self.lead + word
        merged = self.model.tokenize(text.encode().decode("latin-1").translate(_BYTES))
        return array("I", [t.id for t in merged]).tobytes()

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._forget()

    def _forget(self) -> None:
        lower = self.tokenizer.normalizer is not None
        self.first = _Ids(self.tokenizer, "", lower)
        self.later = _Ids(self.tokenizer, " ", lower, self.first)

    def encode(self, text: str) -> bytes:
        if len(self.later) > MEMO_ENTRIES or len(self.first) > MEMO_ENTRIES:
            self._forget()
        later = self.later.__getitem__
        return b"".join(self.first[first] + b"".join(map(later, rest)) for first, rest in map(_parts, _slices(text)))


def _parts(text: str) -> tuple[str, list[str]]:
    """The text cut before each single space: the first part, and the others without that space."""
    cut = _BREAK.split(text) if _IRREGULAR.search(text) else text.split(" ")
    return cut[0], cut[1:]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    begin("tokens", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.Scalar, bytes]]:
    """(doc_id, ids with the end id) for each row of batches of (doc_id, text)."""
    end = end_id.to_bytes(4, "little")
    known = encoder(path)
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            yield doc_id, known.encode(text.as_py() or "") + end


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
