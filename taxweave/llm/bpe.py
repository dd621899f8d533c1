"""Byte-level BPE encoding over tries of words, and decoding.

A text is cut into special tokens and words as the tokenizer cuts it; merges never cross a word's ends. The distinct words
of a part of a batch go into a trie of bytes, which is walked depth first. The state of a node is the last token of the
encoding of the bytes from the root to it. It is the only token t that those bytes end with, for which t stays apart
from the state of the node len(t) bytes above: the tokens before t are the encoding of the bytes before it. So a prefix that many
words share is encoded once, and a word's ids are read from its node upwards.

Two tokens stay apart if no merge of a piece at the end of the first with a piece at the start of the second comes
before the merges that take up these pieces (`Merges.apart`); of equal merges the one further left comes first.
Tokens that the merges don't make of their own bytes (`Merges.made`) are never a state.

Each task keeps the ids of the last MEMO_WORDS words, and of those before them. Words of more than LONG_WORD bytes aren't put into the trie: their
states are computed along the word. Null and empty texts have no ids; decoding no ids gives ''. Texts of any length are encoded whole. Repeated
rows are encoded each for itself, as are ties; an empty table gives no rows. Other columns are kept in the struct `row`, so
no name clashes. Decoding replaces what is no UTF-8 by U+FFFD and leaves out ids that the vocabulary doesn't have.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxweave.llm.common import begin, pieces
from taxweave.llm.tokens import _byte_letters

MEMO_WORDS, MEMO_PAIRS = 250_000, 500_000
LONG_WORD = 4096
#: The words of byte-level tokenizers: fixed by them.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Here the classes of that pattern are the same in all versions of Unicode; texts with other characters are cut by the library.
STABLE = regex.compile("[\u0000-ԯ -⁯ぁ-ゖ一-龥가-힣]*+")


class Merges:
    """A byte-level vocabulary and its merges, read from the tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        byte = {letter: b for b, letter in _byte_letters().items()}
        vocabulary = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(byte[c] for c in token) for token, i in vocabulary.items() if token not in self.special}
        self.bytes |= {i: token.encode() for token, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (vocabulary[a], vocabulary[b]), vocabulary[a + b]
            if whole in self.parts:
                raise ValueError(f"two merges make token {whole}")
            self.rank[pair], self.parts[whole] = rank, pair
        self._spines: tuple[dict[int, list], dict[int, list]] = {}, {}
        self._apart: dict[tuple[int, int], bool] = {}
        plain = {i: b for i, b in self.bytes.items() if i not in self.special.values()}
        self.made = {i for i, b in plain.items() if len(b) == 1}
        for whole, (a, b) in self.parts.items():  # parts come before what is made of them
            if a in self.made and b in self.made and self._reaches(a, b):
                self.made.add(whole)
        self.token = {plain[i]: i for i in self.made}
        #: The length of the longest token that ends with these three bytes.
        self.longest: dict[bytes, int] = {}
        for token in self.token:
            if len(token) > 2 and len(token) > self.longest.get(token[-3:], 2):
                self.longest[token[-3:]] = len(token)

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces at one end of a token, the smallest first, each with the rank of the merge that takes it up."""
        found = self._spines[side].get(token)
        if found is None:
            found = [(token, math.inf)]
            while (parts := self.parts.get(found[0][0])) is not None:
                found.insert(0, (parts[1 - side], self.rank[parts]))
            self._spines[side][token] = found
        return found

    def _reaches(self, left: int, right: int) -> bool:
        """Whether both tokens come about side by side, whatever happens to them then."""
        ends, starts = self._spine(left, 0), self._spine(right, 1)
        i = k = 0
        while True:
            (a, until_a), (b, until_b) = ends[i], starts[k]
            if until_a == until_b == math.inf:
                return True
            rank = self.rank.get((a, b), math.inf)
            if rank < until_a and rank <= until_b:
                return False
            if until_a <= until_b:
                i += 1
            else:
                k += 1

    def apart(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two tokens."""
        found = self._apart.get((left, right))
        if found is None:
            if len(self._apart) > MEMO_PAIRS:
                self._apart.clear()
            found = self._apart[left, right] = (left, right) not in self.rank and self._reaches(left, right)
        return found

    def state(self, path: bytearray, states: list[int], depth: int) -> int:
        """The last token of the first `depth` bytes of path, given the states of all shorter prefixes."""
        n = min(depth, self.longest.get(bytes(path[max(0, depth - 3) : depth]), 2))
        end, tokens, apart = bytes(path[depth - n : depth]), self.token, self._apart
        for start in range(n):
            token = tokens.get(end[start:])
            if token is not None:
                before = states[depth - n + start]
                if before < 0 or (apart[before, token] if (before, token) in apart else self.apart(before, token)):
                    return token
        raise AssertionError("every byte is a token")

    def ids(self, states: list[int], depth: int) -> bytes:
        """The ids of the first `depth` bytes, from their states."""
        out = []
        while depth:
            out.append(states[depth])
            depth -= len(self.bytes[states[depth]])
        return np.array(out[::-1], "<u4").tobytes()


class Trie:
    """Words as paths of bytes. Node 0 is the root; children of a node are linked through `across`."""

    def __init__(self) -> None:
        self.step: dict[int, int] = {}
        self.byte, self.down, self.across = [0], [0], [0]
        self.ends: dict[int, bytes] = {}

    def insert(self, word: bytes) -> None:
        node, step = 0, self.step
        for b in word:
            key = node << 8 | b
            after = step.get(key)
            if after is None:
                after = step[key] = len(self.byte)
                self.byte.append(b)
                self.down.append(0)
                self.across.append(self.down[node])
                self.down[node] = after
            node = after
        self.ends[node] = word

    def encode(self, merges: Merges) -> dict[bytes, bytes]:
        """The ids of all words, each node being looked at once."""
        found, path, states = {}, bytearray(), [-1]
        left = [(0, 0)]
        while left:
            node, depth = left.pop()
            if node:
                del path[depth - 1 :], states[depth:]
                path.append(self.byte[node])
                states.append(merges.state(path, states, depth))
            if node in self.ends:
                found[self.ends[node]] = merges.ids(states, depth)
            child = self.down[node]
            while child:
                left.append((child, depth + 1))
                child = self.across[child]
        return found


def along(word: bytes, merges: Merges) -> bytes:
    """The ids of one word, by states along it."""
    path, states = bytearray(word), [-1]
    for depth in range(1, len(word) + 1):
        states.append(merges.state(path, states, depth))
    return merges.ids(states, len(word))


class Encoder:
    """Ids of texts by one tokenizer; one for each Python worker."""

    def __init__(self, path: str, special_is_text: bool = False):
        self.path, self.merges, self.library = path, Merges(path), None
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.special_ids = {t: np.array([i], "<u4").tobytes() for t, i in self.merges.special.items()}
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special and not special_is_text else None

    def words(self, text: str) -> list[str]:
        if STABLE.fullmatch(text):
            return WORDS.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self._split(t) for t in texts]
        if len(self.known) > MEMO_WORDS:
            self.before, self.known = self.known, {}
        if self.special:
            self.known.update(self.special_ids)
        known, before, trie = self.known, self.before, Trie()
        for word in set().union(*split).difference(known):
            ids = before.get(word)
            if ids is not None:
                known[word] = ids
                continue
            data = word.encode()
            if len(data) > LONG_WORD:
                known[word] = along(data, self.merges)
            else:
                trie.insert(data)
        for data, ids in trie.encode(self.merges).items():
            known[data.decode()] = ids
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def _split(self, text: str) -> list[str]:
        """The words and special tokens of a text."""
        if not self.special or not self.special.search(text):
            return self.words(text)
        ids = self.special_ids
        return [w for x in self.special.split(text) if x for w in ([x] if x in ids else self.words(x))]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_is_text: bool = False) -> Encoder:
    begin("bpe", _encoders.clear)
    if (path, special_is_text) not in _encoders:
        _encoders[path, special_is_text] = Encoder(path, special_is_text)
    return _encoders[path, special_is_text]


def decode_ids(ids: np.ndarray, merges: Merges) -> str:
    known = merges.bytes
    return b"".join([known[i] for i in ids.tolist() if i in known]).decode("utf-8", "replace")


def _encoding(batches: Iterator[pa.RecordBatch], path: str, special_is_text: bool) -> Iterator[pa.RecordBatch]:
    known = encoder(path, special_is_text)
    for batch in batches:
        for some in pieces(batch, "text"):
            found = known.encode([t or "" for t in some.column("text").to_pylist()])
            bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.record_batch([some.column("row"), ids], ["row", "ids"])


def _decoding(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    merges = encoder(path).merges
    for batch in batches:
        ids = batch.column("ids")
        flat, offsets = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.diff(ids.offsets.to_numpy()))])
        texts = [decode_ids(flat[a:b], merges) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.record_batch([batch.column("row"), ids, pa.array(texts, pa.string())], ["row", "ids", "decoded"])


def _rows(docs: DataFrame, columns: list[str] | None) -> T.StructType:
    return docs.select(F.struct(*(columns or ["*"])).alias("row")).schema


def encode(docs: DataFrame, path: str, columns: list[str] | None = None, special_is_text: bool = False) -> DataFrame:
    """`row` (all or the named columns of docs) and `ids` (array<int>) of the column text.

    As the library does with add_special_tokens=False: the strings of special tokens in a text are those
    tokens, or plain text with `special_is_text`.
    """
    schema = T.StructType([*_rows(docs, columns), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    rows = docs.select(F.struct(*(columns or ["*"])).alias("row"), "text")
    return rows.mapInArrow(lambda batches: _encoding(batches, path, special_is_text), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`row`, `ids` and `decoded`, the text of the ids. Null ids are none."""
    schema = T.StructType([*encoded.select("row", "ids").schema, T.StructField("decoded", T.StringType())])
    rows = encoded.select("row", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(lambda batches: _decoding(batches, path), schema)


def round_trip(docs: DataFrame, path: str, columns: list[str] | None = None, special_is_text: bool = False) -> DataFrame:
    """`encode` and `decode` in one pass of one worker."""
    kinds = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    rows = docs.select(F.struct(*(columns or ["*"])).alias("row"), "text")
    return rows.mapInArrow(lambda batches: _decoding(_encoding(batches, path, special_is_text), path), T.StructType([*_rows(docs, columns), *kinds]))
