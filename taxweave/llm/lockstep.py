"""Alignment of two tokenizers: which tokens overlap, and where tokens of both end together.

Texts are encoded by a byte-level tokenizer (A, of space + text) and a sentencepiece model (B, of text, which it puts a space before).
Both token sequences spell the same bytes, so tokens are ranges of bytes. All documents of a part of a batch are walked at the
same time: a state vector holds, for each walk, the place of its current A and B token. A step
links the two current tokens, cuts where both end, and moves on the one that ends first, or both; walks that are over leave
the vector, which is compacted. Documents of many tokens are begun at several places at once, each behind a byte
where tokens of both end (`lanes`), so that a very long text doesn't walk alone for long.

What is counted corpus-wide is the number of documents that hold a pair of ids linked (`with_support`). The distinct
pairs of each document are written once; counts and the highest count of each A id come from them in one
aggregate, and go back to the documents in a join on the pair, which Spark may split for pairs that nearly all documents
hold. Up to BROADCAST_PAIRS pairs are sent to the tasks instead.

Null and empty texts, and texts whose A or B tokens spell other bytes than space + text, have no tokens: zeros, and '' for groups.
Texts of any length are aligned whole. Repeated rows are documents of their own; ties share the highest count. An empty
table gives no rows. Other columns are kept in the struct `row`, so no name clashes.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxweave.llm.bpe import Merges
from taxweave.llm.common import begin, pieces, settle

#: Parts whose ids a task keeps, twice: those of late, and of those before them.
MEMO_PARTS = 200_000
#: Characters of new parts that are encoded as one text.
TOGETHER = 1 << 16
#: About so many A tokens of a document are walked one after the other.
LANE_TOKENS = 1024
BROADCAST_PAIRS = 1_000_000
#: Before a single space between other characters: no token of either tokenizer goes over it.
_PART = re.compile(r"(?<=\S)(?= \S)")


class Sides:
    """Both tokenizers of a Python worker, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        known = Merges(a_path).bytes
        self.a_bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._spelt(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.parts: dict[str, tuple[bytes, bytes] | None] = {}
        self.before: dict[str, tuple[bytes, bytes] | None] = {}
        names = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        # How an id is written: A inside and at the end of a group, then B.
        self.written = [name + mark for mark, n in zip((b",", b"|", b",", b";"), (len(self.a_bytes),) * 2 + (len(self.b_bytes),) * 2) for name in names[:n]]
        self.b_offset = 2 * len(self.a_bytes)

    def _spelt(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def _part(self, part: str) -> tuple[bytes, bytes] | None:
        """A and B ids of a part that begins with a space, None if they spell something else."""
        a, spelt = self.a.encode(part, add_special_tokens=False).ids, part.encode()
        b = self.b.encode(part[1:], num_threads=1) if part != " " else [self.b.piece_to_id("▁")]
        right = b"".join([self.b_bytes[i] for i in b]) == spelt == b"".join([self.a_bytes[i] for i in a])
        return (array("I", a).tobytes(), array("I", b).tobytes()) if right else None

    def _at_once(self, parts: list[str]) -> None:
        """The ids of many parts, encoded as one text and cut at the parts' ends."""
        whole = "".join(parts)
        ids = self.a.encode(whole, add_special_tokens=False).ids, self.b.encode(whole[1:], num_threads=1)
        ends = np.cumsum([len(p.encode()) for p in parts])
        cut = []
        for side, spelt, size in zip(ids, (self.a_bytes, self.b_bytes), (self.a_size, self.b_size)):
            side = np.array(side, "<u4")
            after = np.cumsum(size[side])
            at = np.searchsorted(after, ends)
            if b"".join([spelt[i] for i in side.tolist()]) != whole.encode() or not np.array_equal(after[np.minimum(at, len(after) - 1)], ends):
                self.parts.update((p, self._part(p)) for p in parts)
                return
            data, bounds = side.tobytes(), [0, *(4 * (at + 1)).tolist()]
            cut.append([data[x:y] for x, y in zip(bounds[:-1], bounds[1:])])
        self.parts.update(zip(parts, zip(*cut)))

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """A and B ids of space + text, None for no text and if their bytes differ from it."""
        split = [_PART.split(f" {t}") if t else [] for t in texts]
        if len(self.parts) > MEMO_PARTS:
            self.before, self.parts = self.parts, {}
        known, some, held = self.parts, [], 0
        for part in set().union(*split).difference(known):
            if part in self.before:
                known[part] = self.before[part]
            elif len(part) > 1 and not part[1].isspace() and not part[-1].isspace():
                some.append(part)
                held += len(part)
                if held > TOGETHER:
                    self._at_once(some)
                    some, held = [], 0
            else:
                known[part] = self._part(part)
        if some:
            self._at_once(some)
        out = []
        for parts in split:
            found = list(map(known.__getitem__, parts))
            out.append(None if not found or None in found else tuple(np.frombuffer(b"".join([f[side] for f in found]), "<u4") for side in (0, 1)))
        return out


_sides: dict[tuple[str, str], Sides] = {}


def sides(a_path: str, b_path: str) -> Sides:
    begin("lockstep", _sides.clear)
    if (a_path, b_path) not in _sides:
        _sides[a_path, b_path] = Sides(a_path, b_path)
    return _sides[a_path, b_path]


def lanes(a_end: np.ndarray, b_end: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray, every: int) -> tuple[np.ndarray, ...]:
    """Where walks begin and end in the A and B tokens: (a from, a to, b from, b to).

    Ends are bytes counted over all documents, so each is in one document. A document's walks
    begin with it and behind the first shared end that follows each `every` A tokens.
    """
    starts_a, starts_b = [a_bounds[:-1]], [b_bounds[:-1]]
    for d in np.flatnonzero(np.diff(a_bounds) > every):
        at = int(a_bounds[d]) + every
        while at < a_bounds[d + 1]:
            ahead = a_end[at : min(at + every, int(a_bounds[d + 1]) - 1)]
            place = np.searchsorted(b_end, ahead)
            shared = np.flatnonzero(b_end[np.minimum(place, len(b_end) - 1)] == ahead)
            if len(shared):
                starts_a.append([at + int(shared[0]) + 1])
                starts_b.append([int(place[shared[0]]) + 1])
                at += int(shared[0]) + 1
            at += every
    starts_a, starts_b = np.sort(np.concatenate(starts_a)), np.sort(np.concatenate(starts_b))
    return starts_a, np.append(starts_a[1:], a_bounds[-1]), starts_b, np.append(starts_b[1:], b_bounds[-1])


def walk(a_end: np.ndarray, b_end: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray) -> tuple[np.ndarray, ...]:
    """(A place, B place) of all links, and the links that are cuts, of all walks in lockstep."""
    alive = np.flatnonzero(a_from < a_to)
    a, b, last = a_from[alive], b_from[alive], a_to[alive]
    at_a, at_b, cut = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    while len(a):
        end_a, end_b = a_end[a], b_end[b]
        at_a.append(a)
        at_b.append(b)
        cut.append(end_a == end_b)
        a = a + (end_a <= end_b)
        b = b + (end_b <= end_a)
        left = a < last
        if not left.all():
            a, b, last = a[left], b[left], last[left]
    return np.concatenate(at_a), np.concatenate(at_b), np.concatenate(cut)


def _groups(known: Sides, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
    """The groups of each document as `a1,a2|b1;a3|b2,b3`."""
    ends_a, ends_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    ends_a[cut_a], ends_b[cut_b] = True, True
    group_a, group_b = (np.cumsum(e) - e for e in (ends_a, ends_b))  # groups before the token's own
    through_a, through_b = np.append(0, np.flatnonzero(ends_a) + 1), np.append(0, np.flatnonzero(ends_b) + 1)
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + through_b[group_a]] = a + np.where(ends_a, len(known.a_bytes), 0)
    order[np.arange(len(b)) + through_a[group_b + 1]] = known.b_offset + b + np.where(ends_b, len(known.b_bytes), 0)
    written = known.written
    codes = order.tolist()
    bounds = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    return [b"".join([written[c] for c in codes[x:y]])[:-1].decode() for x, y in zip(bounds[:-1], bounds[1:])]


def align_texts(texts: list[str | None], known: Sides, every: int = LANE_TOKENS) -> dict[str, list | np.ndarray]:
    """For each text: n_a, n_b, n_groups, n_links, groups; its links (places of A and B tokens) and its distinct pairs with their number."""
    encoded = known.encode(texts)
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate([none, *[e[side] for e in encoded if e]]).astype(np.int64) for side in (0, 1))
    n_a, n_b = (np.array([len(e[side]) if e else 0 for e in encoded], np.int64) for side in (0, 1))
    a_end, b_end = np.cumsum(known.a_size[a]), np.cumsum(known.b_size[b])
    a_bounds, b_bounds = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
    a_from, a_to, b_from, _ = lanes(a_end, b_end, a_bounds, b_bounds, every)
    at_a, at_b, cut = walk(a_end, b_end, a_from, a_to, b_from)
    doc = np.searchsorted(a_bounds, at_a, "right") - 1
    order = np.argsort(at_a + at_b, kind="stable")  # both only rise along a walk, and walks follow each other
    at_a, at_b, cut, doc = at_a[order], at_b[order], cut[order], doc[order]
    n_links, n_groups = (np.bincount(d, minlength=len(texts)) for d in (doc, doc[cut]))
    pair = (a[at_a] << 32) | b[at_b]
    by = np.lexsort((pair, doc))
    pair, owner = pair[by], doc[by]
    new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])])) if len(pair) else none
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
        "groups": _groups(known, a, b, at_a[cut], at_b[cut], n_a, n_b),
        "link_a": at_a - a_bounds[doc], "link_b": at_b - b_bounds[doc],
        "pairs": pair[new], "many": np.diff(np.append(new, len(pair))),
        "n_pairs": np.bincount(owner[new], minlength=len(texts)),
    }


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
PAIR = "array<struct<a:int,b:int,many:int>>"
LINK = "array<struct<a:int,b:int>>"


def _list_of(values: list[np.ndarray], names: list[str], lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in values], names))


def align(docs: DataFrame, a_path: str, b_path: str, columns: list[str] | None = None, links: bool = True) -> DataFrame:
    """`row` (all or the named columns of docs), n_a, n_b, n_groups, n_links, groups (text), the distinct `pairs` (a, b, many: its
    links), and, unless `links` is off, all `links` as places of their A and B tokens in the document."""
    rows = docs.select(F.struct(*(columns or ["*"])).alias("row"), "text")
    parsed = lambda kind: T._parse_datatype_string(kind)
    fields = [*rows.select("row").schema, *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("groups", T.StringType()), T.StructField("pairs", parsed(PAIR))]
    schema = T.StructType([*fields, *([T.StructField("links", parsed(LINK))] if links else [])])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sides(a_path, b_path)
        for batch in batches:
            for some in pieces(batch, "text"):
                found = align_texts(some.column("text").to_pylist(), known)
                codes = found["pairs"]
                out = [some.column("row"), *[pa.array(found[c], pa.int64()) for c in COUNTS], pa.array(found["groups"], pa.string())]
                out.append(_list_of([codes >> 32, codes & 0xFFFFFFFF, found["many"]], ["a", "b", "many"], found["n_pairs"]))
                if links:
                    out.append(_list_of([found["link_a"], found["link_b"]], ["a", "b"], found["n_links"]))
                yield pa.record_batch(out, schema.names)

    return rows.mapInArrow(aligned, schema)


def with_support(aligned: DataFrame) -> DataFrame:
    """The columns of `aligned` but pairs, and n_best, count_sum.

    A pair's count is the number of rows that hold it. count_sum adds the counts of all links of a row; n_best is
    the number of its links whose count is the highest of all pairs with the same A id.
    """
    rows = settle(aligned.withColumn("number", F.monotonically_increasing_id()), "aligned")
    each = rows.select("number", F.explode("pairs").alias("pair")).select("number", "pair.a", "pair.b", "pair.many")
    counts = settle(each.groupBy("a", "b").agg(F.count("*").alias("count")), "pairs")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))  # a row for each token of A
    counts = settle(counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")
    sent = F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts
    sums = each.join(sent, ["a", "b"]).groupBy("number").agg(
        F.sum(F.when(F.col("best"), F.col("many")).otherwise(0)).alias("n_best"), F.sum(F.col("many") * F.col("count")).alias("count_sum")
    )
    kept = [c for c in aligned.columns if c != "pairs"]
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("number", *kept).join(sums, "number", "left").select(*kept, zero("n_best"), zero("count_sum"))
