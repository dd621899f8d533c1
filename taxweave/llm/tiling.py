"""Benchmark decontamination by greedy string tiling.

A text and a benchmark item are sequences of lower-case words without ASCII marks. Runs of MIN_MATCH
words that both hold are seeds; seeds that follow each other make a match. The longest match is
marked first, what is left of the others goes on without the words that are marked, until no match
of MIN_MATCH words remains. The share of the item's words that are marked is its coverage, so a
passage is caught when its sentences come in another order or with text between them.

Null and empty texts match nothing, and neither do items of less than MIN_MATCH words. Every row is
treated for itself, so repeated rows repeat their result. Texts of any length are read whole; empty tables on either side give no match. Of matches of the same length the one
earlier in the item, then earlier in the text, is marked first.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxweave.llm import grams
from taxweave.llm.common import begin, pieces

MIN_MATCH = 5
COVERAGE = 0.5
#: Texts of items that are sent to the tasks at once; a larger benchmark is taken in several passes.
ITEM_CHARS = 16 << 20
#: Pairs of places that are looked at together.
MOST_SEEDS = 1 << 20
MATCHES = "array<struct<item_id:long,item_words:int,marked:int,tiles:int,longest:int,coverage:double>>"


def _runs(in_text: np.ndarray, in_item: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """(words, place in the item, place in the text) of seeds that follow each other, from the runs of words of both."""
    order = np.argsort(in_item, kind="stable")
    low = np.searchsorted(in_item[order], in_text, "left")
    many = np.searchsorted(in_item[order], in_text, "right") - low
    if many.sum() > MOST_SEEDS:  # a phrase that both repeat: not all pairs of places, but one shift after the other
        for shift in range(1 - len(in_item), len(in_text)):
            start, stop = max(0, shift), min(len(in_text), len(in_item) + shift)
            same = in_text[start:stop] == in_item[start - shift : stop - shift]
            if same.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))).reshape(-1, 2)
                yield from ((int(y - x) + width - 1, int(start - shift + x), int(start + x)) for x, y in edges)
        return
    t = np.repeat(np.arange(len(in_text)), many)
    i = order[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
    if not len(t):
        return
    by = np.lexsort((i, i - t))
    t, i = t[by], i[by]
    first = np.concatenate([[0], np.flatnonzero((np.diff(i - t) != 0) | (np.diff(i) != 1)) + 1])
    sizes = np.diff(np.append(first, len(t)))
    yield from ((int(n) + width - 1, int(i[k]), int(t[k])) for k, n in zip(first, sizes))


def tile(text: np.ndarray, item: np.ndarray, width: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (place in the item, place in the text, words), the longest first."""
    zeros = np.zeros(len(text), np.int64), np.zeros(len(item), np.int64)
    _, in_text = grams.windows(zeros[0], text, width)
    _, in_item = grams.windows(zeros[1], item, width)
    heap = [(-n, at_item, at_text) for n, at_item, at_text in _runs(in_text, in_item, width)]
    heapq.heapify(heap)
    free_text, free_item = np.ones(len(text), bool), np.ones(len(item), bool)
    tiles = []
    while heap:
        length, at_item, at_text = heapq.heappop(heap)
        length = -length
        free = free_item[at_item : at_item + length] & free_text[at_text : at_text + length]
        if free.all():
            free_item[at_item : at_item + length] = free_text[at_text : at_text + length] = False
            tiles.append((at_item, at_text, length))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for begin, end in edges.reshape(-1, 2):
            if end - begin >= width:
                heapq.heappush(heap, (int(begin - end), at_item + int(begin), at_text + int(begin)))
    return tiles


class Items:
    """The seeds of some benchmark items."""

    def __init__(self, rows: list[tuple[int, str]], width: int):
        self.ids = [r[0] for r in rows]
        data, offsets = grams.buffer(pa.array([r[1] or "" for r in rows], pa.string()))
        self.words = grams.hashed_words(data, offsets, grams.BARE)
        places, seeds = grams.windows(self.words.doc, self.words.hash, width)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.places = seeds[order], places[order]
        self.bounds = np.searchsorted(self.words.doc, np.arange(len(rows) + 1))
        self.bits = np.zeros(1 << 22, bool)  # most runs of words are in no item, which one look shows
        self.bits[self.seeds & np.uint64(len(self.bits) - 1)] = True

    def hashes(self, item: int) -> np.ndarray:
        return self.words.hash[self.bounds[item] : self.bounds[item + 1]]


def _matches(column: pa.Array, items: Items, width: int, coverage: float) -> list[list[dict]]:
    words = grams.hashed_words(*grams.buffer(column), grams.BARE)
    at, seeds = grams.windows(words.doc, words.hash, width)
    hit = np.flatnonzero(items.bits[seeds & np.uint64(len(items.bits) - 1)])
    low, high = (np.searchsorted(items.seeds, seeds[hit], side) for side in ("left", "right"))
    places: dict[tuple[int, int], set[int]] = defaultdict(set)  # words of the item that any match could mark
    for k in np.flatnonzero(high > low):
        doc = int(words.doc[at[hit[k]]])
        for place in items.places[low[k] : high[k]]:
            places[doc, int(items.words.doc[place])].update(range(int(place), int(place) + width))
    found: list[list[dict]] = [[] for _ in range(len(column))]
    bounds = np.searchsorted(words.doc, np.arange(len(column) + 1))
    for (doc, item), marked in sorted(places.items()):
        wanted = items.hashes(item)
        if len(marked) < coverage * len(wanted):
            continue
        tiles = tile(words.hash[bounds[doc] : bounds[doc + 1]], wanted, width)
        covered = sum(n for _, _, n in tiles)
        if covered >= coverage * len(wanted):
            values = [items.ids[item], len(wanted), covered, len(tiles), tiles[0][2], covered / len(wanted)]
            found[doc].append(dict(zip(("item_id", "item_words", "marked", "tiles", "longest", "coverage"), values)))
    return found


def mark(docs: DataFrame, benchmark: DataFrame, column: str, width: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """All rows and columns of docs, and under `column` the items that each text covers."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, math.ceil(chars / ITEM_CHARS))
    kind = T._parse_datatype_string(MATCHES)
    out = docs.select(F.struct("*").alias("row"), "text", F.array().cast(kind).alias("found"))
    for number in range(passes):
        # Chosen by the text's own hash, so a pass holds about ITEM_CHARS of any benchmark.
        rows = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def marked(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            begin("tiling")
            items = Items(shared.value, width)
            for batch in batches:
                for some in pieces(batch, "text"):
                    new = _matches(some.column("text"), items, width, coverage)
                    old = some.column("found").to_pylist()
                    found = pa.array([a + b for a, b in zip(old, new)], batch.schema.field("found").type)
                    yield pa.record_batch([some.column("row"), some.column("text"), found], ["row", "text", "found"])

        out = out.mapInArrow(marked, out.schema)
    return out.select("row.*", F.col("found").alias(column))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and item it covers."""
    marked = mark(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, "found", width, coverage)
    return marked.select("doc_id", F.inline("found"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that cover no item, with the columns of docs."""
    column = "found"
    while column in docs.columns:
        column += "_"
    return mark(docs, benchmark, column, width, coverage).filter(F.size(column) == 0).drop(column)
