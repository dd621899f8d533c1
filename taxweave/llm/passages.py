"""Removing passages that recur: 35 words in a row that also start anywhere else.

Documents are dealt into blocks of a few megabytes by the hash of id and text, so
rows without id, or many of one id, are spread.
1. Each window of WIDTH words is known by its anchor, the least hash of the runs of ANCHOR words in
   it. Equal windows have equal anchors, so a window whose anchor was picked at one place only can't recur.
2. Windows with recurring anchors are counted over all blocks by their whole hash: these are confirmed.
3. In each block the confirmed windows join into passages. The block's distinct passages are compiled
   into Aho-Corasick automata (shards of SHARD_CHARS), and the block's documents that hold a confirmed window
   are streamed through all of them; each occurrence found marks its words.
A passage that half of all documents share is one row for each block in the counts, and no document
meets another one.

Null and empty texts have no words and keep the empty text. Repeated rows are different places, so
they remove each other's words; of equal passages none is kept as the first (a tie). Texts of any length are read whole, as
part of one block. An empty table gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxweave.llm import grams
from taxweave.llm.common import pieces

WIDTH, ANCHOR = 35, 8
BLOCK_BYTES = 4 << 20
SHARD_CHARS = 1 << 20
KEPT = "doc_id long, n_words long, n_removed long, kept string, passages array<struct<first:long,words:long>>"


def _anchors(words: grams.Words, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word where a window begins, its anchor's hash), (word where a picked run begins, its hash)."""
    at, runs = grams.windows(words.doc, words.hash, anchor)
    inside = width - anchor + 1  # runs in a window
    if len(runs) < inside:
        none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return *none, *none
    least = grams.sliding_min(runs, inside)
    whole = at[inside - 1 :] - at[: len(least)] == inside - 1  # a gap in the places is the end of a document
    edge = np.zeros(inside - 1, np.uint64)
    # A run is picked if it is the least of some window that holds it.
    most = ~grams.sliding_min(~np.concatenate([edge, np.where(whole, least, np.uint64(0)), edge]), inside)
    picked = most == runs
    return at[: len(least)][whole], least[whole], at[picked], runs[picked]


def _counted(block: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (block, hash) and how often each occurs."""
    order = np.lexsort((hashes, block))
    block, hashes = block[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (hashes[1:] != hashes[:-1])])) if len(block) else order
    return block[new], hashes[new], np.diff(np.append(new, len(block)))


def _rows(block: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(block, pa.int64()), pa.array(hashes.view(np.int64)), pa.array(n, pa.int64())], ["block", "hash", "n"])


def _recurring(counted: DataFrame) -> DataFrame:
    """(block, hash) of what occurs at two places or more in all blocks together."""
    everywhere = F.sum("n").over(Window.partitionBy("hash"))
    return counted.withColumn("everywhere", everywhere).filter("everywhere > 1").select("block", "hash")


def _is_in(values: np.ndarray, table: pa.Table) -> np.ndarray:
    known = np.sort(table.column("hash").to_numpy().view(np.uint64))
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _mark(texts: dict[int, list[str]], runs: list[tuple[int, int, int]]) -> dict[int, np.ndarray]:
    """For each document of texts (its words) which words lie in an occurrence of any of the passages."""
    import ahocorasick

    passages = sorted({" " + " ".join(texts[doc][first:last]) + " ": last - first for doc, first, last in runs}.items())
    streams = {doc: " " + " ".join(ws) + " " for doc, ws in texts.items()}
    ends = {doc: np.cumsum([len(w) + 1 for w in ws]) for doc, ws in texts.items()}
    steps = {doc: np.zeros(len(ws) + 1, np.int64) for doc, ws in texts.items()}
    at = 0
    while at < len(passages):
        automaton, chars = ahocorasick.Automaton(), 0
        while at < len(passages) and (not chars or chars + len(passages[at][0]) <= SHARD_CHARS):
            automaton.add_word(*passages[at])
            chars += len(passages[at][0])
            at += 1
        automaton.make_automaton()
        for doc, stream in streams.items():
            found = list(automaton.iter(stream))
            if found:
                last, n = np.array(found, np.int64).T
                last = np.searchsorted(ends[doc], last) + 1
                np.add.at(steps[doc], last - n, 1)
                np.add.at(steps[doc], last, -1)
    return {doc: np.cumsum(s)[:-1] > 0 for doc, s in steps.items()}


def remove_recurring(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, the kept words joined by one space, and the removed runs of words."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")
    )

    def anchors(batches):
        for batch in batches:
            for some in pieces(batch, "text"):
                words = grams.hashed_words(*grams.buffer(some.column("text")))
                _, _, at, hashes = _anchors(words, width, anchor)
                yield _rows(*_counted(some.column("block").to_numpy()[words.doc[at]], hashes))

    def confirmed(key, documents, hashes):
        words = grams.hashed_words(*grams.buffer(documents.column("text").combine_chunks()))
        at, least, _, _ = _anchors(words, width, anchor)
        places, whole = grams.windows(words.doc, words.hash, width)  # in the same order as the anchors
        assert len(places) == len(at)
        chosen = whole[_is_in(least, hashes)]
        return pa.Table.from_batches([_rows(*_counted(np.full(len(chosen), key[0].as_py()), chosen))])

    def kept(key, documents, hashes):
        column = documents.column("text").combine_chunks()
        words = grams.hashed_words(*grams.buffer(column))
        at, whole = grams.windows(words.doc, words.hash, width)
        at = at[_is_in(whole, hashes)]
        firsts = np.searchsorted(words.doc, np.arange(len(column) + 1))
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(words.doc[at]) != 0)]) if len(at) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        finish = np.append(begin[1:], len(at)) - 1
        runs = [(int(words.doc[at[b]]), int(at[b] - firsts[words.doc[at[b]]]), int(at[e] - firsts[words.doc[at[b]]]) + width) for b, e in zip(begin, finish)]
        split = [(t.as_py() or "").encode().split() for t in column]
        marked = _mark({doc: [w.decode() for w in split[doc]] for doc in sorted({r[0] for r in runs})}, runs) if runs else {}
        out = []
        for doc, ws in enumerate(split):
            gone = marked.get(doc)
            if gone is None:
                out.append((len(ws), 0, b" ".join(ws).decode(), []))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
            rest = b" ".join(w for w, g in zip(ws, gone) if not g).decode()
            out.append((len(ws), int(gone.sum()), rest, [{"first": int(a), "words": int(b - a)} for a, b in edges]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))]
        columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, kinds)]
        ids = documents.column("doc_id").combine_chunks()
        return pa.table([ids, *columns], ["doc_id", "n_words", "n_removed", "kept", "passages"])

    by_block = base.groupBy("block")
    counts = "block long, hash long, n long"
    picked = _recurring(base.mapInArrow(anchors, counts))
    windows = _recurring(by_block.cogroup(picked.groupBy("block")).applyInArrow(confirmed, counts))
    return by_block.cogroup(windows.groupBy("block")).applyInArrow(kept, KEPT)
