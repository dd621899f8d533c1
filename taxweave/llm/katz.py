"""Katz backoff language model: trained on some documents of a table, and scoring all of them.

P(w | h) = d * c(h, w) / c(h) for n-grams seen in training, else a(h) * P(w | h without its first word).
d is the Good-Turing discount for counts up to K, and for larger counts the amount taken from K. Where one of an order's
discounts is outside (0, 1), as groups of copies make n_r uneven, all of them are taken from counts of counts smoothed by
n_r = A * r^b, fitted over r up to FIT (simple Good-Turing). Only an order with fewer than LEAST_SEEN n-grams of one
of the counts up to K + 1, or with b >= -1, is too small for either and takes off 0.5 from each count. a(h) is what
the discounts leave divided by 1 - sum of P(w | shorter h) over the words seen behind h, so all words
sum to one. Single words back off to one unknown word, which gets what their discounts leave.

N-grams are 64-bit hashes of lower-case words. Documents are dealt into blocks by the hash of id and text, so rows without id, or many of one id, are spread.
1. Each block counts its distinct n-grams; they are dealt into buckets by hash, sorted and packed.
2. Each bucket adds up the blocks' counts, answers each block with the totals in the order of its n-grams, and
   names one block as owner of each n-gram. Answers are a table partitioned by order.
3. Each block reads its documents along the answers. It adds up the tokens' log probabilities, level by level, and
   leaves open which backoff weights they take; for the n-grams it owns it adds to what histories need for their weights.
4. Histories' sums make the table of backoff weights, partitioned by order; open weights are joined with it.
A frequent n-gram is one entry of a block, whatever it occurs, and no task holds more than a bucket or a block.

Null and empty texts are the end token alone. Rows without doc_id train by the hash of the empty text. Repeated rows are
documents each for itself. Without training tokens all probability is the unknown word's. Texts of any length are scored whole, as part of
one block. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxweave.llm import grams
from taxweave.llm.common import settle

ORDER = 2  # with 3 the check tool stops at its limit of disk, see README
K = 5  # counts up to K get Good-Turing discounts
FIT = 40  # counts of counts that smoothing looks at
LEAST_SEEN = 100  # n-grams of a count, for smoothing: an error of 10 % in n_r
BLOCK_BYTES = 8 << 20
START, END = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
COUNTS = "order int, bucket int, block long, payload binary"
ANSWERS = "order int, bucket int, block long, payload binary, types array<long>"
SCORED = "kind string, block long, row long, doc_id long, held_out boolean, order int, hist long, n long, m long, x double, y double"


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte, and counts."""
    steps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.compress(steps + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.decompress(payload), np.uint8)
    n = len(data) // 12
    steps = np.ascontiguousarray(data[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(data[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


class Tokens(NamedTuple):
    """All documents of a block, each behind order - 1 start tokens."""

    doc: np.ndarray  # of each place
    real: np.ndarray  # whether the place is a token
    keys: list[np.ndarray]  # for n = 1, 2, ...: the n-gram that ends at each place


def read(column: pa.Array, order: int) -> Tokens:
    words = grams.hashed_words(*grams.buffer(column), grams.LOWERED)
    lengths = np.bincount(words.doc, minlength=len(column)) + order
    begin = np.concatenate([[0], np.cumsum(lengths)])
    total = int(begin[-1])
    hashes = np.full(total, START)
    doc = np.repeat(np.arange(len(column)), lengths)
    rank = np.arange(len(words.doc)) - np.searchsorted(words.doc, np.arange(len(column)))[words.doc]
    hashes[begin[words.doc] + order - 1 + rank] = words.hash
    hashes[begin[1:] - 1] = END
    real = np.arange(total) - begin[doc] >= order - 1
    keys = [grams.mix(hashes)]
    for n in range(2, order + 1):
        back = np.concatenate([np.full(n - 1, START), hashes[: total - n + 1]]) if total else hashes
        keys.append(grams.mix(keys[-1] ^ grams.mix(back + np.uint64(n))))
    return Tokens(doc, real, keys)


def _discounts(types: list[int]) -> list[float]:
    """d for counts 0 to K, from (types, tokens, types of count 1, ..., FIT)."""
    n = np.array([0, *types[2:]], float)
    r = np.arange(1, K + 1)
    seen = n[1 : K + 2].min()
    if seen > 0:
        common = (K + 1) * n[K + 1] / n[1]
        if common != 1:
            found = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            if ((0 < found) & (found < 1)).all():
                return [0.0, *found.tolist()]
    if seen >= LEAST_SEEN:
        counts = np.flatnonzero(n)
        slope = np.polyfit(np.log(counts), np.log(n[counts]), 1, w=np.sqrt(n[counts]))[0]
        if slope < -1:  # then each r* / r = (1 + 1 / r)^(slope + 1) lies between common and 1
            common = (K + 1.0) ** (slope + 1)
            return [0.0, *(((1 + 1 / r) ** (slope + 1) - common) / (1 - common)).tolist()]
    return [0.0, *(1 - 0.5 / r).tolist()]  # too few n-grams for Good-Turing


class Model(NamedTuple):
    order: int
    documents: int  # in training
    types: int
    tokens: int
    discounts: list[list[float]]  # by order, for counts 0 to K
    unknown: float

    def discounted(self, n: int, counts: np.ndarray) -> np.ndarray:
        """d * c."""
        d = np.array(self.discounts[n - 1])
        return np.where(counts <= K, d[np.minimum(counts, K)] * counts, counts - K * (1 - d[K]))


def _model(answers: DataFrame, order: int, documents: int) -> Model:
    sums = [F.sum(F.get("types", F.lit(k))).alias(f"t{k}") for k in range(FIT + 2)]
    rows = {r.order: list(r)[1:] for r in answers.filter("types is not null").groupBy("order").agg(*sums).collect()}  # a row each order
    types = [[int(x or 0) for x in rows.get(n, [0] * (FIT + 2))] for n in range(1, order + 1)]
    discounts = [_discounts(t) for t in types]
    kinds, tokens, *of = types[0]
    d = discounts[0]
    left = sum((1 - d[r]) * r * of[r - 1] for r in range(1, K + 1)) + K * (1 - d[K]) * (kinds - sum(of[:K]))
    return Model(order, documents, kinds, tokens, discounts, left / tokens if tokens else 1.0)


def _count(order: int, buckets: int):
    def count(key, documents):
        tokens = read(documents.column("text").combine_chunks(), order)
        train = documents.column("train").combine_chunks().to_numpy(zero_copy_only=False)[tokens.doc[tokens.real]]
        rows = []
        for n, keys in enumerate(tokens.keys, 1):
            distinct, at = np.unique(keys[tokens.real], return_inverse=True)
            counts = np.bincount(at, weights=train, minlength=len(distinct)).astype(np.int64)
            edges = np.searchsorted(distinct, _edges(buckets))
            for bucket, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                if b > a:
                    rows.append((n, bucket, key[0].as_py(), pack(distinct[a:b], counts[a:b])))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], ["order", "bucket", "block", "payload"])

    return count


def _edges(buckets: int) -> np.ndarray:
    """Where buckets begin; the last edge lies behind every key but the greatest, which has its bucket too."""
    return np.array([*((b << 64) // buckets for b in range(buckets)), (1 << 64) - 1], np.uint64)


def _answer(key, table):
    """A block's n-grams are answered with 2 * total + 1 for its owner, 2 * total for others."""
    order = np.argsort(table.column("block").to_numpy(), kind="stable")
    payloads = table.column("payload").to_pylist()
    parts = [unpack(payloads[k]) for k in order]
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    distinct, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
    seen = np.flatnonzero(counts > 0)
    _, first = np.unique(at[seen], return_index=True)
    owner = np.zeros(len(keys), np.int64)
    owner[seen[first]] = 1
    answers = np.split(2 * total[at] + owner, np.cumsum([len(k) for k, _ in parts])[:-1])
    blocks = table.column("block").to_numpy()[order].tolist()
    types = [int((total > 0).sum()), int(total.sum()), *np.bincount(np.minimum(total, FIT + 1), minlength=FIT + 2)[1 : FIT + 1].tolist()]
    n, bucket = key[0].as_py(), key[1].as_py()
    size = len(blocks) + 1
    columns = [
        pa.array([n] * size, pa.int32()),
        pa.array([bucket] * size, pa.int32()),
        pa.array([*blocks, None], pa.int64()),
        pa.array([*(zstandard.compress(a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1) for a in answers), None], pa.binary()),
        pa.array([*[None] * len(blocks), types], pa.list_(pa.int64())),
    ]
    return pa.table(columns, ["order", "bucket", "block", "payload", "types"])


def _known(answers, n: int) -> np.ndarray:
    """The answers to a block's distinct n-grams, in their order."""
    rows = sorted((b, p) for o, b, p in zip(*(answers.column(c).to_pylist() for c in ("order", "bucket", "payload"))) if o == n)
    parts = [np.frombuffer(zstandard.decompress(p), np.uint8).reshape(8, -1).T for _, p in rows]
    return np.concatenate([np.ascontiguousarray(p).view("<u8").ravel() for p in parts]).astype(np.int64)


def _rows(kind: str, **columns) -> pa.Table:
    size = len(next(iter(columns.values())))
    given = {"kind": pa.array([kind] * size, pa.string())}
    kinds = {"held_out": pa.bool_(), "order": pa.int32(), "x": pa.float64(), "y": pa.float64()}
    for name in [f.split()[0] for f in SCORED.split(", ")][1:]:
        given[name] = pa.array(columns[name], kinds.get(name, pa.int64())) if name in columns else pa.nulls(size, kinds.get(name, pa.int64()))
    return pa.table(given)


def _score(model: Model):
    def score(key, documents, answers):
        block = key[0].as_py()
        tokens = read(documents.column("text").combine_chunks(), model.order)
        real, size = tokens.real, documents.num_rows
        if not size:
            return _rows("document", row=[])
        out = []
        doc = tokens.doc[real]
        before = None  # counts of the next lower order, at all places
        local = known = base = None
        open_: dict[int, np.ndarray] = {}
        for n, keys in enumerate(tokens.keys, 1):
            _, first, at = np.unique(keys[real], return_index=True, return_inverse=True)
            answer = _known(answers, n)
            total, owned = answer >> 1, (answer & 1).astype(bool)
            counts = total[at]
            everywhere = np.full(len(real), model.documents)  # nothing but start tokens stands before each document
            everywhere[real] = counts
            seen = counts > 0
            kept = model.discounted(n, counts)
            with np.errstate(divide="ignore", invalid="ignore"):
                if n == 1:
                    local = np.log10(np.where(seen, kept / max(1, model.tokens), model.unknown))
                    known, base = seen, np.log10((counts + 1) / (model.tokens + model.types + 1))
                else:
                    history = np.concatenate([[0], before[:-1]])[real]
                    hist = np.concatenate([[0], tokens.keys[n - 2][:-1]]).astype(np.uint64)[real]
                    mine = first[owned]
                    names, group = np.unique(hist[mine], return_inverse=True)
                    sums = [np.bincount(group, weights=w, minlength=len(names)) for w in (kept[mine], 10.0 ** local[mine])]
                    whole = np.zeros(len(names), np.int64)
                    whole[group] = history[mine]
                    out.append(_rows("history", order=np.full(len(names), n, np.int32), hist=names.view(np.int64), n=whole, x=sums[0], y=sums[1]))
                    local = np.where(seen, np.log10(kept / history), local)
                    open_ = {m: (o & ~seen, h) for m, (o, h) in open_.items()} | {n: (~seen & (history > 0), hist)}
            before = everywhere
        for n, (which, hist) in open_.items():
            pairs, times = np.unique(np.stack([doc[which].astype(np.uint64), hist[which]]), axis=1, return_counts=True) if which.any() else (np.zeros((2, 0), np.uint64), [])
            out.append(_rows("open", block=np.full(len(times), block), row=pairs[0].astype(np.int64), order=np.full(len(times), n, np.int32), hist=pairs[1].copy().view(np.int64), n=times))
        sums = [np.bincount(doc, weights=w, minlength=size) for w in (np.ones(len(doc)), known, base, local)]
        ids, train = (documents.column(c).combine_chunks() for c in ("doc_id", "train"))
        held_out = [not t for t in train.to_pylist()]
        out.append(_rows("document", block=np.full(size, block), row=np.arange(size), doc_id=ids, held_out=held_out, n=sums[0].astype(np.int64), m=sums[1].astype(np.int64), x=sums[2], y=sums[3]))
        return pa.concat_tables(out)

    return score


def weights(histories: DataFrame) -> DataFrame:
    """order, hist, log_weight: the backoff weight of each history seen in training."""
    sums = histories.groupBy("order", "hist").agg(F.max("n").alias("n"), F.sum("x").alias("kept"), F.sum("y").alias("lower"))
    left = F.greatest(1 - F.col("kept") / F.col("n"), F.lit(1e-12)) / F.greatest(1 - F.col("lower"), F.lit(1e-12))
    return sums.select("order", "hist", F.log10(left).alias("log_weight"))


def score(docs: DataFrame, train: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    size, documents = docs.agg(F.sum(F.octet_length("text")), F.count(F.when(train, 1))).first()
    blocks = max(1, math.ceil((size or 0) / block_bytes))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block")
    )
    by_block = base.groupBy("block")
    counted = by_block.applyInArrow(_count(order, blocks), COUNTS)
    answers = settle(counted.groupBy("order", "bucket").applyInArrow(_answer, ANSWERS), "counts", "order", large=True)
    model = _model(answers, order, documents)
    replies = answers.filter("block is not null").select("order", "bucket", "block", "payload")
    scored = settle(by_block.cogroup(replies.groupBy("block")).applyInArrow(_score(model), SCORED), "scored", "kind", large=True)
    backoff = settle(weights(scored.filter("kind = 'history'")), "backoff", "order")
    open_ = scored.filter("kind = 'open'").select("block", "row", "order", "hist", "n")
    taken = open_.join(backoff, ["order", "hist"]).groupBy("block", "row").agg(F.sum(F.col("n") * F.col("log_weight")).alias("weights"))
    rows = scored.filter("kind = 'document'").join(taken, ["block", "row"], "left")
    return rows.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), F.col("m").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("x").alias("base_score"), (F.col("y") + F.coalesce("weights", F.lit(0.0))).alias("score"),
    )
