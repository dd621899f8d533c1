"""How far the sources of a language differ: word probabilities of each source against the others and the language.

For each language CountVectorizer makes exact sparse vectors of its documents over the terms that LEAST_DOCUMENTS or more
of them hold (minDF; vocabSize is the largest integer, so no term is cut). Vectors of a source are summed entry by entry,
combined in the tasks that made them. Every source gets p = 1 + floor(SCALE (count + PRIOR) / (N + PRIOR V)) for each of the
language's V terms, N being its counts' sum; the language gets q from the sum of its sources.
- `term_gaps`: of each source the terms that it uses more than the language does, by p - q, the first MOST_TERMS.
- `source_gaps`: for each two sources of a language the sum over all V terms of |p - p'|. Sums are made sparsely: in tiles of TILE_TERMS
  terms and TILE_SOURCES x TILE_SOURCES sources only terms that one of them holds are looked at; all others add
  |base - base'| each, where base is p of a count of 0.

All arithmetic is exact: counts are whole numbers below 2^53 in the vectors, products are decimals, sums are longs. The
vocabulary of a language goes through the driver, as CountVectorizer builds it there: it has one entry for each term of
LEAST_DOCUMENTS documents and is not cut. CountVectorizer counts documents as 32-bit integers, so a language of more than
MOST_DOCUMENTS rows is refused with an error.

Null texts, languages and sources count as ''. Empty texts have no terms, but their (lang, source) exists. Languages
of fewer than LEAST_DOCUMENTS documents, and those without such a term, have V = 0: all their pairs are 0 and
they have no terms. Repeated rows are documents of their own. A very long text is one vector like others. Ties are ordered by
the item's UTF-8 bytes. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxweave.llm import grams
from taxweave.llm.common import pieces, settle
from taxweave.session import fresh_folder

LEAST_DOCUMENTS = 30
SCALE, PRIOR = 1_000_000_000, 5
MOST_TERMS = 50
MOST_DOCUMENTS = (1 << 31) - 1
TILE_TERMS, TILE_SOURCES = 4096, 128
#: In every document and no term of any (terms hold letters and what isn't ASCII), so that no vocabulary is empty, which CountVectorizer refuses.
EVERYWHERE = " "


#: For each byte of UTF-8 what it is in a term, 0 between terms.
_IN_TERM = np.arange(256, dtype=np.uint8)
_IN_TERM[:0x80] = 0
_IN_TERM[ord("A") : ord("Z") + 1] = _IN_TERM[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_MARK = 1
#: Entries of vectors that a task sums before it hands them on.
HELD = 1 << 22


def terms(column: pa.Array) -> pa.ListArray:
    """EVERYWHERE and the terms of each text."""
    data, offsets = grams.buffer(column)
    marked = np.insert(_IN_TERM[data], offsets[:-1], _MARK)
    bounds = offsets + np.arange(len(offsets))
    inside = marked != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (marked[:-1] == _MARK) | (marked[1:] == _MARK)
    places = np.flatnonzero(begins)
    marked[marked == _MARK] = ord(EVERYWHERE)
    ends = np.append(np.cumsum(inside)[places] - 1, inside.sum()).astype(np.int32)
    words = pa.StringArray.from_buffers(len(places), pa.py_buffer(ends), pa.py_buffer(marked[inside]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(places, bounds).astype(np.int32)), words)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in pieces(batch, "text"):
            yield pa.record_batch([some.column("source"), terms(some.column("text")), some.column("folder")], ["source", "words", "folder"])


def _added(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of each one's values."""
    key, value = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*values, np.zeros(0, np.int64)])
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[new], np.add.reduceat(value, new) if len(new) else value


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of a task summed by source, entry by entry: (source, at, count)."""
    names: dict[str, int] = {}
    keys, values, held = [], [], 0

    def rows(key: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        known = pa.array(list(names), pa.string())
        for start in range(0, len(key), 1 << 16):
            some = slice(start, start + (1 << 16))
            source = known.take(pa.array(key[some] >> 32))
            yield pa.record_batch([source, pa.array((key[some] & 0xFFFFFFFF).astype(np.int32)), pa.array(value[some])], ["source", "at", "count"])

    for batch in batches:
        code = np.array([names.setdefault(s, len(names)) for s in batch.column("source").to_pylist()], np.int64)
        at = batch.column("indices")
        many = np.diff(at.offsets.to_numpy())
        keys.append((np.repeat(code, many) << 32) | at.flatten().to_numpy().astype(np.int64))
        values.append(batch.column("values").flatten().to_numpy().astype(np.int64))
        held += len(keys[-1])
        if held > HELD:
            key, value = _added(keys, values)
            keys, values, held = [key], [value], len(key)
        if held > HELD // 2 and len(keys) == 1:
            yield from rows(keys[0], values[0])
            keys, values, held = [], [], 0
    yield from rows(*_added(keys, values))


def _share(count: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR n_terms)), exactly."""
    whole = (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return (F.call_function("div", whole, (total + PRIOR * n_terms).cast("decimal(20,0)")) + 1).cast("long")


class Counts:
    """Written tables: `groups` (lang, source, v, n, base, lang_n), `terms` (lang, at, term), `counts` (lang, source, at, count, p)."""

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCUMENTS):
        spark = docs.sparkSession
        named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
        rows = docs.select(*named, "text")
        groups = settle(rows.groupBy("lang", "source").agg(F.count("*").alias("rows")), "groups")
        langs = groups.groupBy("lang").agg(F.sum("rows").alias("rows"))
        large = [r for r in langs.filter(F.col("rows") >= least).collect()]  # a row for each language
        if any(r.rows > MOST_DOCUMENTS for r in large):
            raise ValueError(f"a language has more than {MOST_DOCUMENTS} documents")
        # One folder for each language, as each is read alone and twice. Its name is a digest, for '' can't be one.
        wanted = rows.join(F.broadcast(langs.filter(F.col("rows") >= least).select("lang")), "lang").select("source", "text", F.sha1("lang").alias("folder"))
        split = settle(wanted.mapInArrow(_split, "source string, words array<string>, folder string"), "terms", "folder") if large else None
        vocabularies, counts = [], []
        for lang in sorted(r.lang for r in large):
            own = split.filter(F.col("folder") == hashlib.sha1(lang.encode()).hexdigest()).select("source", "words")
            model = CountVectorizer(inputCol="words", outputCol="vector", minDF=float(least), vocabSize=MOST_DOCUMENTS).fit(own)
            path = fresh_folder(spark, "vocabulary")
            model.write().save(path)
            known = spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("at", "term"))
            vocabularies.append(known.filter(F.col("term") != EVERYWHERE).select(F.lit(lang).alias("lang"), "at", "term"))
            vector = F.unwrap_udt(F.col("vector"))
            entries = model.transform(own).select("source", vector["indices"].alias("indices"), vector["values"].alias("values"))
            entries = entries.mapInArrow(_summed, "source string, at int, count long")
            summed = entries.groupBy("source", "at").agg(F.sum("count").alias("count"))
            counts.append(settle(summed.select(F.lit(lang).alias("lang"), "source", "at", "count"), "counts"))
        none = spark.createDataFrame([], "lang string, at int, term string"), spark.createDataFrame([], "lang string, source string, at int, count long")
        self.terms = settle(_all(vocabularies, none[0]), "vocabularies")
        found = _all(counts, none[1]).join(self.terms.select("lang", "at"), ["lang", "at"])  # without EVERYWHERE
        found = settle(found.select("lang", "source", "at", "count"), "counts")
        n_terms = self.terms.groupBy("lang").agg(F.count("*").alias("v"))
        n = found.groupBy("lang", "source").agg(F.sum("count").alias("n"))
        known = groups.select("lang", "source").join(n, ["lang", "source"], "left").join(n_terms, "lang", "left")
        known = known.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("v", "n")])
        base = F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("n"), F.col("v"))).otherwise(0).cast("long")
        lang_n = F.sum("n").over(Window.partitionBy("lang"))
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
        self.groups = settle(known.select("*", base.alias("base"), lang_n.alias("lang_n"), number.alias("number")), "groups")
        share = _share(F.col("count"), F.col("n"), F.col("v"))
        of = self.groups.select("lang", "source", "v", "n", "number")
        self.counts = settle(found.join(of, ["lang", "source"]).select("lang", "source", "number", "at", "count", share.alias("p")), "counts")


def _all(parts: list[DataFrame], none: DataFrame) -> DataFrame:
    for part in parts:
        none = none.union(part)
    return none


def term_gaps(known: Counts, most: int = MOST_TERMS) -> DataFrame:
    """lang, source, item, value, rank: the terms a source uses more than its language."""
    total = known.counts.groupBy("lang", "at").agg(F.sum("count").alias("lang_count"))
    of = known.groups.select("lang", "v", "lang_n").distinct()
    shares = total.join(of, "lang").join(known.terms, ["lang", "at"])
    shares = shares.select("lang", "at", "term", _share(F.col("lang_count"), F.col("lang_n"), F.col("v")).alias("q"))
    more = known.counts.join(shares, ["lang", "at"]).filter(F.col("p") > F.col("q"))
    more = more.select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return more.withColumn("rank", rank).filter(F.col("rank") <= most)


def _tile(key: tuple, strips: pa.Table) -> pa.Table:
    """For each two sources of a tile: how many of its terms one source of the tile holds, and the sum of |p - p'| over them."""
    side = np.array(strips.column("side").to_pylist())
    at = [np.array(x, np.int64) for x in strips.column("at").to_pylist()]
    shares = [np.array(x, np.int64) for x in strips.column("p").to_pylist()]
    number, base = (strips.column(c).to_numpy() for c in ("number", "base"))
    held = np.unique(np.concatenate([*at, np.zeros(0, np.int64)]))
    table = np.repeat(base[:, None], len(held), axis=1)
    for row, (places, values) in enumerate(zip(at, shares)):
        table[row, np.searchsorted(held, places)] = values
    a, b, sums = [], [], []
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if key[2].as_py() == key[3].as_py() else 1))
    for row in left:
        others = right[number[right] > number[row]]
        a.append(np.full(len(others), number[row]))
        b.append(number[others])
        sums.append(np.abs(table[others] - table[row]).sum(axis=1))
    a, b, sums = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (a, b, sums))
    columns = [pa.array([key[0].as_py()] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(np.full(len(a), len(held)), pa.int64()), pa.array(sums, pa.int64())]
    return pa.table(columns, ["lang", "a", "b", "held", "apart"])


def source_gaps(known: Counts) -> DataFrame:
    """lang, source, item, value, rank: every other source of the language and how far it is."""
    groups = known.groups.select("lang", "source", "number", "v", "base")
    last = F.floor(F.col("v") / TILE_TERMS).cast("int")  # places go up to v, as EVERYWHERE has one
    every = groups.select("lang", "number", "base", F.explode(F.sequence(F.lit(0), last)).alias("strip"))
    strip = F.floor(F.col("at") / TILE_TERMS).cast("int")
    entries = F.array_sort(F.collect_list(F.struct("at", "p"))).alias("entries")  # at most TILE_TERMS
    filled = known.counts.groupBy("lang", "number", strip.alias("strip")).agg(entries)
    strips = every.join(filled, ["lang", "number", "strip"], "left").withColumn("entries", F.coalesce("entries", F.array().cast("array<struct<at:int,p:long>>")))
    # A strip of block k is the first side of tiles (k, k), (k, k + 1) ..., and the second of (0, k), (1, k) ...
    block = F.floor((F.col("number") - 1) / TILE_SOURCES).cast("int")
    blocks = groups.groupBy("lang").agg(F.max(block).alias("last"))
    tiles = F.concat(
        F.transform(F.sequence("block", "last"), lambda k: F.struct(F.lit(0).alias("side"), F.col("block").alias("i"), k.alias("j"))),
        F.when(F.col("block") > 0, F.transform(F.sequence(F.lit(0), F.col("block") - 1), lambda k: F.struct(F.lit(1).alias("side"), k.alias("i"), F.col("block").alias("j")))).otherwise(
            F.array().cast("array<struct<side:int,i:int,j:int>>")
        ),
    )
    dealt = strips.withColumn("block", block).join(blocks, "lang").withColumn("tile", F.explode(tiles))
    dealt = dealt.select("lang", "strip", "tile.i", "tile.j", "tile.side", "number", "base", F.col("entries.at").alias("at"), F.col("entries.p").alias("p"))
    part = dealt.groupBy("lang", "strip", "i", "j").applyInArrow(_tile, "lang string, a int, b int, held long, apart long")
    sums = part.groupBy("lang", "a", "b").agg(F.sum("held").alias("held"), F.sum("apart").alias("apart"))
    first, second = (groups.select("lang", "v", F.col("number").alias(x), F.col("source").alias(f"source_{x}"), F.col("base").alias(f"base_{x}")) for x in "ab")
    named = sums.join(first, ["lang", "a"]).join(second.drop("v"), ["lang", "b"])
    value = (F.col("apart") + (F.col("v") - F.col("held")) * F.abs(F.col("base_a") - F.col("base_b"))).cast("long")
    both = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("source_a", "source_b"), ("source_b", "source_a"))])
    rows = named.select("lang", F.explode(both).alias("pair"), value.alias("value")).select("lang", "pair.source", "pair.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", rank)


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, most: int = MOST_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    known = Counts(docs, least)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = source_gaps(known).withColumn("part", F.lit("pair"))
    return pairs.select(*columns).union(term_gaps(known, most).withColumn("part", F.lit("term")).select(*columns))
