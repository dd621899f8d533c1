"""Token ids in files: each document a zstandard frame of its own, under one trained dictionary.

A written folder holds a `dictionary` table (one row: hash and bytes) and a `blocks` table. A block
is one binary value: a header, the dictionary's hash, an index (id, number of tokens and frame end of
each document) and the frames. Blocks are ordered by doc_id, and their columns first_doc and last_doc
let a reader of one document skip all other blocks by file statistics.

Null texts are empty documents, so they hold the end id alone; a null doc_id sorts first; rows with
equal doc_id are all written, ordered by a hash of the text. A text of any length is one frame. An empty table gives a folder with a dictionary row
and no block. Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxweave.llm import tokens

MAGIC = b"TWTOK1"
#: magic, bytes per id, hash of the dictionary, documents
HEADER = "<6sH32sI"
HEADER_BYTES = struct.calcsize(HEADER)
BLOCK_BYTES = 512 << 10
BLOCK_DOCUMENTS = 4096
#: The dictionary is trained on the first ids of so many documents, whatever the size of the table.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 16_000, 64 << 10
NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id in an index

BLOCKS = "part int, block int, first_doc long, last_doc long, documents long, ids long, ids_before long, payload binary"
DOCUMENTS = "doc_id long, part int, in_part long, n_tokens long, ids binary"


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> tuple[bytes, bytes]:
    """(hash, bytes) of a zstandard dictionary trained on serialized id arrays of a bounded sample."""
    import zstandard

    texts = tokens.texts_of(docs).withColumn("order", F.xxhash64("doc_id"))
    last = texts.select("order").orderBy("order").limit(SAMPLE_DOCUMENTS).agg(F.max("order")).first()[0]
    sample = texts.filter(F.col("order") <= F.lit(last)).limit(SAMPLE_DOCUMENTS).select(F.substring("text", 1, SAMPLE_CHARS)).collect()
    known = tokens.Encoder(tokenizer)
    arrays = [_narrow(known.encode(text or "") + end_id.to_bytes(4, "little"), width) for (text,) in sample]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the arrays themselves serve as the dictionary
        trained = b"".join(arrays)[:DICTIONARY_BYTES]
    return hashlib.sha256(trained).digest(), trained


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes()


def _pack(header: tuple, index: list[tuple[int, int]], frames: list[bytes]) -> bytes:
    ids, counts = np.array(index, "<i8").T
    ends = np.cumsum([len(f) for f in frames]).astype("<i8")
    return b"".join([struct.pack(HEADER, MAGIC, *header, len(frames)), ids.tobytes(), counts.tobytes(), ends.tobytes(), *frames])


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> None:
    """Write all texts in ascending doc_id order."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    digest, trained = train_dictionary(docs, tokenizer, end_id, width)
    spark.createDataFrame([(digest.hex(), bytearray(trained))], "hash string, dictionary binary").write.parquet(f"{folder}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        compress = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True).compress
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        number = before = 0
        index, frames, held = [], [], 0

        def block() -> pa.RecordBatch:
            seen = [i for i, _ in index if i != NO_ID]
            count = sum(n for _, n in index)
            values = [part, number, min(seen, default=None), max(seen, default=None), len(index), count, before, _pack((width, digest), index, frames)]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
            return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for doc_id, ids in tokens.encoded(batches, tokenizer, end_id):
            frame = compress(_narrow(ids, width))
            index.append((NO_ID if doc_id is None else doc_id, len(ids) // 4))
            frames.append(frame)
            held += len(frame)
            if held >= BLOCK_BYTES or len(frames) >= BLOCK_DOCUMENTS:
                yield block()
                number, before = number + 1, before + sum(n for _, n in index)
                index, frames, held = [], [], 0
        if frames:
            yield block()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The texts' hash is part of the range, so rows without id, or many of one id, aren't one task's.
    by = ["doc_id", F.xxhash64("text")]
    ordered = tokens.texts_of(docs).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    ordered.mapInArrow(blocks, BLOCKS).write.parquet(f"{folder}/blocks")


def _read_blocks(blocks: DataFrame, trained: bytes, digest: bytes, only: int | None = None) -> DataFrame:
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained)).decompress
        for batch in batches:
            for row in range(batch.num_rows):
                payload = batch.column("payload")[row].as_buffer()
                magic, width, under, count = struct.unpack_from(HEADER, payload)
                if magic != MAGIC or under != digest:
                    raise ValueError("not a block of this folder, or of another dictionary")
                doc_ids, counts, ends = np.frombuffer(payload, "<i8", 3 * count, HEADER_BYTES).reshape(3, count)
                frames = memoryview(payload)[HEADER_BYTES + 24 * count :]
                starts = np.concatenate([[0], ends[:-1]])
                before = batch.column("ids_before")[row].as_py() + np.concatenate([[0], np.cumsum(counts)[:-1]])
                chosen = np.arange(count) if only is None else np.flatnonzero(doc_ids == only)
                for some in np.array_split(chosen, max(1, len(chosen) // 256)):
                    ids = [np.frombuffer(expand(frames[starts[k] : ends[k]]), f"<u{width}").astype("<u4").tobytes() for k in some]
                    yield pa.record_batch(
                        [
                            pa.array([None if doc_ids[k] == NO_ID else int(doc_ids[k]) for k in some], pa.int64()),
                            pa.array([batch.column("part")[row].as_py()] * len(some), pa.int32()),
                            pa.array(before[some], pa.int64()),
                            pa.array(counts[some], pa.int64()),
                            pa.array(ids, pa.binary()),
                        ],
                        ["doc_id", "part", "in_part", "n_tokens", "ids"],
                    )

    # Payloads don't compress any further, so a batch is never larger than a split of the files.
    return blocks.select("part", "ids_before", "payload").mapInArrow(documents, DOCUMENTS)


def _dictionary(spark: SparkSession, folder: str) -> tuple[bytes, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    return bytes(row.dictionary), bytes.fromhex(row.hash)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit)."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    # One row for each written part, not for each block.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("parts_before"))
    # As many rows as tasks wrote, so the ids needn't be shuffled to meet them.
    documents = _read_blocks(blocks, *_dictionary(spark, folder))
    return documents.join(F.broadcast(parts), "part").select("doc_id", (F.col("parts_before") + F.col("in_part")).alias("start"), "n_tokens", "ids")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> DataFrame:
    """The ids of one document; only blocks that can hold it are read, and only its frame is expanded."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").filter((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    return _read_blocks(blocks, *_dictionary(spark, folder), only=doc_id).select("doc_id", "n_tokens", "ids")
