"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file set is a folder with two Parquet tables. ``ranks`` holds the id of each frequency rank. ``blocks`` holds one
row per run of documents in ascending doc_id order: their ids and token counts, then the token ranks as two byte
strings. ``control`` has two bits per rank (number of bytes less one, four ranks to a byte, lowest bits first),
``data`` the ranks themselves, little-endian, without leading zero bytes. Spark's committer writes the files, so a
lost task leaves nothing behind.

Defined results: a missing text is an empty one; each document, empty or not, ends with the end id; documents
without doc_id come first; equal doc_ids stand side by side, in order of their content; repeated rows stay; an
empty table makes an empty file set. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import saved, slices, small_batches, text_of
from mnemolake.llm.subwords import encoder

BLOCK_TOKENS = 1 << 20
BLOCKS = "shard int, block long, first long, doc_ids array<long>, n_tokens array<long>, control binary, data binary"
#: Bytes of each of the four ranks that one control byte describes.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of an array of ranks below 2^32."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-len(ranks) % 4 + len(ranks), np.uint8)
    codes[: len(ranks)] = size - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    used = np.arange(4, dtype=np.uint8) < size[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks again: one table lookup gives the sizes, one gather at their running sum the values."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    value = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            value[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return value


def _tokens(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    enc, press = encoder(path), zstandard.ZstdCompressor(level=1)
    for batch in slices(batches):
        ids, sizes = enc.encode(batch.column("text"))
        ends = np.cumsum(sizes)
        ids = np.insert(ids, ends, end_id).astype("<u4")
        wide = ids.max(initial=0) > 0xFFFF
        ids = ids if wide else ids.astype("<u2")
        ends = ends + np.arange(1, len(ends) + 1)
        blobs = [press.compress(ids[b - n : b].tobytes()) for b, n in zip(ends, sizes + 1, strict=True)]
        columns = [batch.column("doc_id"), pa.array(sizes + 1, pa.int64()), pa.array([wide] * len(blobs)), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "wide", "ids"])


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, wide, ids): the ids of each document with its end id, compressed, 2 or 4 bytes each."""
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(lambda batches: _tokens(batches, tokenizer, end_id), "doc_id long, n_tokens long, wide boolean, ids binary")


def open_ids(blobs: list[bytes], wide: list[bool]) -> Iterator[np.ndarray]:
    press = zstandard.ZstdDecompressor()
    for blob, w in zip(blobs, wide, strict=True):
        yield np.frombuffer(press.decompress(blob), "<u4" if w else "<u2")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for ids in open_ids(batch.column("ids").to_pylist(), batch.column("wide").to_pylist()):
            got = np.bincount(ids)
            if len(got) > len(total):
                got[: len(total)] += total
                total = got
            else:
                total[: len(got)] += got
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])


def _blocks(batches: Iterator[pa.RecordBatch], rank_of: np.ndarray) -> Iterator[pa.RecordBatch]:
    shard, block, first = TaskContext.get().partitionId(), 0, 0
    names: list[int] = []
    held: list[np.ndarray] = []
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])

    def closed() -> pa.RecordBatch:
        control, data = pack_ranks(rank_of[np.concatenate(held)])
        return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "first": first, "doc_ids": names, "n_tokens": [len(x) for x in held], "control": control, "data": data}], schema)

    size = 0
    for batch in batches:
        for name, ids in zip(batch.column("doc_id").to_pylist(), open_ids(batch.column("ids").to_pylist(), batch.column("wide").to_pylist()), strict=True):
            if held and size + len(ids) > BLOCK_TOKENS:
                yield closed()
                block, first, size = block + 1, first + size, 0
                names, held = [], []
            names.append(name)
            held.append(ids)
            size += len(ids)
    if held:
        yield closed()


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str, end_id: int) -> None:
    """Encode every text and write the file set to ``path``, one shard per range of doc_ids.

    Texts are encoded once. Counting, ranking and coding work on the stored ids; what reaches the driver is the
    rank table, one entry per id of the vocabulary.
    """
    small_batches(docs)
    raw = saved(tokenized(docs, tokenizer, end_id), "ids")
    counts = raw.select("wide", "ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    table = counts.toPandas().sort_values(["n", "id"], ascending=[False, True])
    ranked = table["id"].to_numpy(np.int64)
    rank_of = np.zeros(int(ranked.max(initial=-1)) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    spark = docs.sparkSession
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(ranked)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    shared = spark.sparkContext.broadcast(rank_of)
    content = F.xxhash64("ids")
    # equal ids spread over shards by content and row, so no id is too common for one task
    ordered = raw.repartitionByRange(F.col("doc_id").asc_nulls_first(), content, F.monotonically_increasing_id())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), content)
    ordered.mapInArrow(lambda batches: _blocks(batches, shared.value), BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """The blocks with ``start`` (ids of all blocks before them), and the id of each rank."""
    ranks = spark.read.schema("rank long, id long").parquet(f"{path}/ranks").orderBy("rank").toPandas()
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # one row per shard, however many documents
    shards = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = blocks.join(before, "shard").withColumn("start", F.col("base") + F.col("first"))
    return placed.select("start", "doc_ids", "n_tokens", "control", "data"), ranks["id"].to_numpy(np.uint32)


def documents_of(batches: Iterator[pa.RecordBatch], id_of: np.ndarray) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start, ids) of each document in decoded blocks."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = id_of[unpack_ranks(row["control"], row["data"], sum(row["n_tokens"]))]
            ends = np.cumsum(row["n_tokens"])
            for name, n, end in zip(row["doc_ids"], row["n_tokens"], ends.tolist(), strict=True):
                yield name, row["start"] + end - n, ids[end - n : end]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) as stored, in 4-byte little-endian ids."""
    blocks, id_of = read_token_files(spark, path)
    shared = spark.sparkContext.broadcast(id_of)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, starts, blobs = zip(*((a, b, c.astype("<u4").tobytes()) for a, b, c in documents_of([batch.slice(i, 1)], shared.value)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(rows, "doc_id long, start long, ids binary")


def checksum(ids: bytes) -> int:
    return zlib.crc32(ids)
