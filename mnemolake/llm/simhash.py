"""Near duplicates by SimHash: pairs of fingerprints that share pigeonhole blocks, verified by Hamming distance.

A text is its words, A-Z in lower case, and its three-word shingles, repeats included; each bit of its 64-bit
fingerprint is that of the majority of shingle hashes. Equal fingerprints are folded first. The 64 bits are cut into ``b``
blocks; two fingerprints that differ in 3 bits or fewer agree in at least b - 3 whole blocks, so they meet in a bucket for one
choice of b - 3 blocks. ``b`` follows the number of fingerprints, so that unlike ones seldom share a bucket; the
links are the same for every ``b``.

Buckets are compared inside tasks in blocks of at most ``BLOCK`` fingerprints against each other, and only links
that join rows of a block pair leave the task. Where a bucket has more than ``BUCKET`` fingerprints, comparing
them all would grow with the square: there each fingerprint names the points within 2 bits of it, and those that share a point with a
fingerprint within 1 bit of it are linked. That finds exactly the pairs within 3 bits, in proportion to the bucket.

Defined results: a missing text is an empty one; texts without a word have fingerprint zero; texts of one or two
words are one shingle; rows without doc_id take part, and a class of such rows alone has no component_id; repeated
rows and ids are rows of their own; an empty table gives no row. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import keyed, saved, slices, small_batches, text_of
from mnemolake.llm.components import components, roots

SEED = 42
SHINGLE = 3
NEAR = 3
BLOCK = 1024
BUCKET = 1 << 15
#: Hashes whose bits are counted in one step.
STEP = 1 << 15
LINK = "a long, b long"


def fingerprint(text: bytes) -> int:
    """The fingerprint of a UTF-8 text."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1]
    digest, n = xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        spans = zip(starts[at : at + STEP].tolist(), ends[k - 1 :][at : at + STEP].tolist(), strict=True)
        hashes = np.array([digest(flat[s:e], SEED) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = np.array([fingerprint(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(prints.view(np.int64))], ["row", "doc_id", "print"])


def block_count(n: int) -> int:
    """Blocks to cut fingerprints into, so that ``n`` random ones have fewer than two in a bucket."""
    return next((b for b in (5, 6) if n >> (64 * (b - NEAR) // b) == 0), 7)


def masks(blocks: int) -> list[int]:
    """The bits that must agree, for each choice of ``blocks`` - 3 of the blocks."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    each = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(blocks)]
    return [sum(each[i] for i in chosen) for chosen in combinations(range(blocks), blocks - NEAR)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all pairs that differ in 3 bits or fewer."""
    left, right = [], []
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= NEAR)
        left.append(i + at)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _spanning(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    ends, root = roots(a, b)
    return pa.RecordBatch.from_arrays([pa.array(ends[ends != root]), pa.array(root[ends != root])], ["a", "b"])


def _step_links(rows: pa.Table) -> pa.RecordBatch:
    """Spanning links of one pair of blocks, or of one block with itself."""
    side, node, value = (rows[c].to_numpy() for c in ("side", "node", "print"))
    left, value = side == 0, value.view(np.uint64)
    right = ~left
    if not (left.any() and right.any()):  # a block with itself, or with an empty one
        left = right = np.ones(len(side), bool)
    i, j = close_pairs(value[left], value[right])
    return _spanning(node[left][i], node[right][j])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (band, part, i, j): one step after the other, each of bounded size."""
    held: pa.Table | None = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        key = np.stack([held[c].to_numpy().astype(np.int64) for c in ("band", "part", "i", "j")])
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        for s, e in zip(np.concatenate([[0], cut[:-1]]).astype(int), cut, strict=False):
            yield _step_links(held.slice(s, e - s))
        held = held.slice(int(cut[-1])).combine_chunks() if len(cut) else held
    if held is not None and held.num_rows:
        yield _step_links(held)


def _points(batches: Iterator[pa.RecordBatch], free: list[int]) -> Iterator[pa.RecordBatch]:
    """The points within 2 bits of each fingerprint, moved in the bits that its bucket leaves free."""
    moves = {}
    for band, mask in enumerate(free):
        bits = [1 << k for k in range(64) if mask >> k & 1]
        moves[band] = np.array([0, *bits, *(x | y for x, y in combinations(bits, 2))], np.uint64), len(bits) + 1
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            piece = batch.slice(at, 64)
            for band in set(piece.column("band").to_pylist()):
                own = piece.filter(pc.equal(piece.column("band"), band))
                far, close = moves[band]
                point = own.column("print").to_numpy().view(np.uint64)[:, None] ^ far[None, :]
                node = np.repeat(own.column("node").to_numpy(), len(far))
                near = np.tile(np.arange(len(far)) < close, own.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), band, np.int32)), pa.array(point.ravel().view(np.int64)), pa.array(node), pa.array(near)], ["band", "point", "node", "near"])


def links(prints: DataFrame, *, blocks: int | None = None, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect exactly what pairs within 3 bits connect, from different fingerprints (node, print)."""
    must = masks(block_count(prints.count()) if blocks is None else blocks)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in enumerate(must)]))
    spread = prints.select("node", "print", keys.alias("k")).select("node", "print", "k.band", "k.part")
    sizes = spread.groupBy("band", "part").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    member = saved(spread.join(sizes, ["band", "part"]), "buckets")
    cut = member.where(F.col("m") <= bucket).withColumn("blocks", F.ceil(F.col("m") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    each = cut.select("band", "part", "node", "print", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    steps = each.select("band", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "print")
    small = steps.repartition("band", "part", "i", "j").sortWithinPartitions("band", "part", "i", "j").mapInArrow(_bucket_links, LINK)
    large = member.where(F.col("m") > bucket)
    if large.isEmpty():
        return small
    free = [~m & (2**64 - 1) for m in must]
    points = saved(large.select("band", "node", "print").mapInArrow(lambda b: _points(b, free), "band int, point long, node long, near boolean"), "points")
    heads = points.where("near").groupBy("band", "point").agg(F.min("node").alias("head"))
    return small.unionByName(points.join(heads, ["band", "point"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")))


def classes(docs: DataFrame, **options) -> DataFrame:
    """(row, doc_id, fingerprint, component_id) of each row: the smallest doc_id reachable over links."""
    small_batches(docs)
    rows, key = keyed(docs)
    read = rows.select(F.col(key).alias("row"), rows["doc_id"].cast("bigint").alias("doc_id"), text_of(rows).alias("text"))
    prints = saved(read.mapInArrow(_fingerprints, "row long, doc_id long, print long"), "prints")
    different = saved(prints.groupBy("print").agg(F.min("row").alias("node"), F.min("doc_id").alias("first")), "different")
    label = saved(components(links(different.select("node", "print"), **options)).withColumnRenamed("row", "node"), "labels")
    linked = label.join(different, "node")
    least = linked.groupBy("label").agg(F.min("first").alias("least"))
    reached = different.join(linked.join(least, "label").select("node", "least"), "node", "left").select("print", F.coalesce("least", "first").alias("component_id"))
    named = prints.join(saved(reached, "reached"), "print")
    return named.select("row", "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
