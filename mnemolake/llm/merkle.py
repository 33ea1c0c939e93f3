"""Merkle manifest of a table: bitmap ranks give leaf coordinates, keyed slot arrays reduce levels.

Every row is a leaf, the hash of its fields. Rows of one language are the leaves of a subtree in doc_id order, and
the subtrees' tops are the leaves of the tree above, in order of language. A leaf's place is its rank among the
doc_ids of its language, and ranks are counted, not sorted: tasks write compressed bitmaps of the doc_ids they see,
4096 ids to a container (runs, a list or plain bits, whichever is least); containers of one range are merged, a
running sum gives the number of ids before each, and within one the ids below a bit are those of its word,
masked, plus a directory of counts per word.

With coordinates known, nodes of one group and ``SLOTS`` consecutive places go into one array of slots, keyed by place,
which is reduced by up to four levels inside the task; one row per array goes on to the next step. On the way back
each array takes the path above it and hands its slots their own siblings, so that proofs are hashed where the leaves are.

Defined results: missing fields are hashed as ``-``, and a missing language is a group of its own, the first one; if
doc_ids are missing or repeated, rows are put in order of doc_id (missing first), then leaf, and numbered for
their ranks; a single leaf is its own subroot, a single subroot the root; an empty table gives no row. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import saved
from mnemolake.operators.ordered import running_sum

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 8
LEVELS = 4
#: Places of one slot array, and ids of one bitmap container.
SLOTS = FANOUT**LEVELS
BITS = 4096
WORDS = BITS // 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The group of the tree over the subtrees; groups of languages are '' or begin with '+'.
TOP = "*"
NODES = "part string, place long, levels int, digest binary"
PATH = "part string, slots long, path array<struct<before:binary,after:binary>>, subroot binary, root binary"
PLACED = "part string, place long, levels int, doc_id long, leaf binary, altered binary"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


# ---- leaves


def _told(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(docs: DataFrame, text: Column) -> Column:
    """The leaf of each row, with ``text`` as its text, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[_told(text if c == "text" else docs[c]) for c in FIELDS]).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(part, id, doc_id, leaf, altered): ``id`` is unique and ascends as the leaves do; ``altered`` is the leaf after tampering."""
    name = F.coalesce(F.concat(F.lit("+"), docs["lang"].cast("string")), F.lit(""))
    tampered = F.pmod(F.crc32(docs["doc_id"].cast("string")), F.lit(3)) == 0
    hashed = docs.select(
        name.alias("part"), docs["doc_id"].cast("bigint").alias("doc_id"), leaf_of(docs, docs["text"]).alias("leaf"),
        F.when(tampered, leaf_of(docs, F.translate(docs["text"].cast("string"), UPPER, LOWER))).alias("altered"),
    )
    hashed = saved(hashed, "hashed")
    odd = hashed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return hashed.select("part", F.col("doc_id").alias("id"), "doc_id", "leaf", "altered")
    # equal rows are told apart by where they stand, so that no range of the sort has to hold them all
    spread = saved(hashed.withColumn("spot", F.monotonically_increasing_id()), "spots")
    ordered = spread.orderBy(F.col("doc_id").asc_nulls_first(), "leaf", "spot").withColumn("id", F.monotonically_increasing_id())
    return saved(ordered.select("part", "id", "doc_id", "leaf", "altered"), "ordered")


# ---- bitmaps


def pack(low: np.ndarray) -> bytes:
    """A container of ascending ids below ``BITS``: its kind, then the shortest of runs, list and bits."""
    low = low.astype("<u2")
    cut = np.flatnonzero(np.diff(low) != 1)
    first, last = low[np.concatenate([[0], cut + 1])], low[np.concatenate([cut, [len(low) - 1]])]
    if 4 * len(first) <= min(2 * len(low), BITS // 8):
        return b"r" + np.stack([first, last]).astype("<u2").tobytes()
    if 2 * len(low) <= BITS // 8:
        return b"l" + low.tobytes()
    bits = np.zeros(BITS, np.uint8)
    bits[low] = 1
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def words(blob: bytes) -> np.ndarray:
    """The container as 64-bit words."""
    kind, values = blob[:1], np.frombuffer(blob, "<u2", offset=1)
    if kind == b"b":
        return np.frombuffer(blob, "<u8", offset=1)
    bits = np.zeros(BITS + 1, np.int8)
    if kind == b"l":
        bits[values] = 1
    else:
        first, last = values.reshape(2, -1).astype(np.int64)
        bits[first] += 1
        bits[last + 1] -= 1
        bits = np.cumsum(bits, dtype=np.int8)
    return np.packbits(bits[:BITS].astype(np.uint8), bitorder="little").view("<u8")


def rank(container: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How many ids of the container are below each of ``low``."""
    directory = np.concatenate([[0], np.cumsum(np.bitwise_count(container), dtype=np.int64)])
    word, bit = low >> 6, (low & 63).astype(np.uint64)
    below = container[word] & ((np.uint64(1) << bit) - np.uint64(1))
    return directory[word] + np.bitwise_count(below)


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, high, bits): the ids of one batch, container by container."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("part").dictionary_encode()
        part, ids = names.indices.to_numpy().astype(np.int64), batch.column("id").to_numpy()
        order = np.lexsort((ids, part))
        part, ids = part[order], ids[order]
        high = ids >> 12
        cut = np.flatnonzero((part[1:] != part[:-1]) | (high[1:] != high[:-1])) + 1
        starts = np.concatenate([[0], cut])
        blobs = [pack(x & (BITS - 1)) for x in np.split(ids, cut)]
        yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(part[starts])), pa.array(high[starts]), pa.array(blobs, pa.binary())], ["part", "high", "bits"])


def _merged(rows: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([words(b) for b in rows["bits"].to_pylist()])
    low = np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
    return pa.table({"part": rows["part"][:1], "high": rows["high"][:1], "bits": pa.array([pack(low)], pa.binary()), "n": pa.array([len(low)], pa.int64())})


def bitmaps(rows: DataFrame) -> DataFrame:
    """(part, high, bits, before, levels) for rows (part, id): a merged container, the ids before it, the levels of its tree."""
    pieces = rows.select("part", "id").mapInArrow(_containers, "part string, high long, bits binary")
    merged = saved(pieces.groupBy("part", "high").applyInArrow(_merged, "part string, high long, bits binary, n long"), "bitmaps")
    counted = running_sum(merged.select("part", "high", "n", (F.col("high") + (1 << 51)).alias("at")), ["part"], ["at"], F.col("n"), "upto")
    totals = merged.groupBy("part").agg(tree_levels(F.sum("n")).alias("levels"))
    counted = counted.select("part", "high", (F.col("upto") - F.col("n")).alias("before"))
    return merged.select("part", "high", "bits").join(counted, ["part", "high"]).join(totals, "part")


def _placed(rows: pa.Table, container: pa.Table) -> pa.Table:
    before, levels, bits = (container[c][0].as_py() for c in ("before", "levels", "bits"))
    place = before + rank(words(bits), rows["id"].to_numpy() & (BITS - 1))
    return pa.table([rows["part"], pa.array(place, pa.int64()), pa.array([levels] * rows.num_rows, pa.int32()), *(rows[c] for c in ("doc_id", "leaf", "altered"))], ["part", "place", "levels", "doc_id", "leaf", "altered"])


def placed(rows: DataFrame, containers: DataFrame) -> DataFrame:
    """(part, place, levels, doc_id, leaf, altered): each leaf with its rank in its group."""
    keyed = rows.withColumn("high", F.shiftright("id", 12))
    return keyed.groupBy("part", "high").cogroup(containers.groupBy("part", "high")).applyInArrow(_placed, PLACED)


# ---- levels


def tree_levels(n: Column) -> Column:
    """Levels above ``n`` nodes until one is left."""
    one_up = lambda a, _: F.struct(F.ceil(a["n"] / FANOUT).alias("n"), (a["k"] + (a["n"] > 1).cast("int")).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.struct(n.cast("bigint").alias("n"), F.lit(0).alias("k")), one_up)["k"]


def reduced(slots: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of each level, from hex digests up: every eight consecutive ones become one, the last run may be shorter."""
    tree = [slots]
    for _ in range(levels):
        below = tree[-1]
        tree.append([digest(b"".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return tree


def _tree(rows: pa.Table, column: str) -> tuple[list[int], list[list[bytes]]]:
    """The slot of each row, and the levels over the array of slots."""
    at = (rows["place"].to_numpy() % SLOTS).tolist()
    slots: list[bytes] = [b""] * len(at)
    for i, value in zip(at, rows[column].to_pylist(), strict=True):
        slots[i] = value.hex().encode()
    return at, reduced(slots, min(LEVELS, rows["levels"][0].as_py()))


def siblings(tree: list[list[bytes]], at: int) -> list[tuple[bytes, bytes]]:
    """What stands before and after a node in its run, level by level."""
    out = []
    for level in tree[:-1]:
        run = at - at % FANOUT
        out.append((b"".join(level[run:at]), b"".join(level[at + 1 : run + FANOUT])))
        at //= FANOUT
    return out


def _step(rows: pa.Table) -> pa.Table:
    _, tree = _tree(rows, "digest")
    (top,) = tree[-1]
    slots, levels = int(rows["place"][0].as_py()) // SLOTS, max(0, rows["levels"][0].as_py() - LEVELS)
    return pa.table({"part": rows["part"][:1], "place": pa.array([slots], pa.int64()), "levels": pa.array([levels], pa.int32()), "digest": pa.array([bytes.fromhex(top.decode())], pa.binary())})


def _in_arrays(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("slots", F.shiftright("place", 3 * LEVELS))


def steps_up(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The nodes each step reduces, and the groups' last nodes by the step that made them."""
    steps, tops = [nodes], []
    while True:
        made = saved(_in_arrays(steps[-1]).groupBy("part", "slots").applyInArrow(_step, NODES), f"step{len(steps)}")
        tops.append(made.where("levels = 0"))
        if made.where("levels > 0").isEmpty():
            return steps, tops
        steps.append(made.where("levels > 0"))


def _paths(rows: pa.Table, above: pa.Table) -> pa.Table:
    """Paths of nodes, which are paths above the slot arrays of the step below."""
    at, tree = _tree(rows, "digest")
    over = [(p["before"], p["after"]) for p in above["path"][0].as_py()]
    path = [[{"before": b, "after": a} for b, a in siblings(tree, i) + over] for i in at]
    kind = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
    same = [pa.array([above[c][0].as_py()] * len(at), pa.binary()) for c in ("subroot", "root")]
    return pa.table([rows["part"], rows["place"], pa.array(path, kind), *same], ["part", "slots", "path", "subroot", "root"])


def steps_down(steps: list[DataFrame], over_tops: list[DataFrame]) -> DataFrame:
    """(part, slots, path, subroot, root): the path above each slot array of the first step."""
    paths = over_tops[-1]
    for nodes, over in zip(steps[:0:-1], over_tops[-2::-1], strict=True):
        own = _in_arrays(nodes).groupBy("part", "slots").cogroup(paths.groupBy("part", "slots")).applyInArrow(_paths, PATH)
        paths = saved(own.unionByName(over), "paths")
    return paths


def _proofs(rows: pa.Table, above: pa.Table) -> pa.Table:
    at, tree = _tree(rows, "leaf")
    over = [(p["before"], p["after"]) for p in above["path"][0].as_py()]
    rest = b"".join(b + a for b, a in over)
    same = [pa.array([above[c][0].as_py().hex()] * len(at)) for c in ("subroot", "root")]
    proofs, folded = [], []
    for i, altered in zip(at, rows["altered"].to_pylist(), strict=True):
        own = siblings(tree, i)
        proofs.append(digest(b"".join(b + a for b, a in own) + rest))
        node = altered.hex().encode() if altered is not None else tree[0][i]
        for b, a in own + over:
            node = digest(b + node + a)
        folded.append(node)
    return pa.table([rows["doc_id"], pa.array([tree[0][i] for i in at]).cast(pa.string()), *same, pa.array(proofs).cast(pa.string()), pa.array(folded).cast(pa.string())], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of ``docs``."""
    rows = leaves(docs)
    spots = saved(placed(rows, bitmaps(rows)), "placed")
    steps, tops = steps_up(spots.select("part", "place", "levels", F.col("leaf").alias("digest")))
    # one row per language from here to ``steps_down`` of the trees below
    done = saved(reduce(DataFrame.unionByName, [t.select("part", "digest", F.lit(i).alias("step")) for i, t in enumerate(tops)]), "subroots")
    numbered = done.withColumn("place", F.row_number().over(Window.orderBy("part")).cast("bigint") - 1)
    head = numbered.select(F.lit(TOP).alias("part"), "place", tree_levels(F.lit(done.count())).alias("levels"), "digest")
    top_steps, top_tops = steps_up(saved(head, "head"))
    none = F.array().cast("array<struct<before:binary,after:binary>>")
    crown = [t.select("part", F.lit(0).cast("bigint").alias("slots"), none.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root")) for t in top_tops]
    over_top = steps_down(top_steps, crown)
    own = _in_arrays(top_steps[0]).groupBy("part", "slots").cogroup(over_top.groupBy("part", "slots")).applyInArrow(_paths, PATH)
    named = saved(own.select(F.col("slots").alias("place"), "path", "root").join(numbered, "place").select("part", "step", "path", F.col("digest").alias("subroot"), "root"), "tops")
    over = [named.where(F.col("step") == i).select("part", F.lit(0).cast("bigint").alias("slots"), "path", "subroot", "root") for i in range(len(tops))]
    above = steps_down(steps, over)
    found = _in_arrays(spots).groupBy("part", "slots").cogroup(above.groupBy("part", "slots")).applyInArrow(_proofs, PROOFS)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
