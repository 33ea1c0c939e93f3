"""Best-fit packing by minimum bin slack over the table of piece lengths.

Documents become token pieces of at most ``capacity`` ids. How bins are filled depends on lengths alone, and there
are at most ``capacity`` of them, so the whole corpus is planned from one small table (length, number of pieces):
for each bin the largest length left is taken, a subset-sum over the other lengths, kept as a bitset, finds the
fullest combination that fits, and that combination is removed as often as the counts allow. Pieces then look up
their bin by their rank among the pieces of their length. No task or driver ever holds the pieces.

Defined results: a missing text is an empty one and makes a piece of the end id alone; longer documents are cut
every ``capacity`` ids, the last piece may be shorter; missing and repeated doc_ids and repeated rows are packed row
by row; an empty table gives no sequence. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import saved, slices, small_batches, text_of
from mnemolake.llm.subwords import encoder

#: Largest number of (task, length) rows that are broadcast: 24 bytes each.
BROADCAST_ROWS = 500_000
PIECES = "doc_id long, piece int, start long, length int, ids binary, task int, seq long"
SEQUENCES = "sequence_id long, pieces array<struct<doc_id:bigint,piece:int,start:bigint,length:int,offset:int>>, ids binary"


def id_type(tokenizer: str, end_id: int) -> str:
    """The narrowest numpy type that holds every id: pieces are stored and shuffled in it."""
    return "<u2" if max(encoder(tokenizer).tokenizer.get_vocab_size() - 1, end_id) <= 0xFFFF else "<u4"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, kind: str) -> Iterator[pa.RecordBatch]:
    enc, task = encoder(path), TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    for batch in slices(batches):
        ids, sizes = enc.encode(batch.column("text"))
        ids = np.insert(ids, np.cumsum(sizes), end_id).astype(kind)
        sizes = sizes + 1
        many = -(-sizes // capacity)
        row = np.repeat(np.arange(len(sizes)), many)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        length = np.minimum(capacity, sizes[row] - piece * capacity)
        ends = np.cumsum(length)
        seq = np.zeros(len(row), np.int64)
        by = np.argsort(length, kind="stable")
        runs = length[by]
        new = np.flatnonzero(np.diff(runs, prepend=-1))
        seq[by] = seen[runs] + np.arange(len(by)) - np.repeat(new, np.diff(np.append(new, len(by))))
        seen += np.bincount(length, minlength=capacity + 1)
        cuts = np.concatenate([[0], ends]).astype(np.int32) * ids.itemsize
        blob = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])
        columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(length, pa.int32()), blob, pa.array(np.full(len(row), task), pa.int32()), pa.array(seq)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "task", "seq"])


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of all documents, each with its number ``seq`` among the pieces of its length in its task; written once."""
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    kind = id_type(tokenizer, end_id)
    small_batches(docs)
    return saved(rows.mapInArrow(lambda batches: _pieces(batches, tokenizer, end_id, capacity, kind), PIECES), "pieces")


def _fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Lengths, each at most as often as counted, whose sum is the largest one not above ``room``; long ones are tried first."""
    full = (1 << room + 1) - 1
    reach, steps = 1, []
    for n in lengths:
        if n > room:
            continue
        left, take = min(counts[n], room // n), 1
        while left > 0:  # 1, 2, 4 ... copies and the rest: every number of copies is a sum of these
            k = min(take, left)
            grown = (reach | reach << n * k) & full
            if grown != reach:
                steps.append((n, k, reach))
                reach = grown
                if reach >> room & 1:
                    break
            left, take = left - k, take * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            chosen += [n] * k
            at -= n * k
    return chosen


def minimum_slack(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of one bin, number of such bins) until no piece is left."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left, reverse=True)
    bins = []
    while lengths:
        first = lengths[0]
        left[first] -= 1
        combination = [first, *_fullest(left, [n for n in lengths if left[n]], capacity - first)]
        left[first] += 1
        need = Counter(combination)
        times = min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
        bins.append((combination, times))
        lengths = [n for n in lengths if left[n]]
    return bins


def _slots(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each run of equal places: length, first rank, pieces per bin, first bin, and the offset of the first of them."""
    rows, rank, base = [], Counter(), 0
    for combination, times in bins:
        offset = 0
        for n, k in Counter(combination).items():
            rows.append((n, rank[n], k, base, offset))
            rank[n] += k * times
            offset += n * k
        base += times
    rows.sort()
    return dict(zip(("length", "rank", "per", "bin", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def placed(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (as from ``token_pieces``) with ``sequence_id`` and ``offset``."""
    per_task = saved(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(minimum_slack(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(F.broadcast(base) if per_task.count() <= BROADCAST_ROWS else base, ["task", "length"])
    key = (slots["length"] << 44) + slots["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("base").to_numpy() + batch.column("seq").to_numpy()
            i = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            within = rank - slots["rank"][i]
            copy, nth = np.divmod(within, slots["per"][i])
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(slots["bin"][i] + copy), pa.array((slots["offset"][i] + nth * length).astype(np.int32))], ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids", "base", "seq")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length int, ids binary, sequence_id long, offset int")


def _joined(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column("rows")
        inner = rows.flatten()
        bounds = np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
        column = {f: inner.field(f) for f in ("doc_id", "piece", "start", "length", "offset", "ids")}
        ids = np.frombuffer(b"".join(column["ids"].to_pylist()), kind).astype("<u4")
        ends = np.concatenate([[0], np.cumsum(column["length"].to_numpy())])[bounds].astype(np.int32) * 4
        pieces = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([column[f] for f in ("doc_id", "piece", "start", "length", "offset")], ["doc_id", "piece", "start", "length", "offset"]))
        joined = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
        yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pieces, joined], ["sequence_id", "pieces", "ids"])


def pack(docs: DataFrame, *, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """Sequences of at most ``capacity`` ids: (sequence_id, pieces in order, ids as 4-byte little-endian)."""
    kind = id_type(tokenizer, end_id)
    rows = placed(token_pieces(docs, tokenizer, end_id, capacity), capacity)
    # a sequence holds at most ``capacity`` pieces of one id or more: its group is bounded
    gathered = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids"))).alias("rows"))
    return gathered.mapInArrow(lambda batches: _joined(batches, kind), SEQUENCES)
