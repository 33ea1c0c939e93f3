"""Repeated passages, deleted from every document but the first that holds them, by aligning pairs of documents.

Words are compared without case, however spaced and broken into lines. Every word of every run of ``MIN_WORDS`` words or
more that also stands in an earlier document (by doc_id) is deleted, wherever and however often the run stands in
either: whole lines, parts of longer lines, in any order.

Lines of one text may be parts of lines of another, so texts are cut anew, by content: each window of ``MIN_WORDS`` words
names its least part of a quarter as many words (its anchor), and the windows in a row with one anchor are a line. Texts that
share a window share its anchor. Pairs of documents come from shared anchors:

* where all lines of an anchor are the same words, each later holder is paired with the first, which holds all of it;
* where they differ and the anchor is rare (``rare`` lines at most), each two holders are a pair;
* where they differ and it is frequent, its single windows are looked up, and each later holder of a window is
  paired with the first. This is the exact way for the rest: a hot passage gives one pair per holder, not one per two.

Each pair is aligned by patience diff over the lines that both hold, aligned lines are extended word by word as far as
both texts agree, and what was aligned is taken out; this is repeated for lines that stand in another order. Where no
line is found once in both (repeated passages), the next shared window is aligned with its first place. It ends when
no window of the later text that the earlier one holds is left, and the blocks are deleted from the later document.

Alignment runs in groups of one longer text and some shorter ones, sorted so that the longer comes first: it is sent
once per bounded volume of partners, and a text with thousands of partners is many groups.

Defined results: a missing text has no words and comes back as an empty text; a line of which no word is left goes,
one that loses some keeps the rest; blank lines go only between two deleted lines; documents without doc_id come
last; repeated rows and ids are documents of their own, in the order of their rows; a passage repeated inside the
first document that holds it stays; a document that is wholly repeated becomes empty; an empty table gives no row.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import fresh, keyed, saved, slices, small_batches, text_of

MIN_WORDS = 40
RARE = 8
#: A longer text is sent once per this many bytes of its partners, or once per its own size if that is more.
GROUP_BYTES = 256 << 10
#: Bytes hashed in one step: arrays of their words stay in the cache of a core.
SLICE_BYTES = 128 << 10
_word = re.compile(r"\S+")
_odd = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def lines_of(text: str) -> list[tuple[int, int, int]]:
    """(position, hash, words) of each line with a word: what two texts share in whole lines."""
    out = []
    for i, line in enumerate(text.split("\n")):
        words = line.lower().split()
        if words:
            out.append((i, xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63), len(words)))
    return out


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return value ^ (value >> np.uint64(29))


_space = np.zeros(256, bool)
_space[[*range(9, 14), *range(28, 33)]] = True
_letters = _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_odd))
_letters[_space] = 0


def _piece_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """One number per word, and the byte at which it begins."""
    codes = np.frombuffer(data, np.uint8)
    space = _space[codes]
    first = ~space
    first[1:] &= space[:-1]
    begins = np.flatnonzero(first)
    if not len(begins):
        return np.zeros(0, np.uint64), begins
    sizes = np.diff(begins, append=len(codes))
    place = np.arange(begins[0], len(codes)) - np.repeat(begins, sizes)
    values = _letters[codes[begins[0] :]]
    values *= _power(_odd, int(sizes.max()))[place]
    return _mixed(np.add.reduceat(values, begins - begins[0])), begins


def word_hashes(text: str) -> np.ndarray:
    """One number per word, computed from the bytes of many words at once."""
    text = text.lower()
    data = (text if text.isascii() else " ".join(text.split())).encode()
    out, at = [], 0
    while at < len(data):  # a very long text in pieces that end before a word
        to = at + SLICE_BYTES
        to = len(data) if to >= len(data) else min((k for k in (data.find(c, to) for c in (b" ", b"\n")) if k >= 0), default=len(data))
        out.append(_piece_hashes(data[at:to])[0])
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts in a row, and the number of the text that each comes from."""
    if sum(map(len, texts)) > 2 * SLICE_BYTES:
        parts = [word_hashes(t) for t in texts]
        return np.concatenate(parts), np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    lower = [t.lower() for t in texts]
    flat = [(t if t.isascii() else " ".join(t.split())).encode() for t in lower]
    ends = np.cumsum([len(f) + 1 for f in flat])
    words, begins = _piece_hashes(b"\n".join(flat))
    return words, np.searchsorted(ends, begins, "right")


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        _powers[base] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, base, np.uint64))])
    return _powers[base][:n]


def ranges(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """One number for the words of each range."""
    n = len(words)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _power(_odd, n), dtype=np.uint64)])
    return _mixed((upto[hi] - upto[lo]) * _power(pow(_odd, -1, 2**64), n + 1)[lo])


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """One number for each run of ``size`` words, in text order."""
    lo = np.arange(max(0, len(words) - size + 1))
    return ranges(words, lo, lo + size)


def anchors(words: np.ndarray, min_words: int) -> np.ndarray:
    """For each run of ``min_words`` words, the least window of a quarter as many words in it."""
    part = (min_words + 3) // 4
    least, size, wide = windows(words, part), 1, min_words - part + 1
    if len(least) < wide:
        return np.zeros(0, np.uint64)
    while size < wide:
        step = min(size, wide - size)
        least, size = np.minimum(least[:-step], least[step:]), size + step
    return least


def _lines(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """The different lines of each document: anchor and number of the words."""
    for batch in slices(batches, most=SLICE_BYTES):
        words, text = _words(batch.column("text").to_pylist())
        anchor = anchors(words, min_words)
        inside = np.flatnonzero(text[: len(anchor)] == text[min_words - 1 :]) if len(anchor) else np.zeros(0, np.int64)
        of, anchor = text[inside], anchor[inside]
        first = np.ones(len(inside), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(first)
        last = np.append(first[1:], len(inside))[: len(first)] - 1
        key, of, anchor = ranges(words, inside[first], inside[last] + min_words), of[first], anchor[first]
        order = np.lexsort((key, of))
        once = np.ones(len(order), bool)
        once[1:] = (key[order][1:] != key[order][:-1]) | (of[order][1:] != of[order][:-1])
        order = order[once]
        yield _found(batch, of[order], anchor=anchor[order], key=key[order])


def _windows(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """The different windows with one of the document's anchors that are given."""
    for batch in slices(batches, most=SLICE_BYTES):
        words, text = _words(batch.column("text").to_pylist())
        anchor = anchors(words, min_words)
        inside = np.flatnonzero(text[: len(anchor)] == text[min_words - 1 :]) if len(anchor) else np.zeros(0, np.int64)
        given = batch.column("anchors")
        mine = given.flatten().to_numpy().view(np.uint64) ^ _mixed(np.repeat(np.arange(len(given)), pc.list_value_length(given).to_numpy()).astype(np.uint64))
        inside = inside[np.isin(anchor[inside] ^ _mixed(text[inside].astype(np.uint64)), mine)]
        key, of = windows(words, min_words)[inside], text[inside]
        order = np.lexsort((key, of))
        once = np.ones(len(order), bool)
        once[1:] = (key[order][1:] != key[order][:-1]) | (of[order][1:] != of[order][:-1])
        order = order[once]
        yield _found(batch, of[order], key=key[order])


def _found(batch: pa.RecordBatch, of: np.ndarray, **values: np.ndarray) -> pa.RecordBatch:
    place = batch.column("place").to_numpy()[of]
    return pa.RecordBatch.from_arrays([pa.array(place), *(pa.array(v.view(np.int64)) for v in values.values())], ["place", *values])


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of aligned places, rising in both: lines found once in either part anchor the rest."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        once_a, once_b = Counter(a[i:m]), Counter(b[j:n])
        where = {h: k for k, h in enumerate(b[j:n], j) if once_b[h] == 1}
        both = [(k, where[h]) for k, h in enumerate(a[i:m], i) if once_a[h] == 1 and h in where]
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for k, (_, y) in enumerate(both):  # longest run of anchors that rises in both
            p = bisect_left(tails, y)
            back.append(ends[p - 1] if p else -1)
            tails[p : p + 1] = [y]
            ends[p : p + 1] = [k]
        chain = []
        k = ends[-1] if ends else -1
        while k >= 0:
            chain.append(both[k])
            k = back[k]
        if not chain:
            continue
        lo_i, lo_j = i, j
        for x, y in reversed(chain):
            out.append((x, y))
            todo.append((lo_i, x, lo_j, y))
            lo_i, lo_j = x + 1, y + 1
        todo.append((lo_i, m, lo_j, n))
    return sorted(out)


class Text:
    """The words of a text with what aligning it needs."""

    def __init__(self, words: np.ndarray, windows: np.ndarray, anchors: np.ndarray, size: int):
        self.words, self.windows, self.anchors, self.size = words, windows, anchors, size

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.windows, kind="stable")

    @cached_property
    def ranked(self) -> np.ndarray:
        return self.windows[self.order]

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which ``keys`` are windows of this text, and all places of them here, rising."""
        lo, hi = np.searchsorted(self.ranked, keys, "left"), np.searchsorted(self.ranked, keys, "right")
        known = hi > lo
        if not known.any():
            return known, np.zeros(0, np.int64)
        _, one = np.unique(keys[known], return_index=True)
        lo, n = lo[known][one], (hi - lo)[known][one]
        return known, np.sort(self.order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])

    def starts(self, places: np.ndarray) -> np.ndarray:
        """The first window of each line, of the windows at ``places``."""
        anchor = self.anchors[places]
        return places[np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(places) > 1)])]


def parsed(texts: list[str], min_words: int) -> list[Text]:
    """The texts, with their words hashed in one step."""
    words, of = _words(texts)
    every, least = windows(words, min_words), anchors(words, min_words)
    ends = np.searchsorted(of, np.arange(len(texts)), "right").tolist()
    out = []
    for lo, hi in zip([0, *ends], ends, strict=False):
        upto = max(lo, hi - min_words + 1)
        out.append(Text(words[lo:hi], every[lo:upto], least[lo:upto], min_words))
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two sequences have in common at their start."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at : min(n, at + step)] != b[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def _block(earlier: Text, later: Text, x: int, y: int) -> tuple[int, int]:
    """The words of the later text around ``y`` that are those around ``x`` of the earlier one."""
    a, b = earlier.words, later.words
    return y - _alike(a[:x][::-1], b[:y][::-1]), y + _alike(a[x:], b[y:])


def common_blocks(earlier: Text, later: Text) -> list[tuple[int, int]]:
    """Blocks (first word, word after the last) of the later text that cover all windows the earlier one holds."""
    if _alike(earlier.words, later.words) == len(later.words):  # nothing but the head of the earlier one
        return [(0, len(later.words))] if len(later.windows) else []
    if len(earlier.windows) >= len(later.windows):
        known, there = earlier.places(later.windows)
        left = np.flatnonzero(known)
    else:
        known, left = later.places(earlier.windows)
        there = np.flatnonzero(known)
    blocks: list[tuple[int, int]] = []
    if not len(left):
        return blocks
    size, at = later.size, earlier.starts(there)
    lines = earlier.windows[at].tolist()
    while len(left):
        here = later.starts(left)
        pairs = patience(lines, later.windows[here].tolist())
        if not pairs:
            break
        upto, slope = -1, None
        for i, j in pairs:
            x, y = int(at[i]), int(here[j])
            if x - y != slope or y + size > upto:  # else it lies in the block before
                blocks.append(_block(earlier, later, x, y))
                upto, slope = blocks[-1][1], x - y
        left = left[~_inside(left, blocks, size)]
    if len(left):
        places = there[np.argsort(earlier.windows[there], kind="stable")]
        keys, k = earlier.windows[places], 0
        while k < len(left):  # nothing left that stands once in both
            y = int(left[k])
            blocks.append(_block(earlier, later, int(places[np.searchsorted(keys, later.windows[y])]), y))
            k = max(k + 1, int(np.searchsorted(left, blocks[-1][1] - size + 1)))
    return blocks


def _inside(places: np.ndarray, blocks: list[tuple[int, int]], size: int) -> np.ndarray:
    """Whether the windows at ``places`` lie inside a block."""
    lo, hi = np.array(sorted(blocks)).T
    k = np.searchsorted(lo, places, "right") - 1
    return (k >= 0) & (np.maximum.accumulate(hi)[np.maximum(k, 0)] >= places + size)


def _aligned(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Blocks to delete, as first word * 2^32 + word after the last; each group comes with its longer text first."""
    group, held = None, None
    for batch in slices(batches, most=SLICE_BYTES):
        rows, spans = [], []
        columns = (batch.column(c).to_pylist() for c in ("hub", "part", "other", "place"))
        for hub, part, other, place, mine in zip(*columns, parsed(batch.column("text").to_pylist(), min_words), strict=True):
            if not other:
                group, held = (hub, part), mine
                continue
            if group != (hub, part):
                raise ValueError("a group without its longer text")
            blocks = common_blocks(held, mine) if place > hub else common_blocks(mine, held)
            rows += [max(place, hub)] * len(blocks)
            spans += [lo << 32 | hi for lo, hi in blocks]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, pa.int64())], ["row", "span"])


def candidates(read: DataFrame, *, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """Pairs (later, earlier) of documents so that each window of a later document that an earlier one holds is in a pair."""
    found = saved(read.mapInArrow(lambda b: _lines(b, min_words), "place long, anchor long, key long"), "lines")
    same = F.min("key") == F.max("key")
    shared = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), same.alias("same"))
    shared = saved(shared.where("first < last").select("anchor", "first", "same", (F.col("n") <= rare).alias("rare")), "shared")
    held = saved(found.join(shared, "anchor").where("not same or place > first").select("place", "anchor", "first", "same", "rare"), "held")
    # lists of at most ``rare`` holders
    few = held.where("not same and rare").groupBy("anchor").agg(F.sort_array(F.collect_set("place")).alias("holders")).where("size(holders) > 1")
    few = few.select(F.explode("holders").alias("later"), "holders").select("later", F.explode(F.filter("holders", lambda h: h < F.col("later"))).alias("earlier"))
    # lists of one document, at most as long as its text
    mine = held.where("not same and not rare").groupBy(F.col("place").alias("of")).agg(F.collect_set("anchor").alias("anchors"))
    again = read.join(mine.hint("merge"), read["place"] == mine["of"]).select("place", "text", "anchors")
    window = saved(again.mapInArrow(lambda b: _windows(b, min_words), "place long, key long"), "windows")
    common = window.groupBy("key").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").select("key", "first")
    single = window.join(saved(common, "common"), "key").where("place > first")
    first = held.where("same").unionByName(single, allowMissingColumns=True).select(F.col("place").alias("later"), F.col("first").alias("earlier"))
    return first.unionByName(few).distinct()


def deletions(rows: DataFrame, key: str, *, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """(row, cut): blocks of each document that earlier ones hold, for documents that have any; ``key`` is a whole number in document order."""
    small_batches(rows)
    read = rows.select(F.col(key).alias("place"), text_of(rows).alias("text"))
    pairs = saved(candidates(read, min_words=min_words, rare=rare), "pairs")
    size = read.select("place", F.octet_length("text").alias("bytes"))
    sized = pairs.join(size.toDF("later", "later_bytes"), "later").join(size.toDF("earlier", "earlier_bytes"), "earlier")
    longer = F.col("later_bytes") > F.col("earlier_bytes")
    sized = saved(
        sized.select(
            F.when(longer, F.col("later")).otherwise(F.col("earlier")).alias("hub"), F.when(longer, F.col("earlier")).otherwise(F.col("later")).alias("place"),
            F.greatest("later_bytes", "earlier_bytes").cast("long").alias("most"), F.least("later_bytes", "earlier_bytes").cast("long").alias("bytes"),
        ),
        "sized",
    )
    parts = F.ceil(F.sum("bytes") / F.greatest(F.max("most"), F.lit(GROUP_BYTES)))
    hubs = sized.groupBy("hub").agg(parts.alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("place"), F.coalesce("parts", F.lit(1)))
    others = saved(sized.join(hubs, "hub", "left").select("hub", part.alias("part"), F.lit(True).alias("other"), "place"), "others")
    asked = others.unionByName(others.select("hub", "part").distinct().select("hub", "part", F.lit(False).alias("other"), F.col("hub").alias("place")))
    # a shuffled join at every size: the side of the pairs grows with the documents
    texts = asked.hint("merge").join(read, "place").repartition("hub", "part").sortWithinPartitions("hub", "part", "other")
    blocks = texts.select("hub", "part", "other", "place", "text").mapInArrow(lambda b: _aligned(b, min_words), "row long, span long")
    return blocks.groupBy("row").agg(F.collect_set("span").alias("cut"))


def without(text: str, cut: np.ndarray, min_words: int = MIN_WORDS) -> tuple[str, int]:
    """The text without its windows ``cut``, and the number of lines that lost words."""
    places = np.flatnonzero(np.isin(windows(word_hashes(text), min_words), np.asarray(cut, np.int64).view(np.uint64)))
    return without_blocks(text, np.stack([places, places + min_words], 1))


def without_blocks(text: str, blocks: np.ndarray) -> tuple[str, int]:
    """The text without the words of ``blocks``, and the number of lines that lost words."""
    step = np.zeros(len(text) + 2, np.int32)
    np.add.at(step, blocks[:, 0], 1)
    np.add.at(step, blocks[:, 1], -1)
    gone = np.cumsum(step) > 0
    out, blank, after_gone, lost, k = [], [], False, 0, 0
    for line in text.split("\n"):
        n = len(line.split())
        if not n:
            blank.append(line)
            continue
        drop, k = gone[k : k + n], k + n
        some, every = bool(drop.any()), bool(drop.all())
        lost += some
        # blank lines between two deleted lines belong to the deleted passage
        out += [] if after_gone and every else blank
        blank, after_gone = [], every
        if not every:
            out.append(_rest(line, [m.span() for m in _word.finditer(line)], drop.tolist()) if some else line)
    left = "\n".join(out + blank)
    return left if left.strip() else "", lost


def _rest(line: str, spans: list[tuple[int, int]], drop: list[bool]) -> str:
    """The kept words of a line with the spaces between them, and one space where others stood."""
    starts = [i for i in range(len(spans)) if not drop[i] and (i == 0 or drop[i - 1])]
    ends = [i for i in range(len(spans)) if not drop[i] and (i + 1 == len(spans) or drop[i + 1])]
    return " ".join(line[spans[a][0] if a else 0 : spans[b][1] if b + 1 < len(spans) else len(line)] for a, b in zip(starts, ends, strict=True))


def _shortened(text: Column, cut: Column) -> Column:
    @F.pandas_udf("text string, lines int")
    def left(text: pd.Series, cut: pd.Series) -> pd.DataFrame:
        done = [(None, 0) if c is None else without_blocks(t, np.stack([c >> 32, c & (2**32 - 1)], 1)) for t, c in zip(text, cut, strict=True)]
        return pd.DataFrame(done, columns=["text", "lines"]).astype({"text": object})

    # only texts with blocks to delete go to Python;
    # not deterministic for the planner: a filter on the result must not compute it a second time
    return left.asNondeterministic()(F.when(cut.isNotNull(), text), cut)


def shortened(docs: DataFrame, **options) -> tuple[DataFrame, str]:
    """``docs`` with one column more and its name: the text without repeated passages, and the number of lines that lost words."""
    rows, key = keyed(docs, ordered=True)
    new, cut = fresh(rows, "new"), fresh(rows, "cut")
    cuts = saved(deletions(rows, key, **options), "cuts").toDF(key, cut)
    rows = rows.join(cuts.hint("merge"), key, "left").withColumn(new, _shortened(F.col("text"), F.col(cut)))
    left = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.col(new)["text"])
    return rows.withColumn(new, F.struct(left.alias("text"), F.col(new)["lines"].alias("lines"))), new


def line_deduplicated(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text, removed_lines) of each row of ``docs``; lines that lost only some of their words count as well."""
    rows, new = shortened(docs, **options)
    return rows.select("doc_id", F.coalesce(F.col(new)["text"], F.lit("")).alias("text"), F.col(new)["lines"].alias("removed_lines"))


def emptied(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with shortened texts and all other columns as they were; rows of which nothing is left go."""
    rows, new = shortened(docs, **options)
    rows = rows.where((F.col(new)["lines"] == 0) | (F.col(new)["text"] != ""))
    return rows.select(*[F.col(new)["text"].alias(c) if c == "text" else F.col(c) for c in docs.columns])
