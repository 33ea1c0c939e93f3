"""Near duplicates by Order MinHash, verified by banded alignment.

A text is its lower-case words, and its k-mers are runs of five words, each labelled with its number of occurrence,
so that all k-mers of a text differ. One sketch takes the ``PICK`` smallest labelled k-mers under one hash and
keeps them in text order; two texts get the same sketch only if they share these k-mers in the same order, which
makes sketches sensitive to edit similarity rather than to shared vocabulary. ``SKETCHES`` sketches per text give
candidate buckets; at a similarity of 0.8 all of them differ for one pair in 90,000. Sketches of texts of few k-mers agree
less often, so those have exact buckets: sorted by value, the first k-mers of two texts that are more than a fifth of either
share one at least if 0.8 of all are common. Texts below ``SHORT`` k-mers and all that can be similar to them have such buckets.

Candidates are verified by aligning their labelled k-mers in order within a band: with m k-mers aligned, of n1 and
n2, the similarity is m / (n1 + n2 - m), a Jaccard similarity that counts only k-mers in order. It must reach 0.8.
That bounds how far aligned places can lie apart, so the band loses nothing.

Equal word sequences are folded before buckets are formed. In a bucket every text is first compared with one
leader, another one in each bucket; linked texts become one class. Buckets that then still hold several classes are
compared within, block by block, and give back only the links that join classes; the largest class of a bucket is
compared with the others, not with itself. So the classes are those of all candidate pairs, whatever the size of a bucket, and no pair of texts ever becomes a row.

Defined results: texts without any word are classes of their own; texts of fewer than five words have one k-mer,
the whole text; a missing text is an empty one; missing or repeated doc_ids and repeated rows are rows of their
own; of a class the smallest doc_id is kept (rows without one last); an empty table gives no row.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import keyed, saved, slices, small_batches, text_of
from mnemolake.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 16
PICK = 3
#: Below this many k-mers sketches do not count; see the module's text.
SHORT = 20
#: One pair of blocks holds at most twice this many texts and labelled k-mers (a single longer text is a block).
BLOCK_TEXTS = 256
BLOCK_KMERS = 1_000_000
#: Columns of one product.
TABLE = 4096
WORDS_HELD = 500_000
_words = re.compile(r"\w+")
_mixers = np.random.default_rng(20).integers(1, 2**63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_power = [pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(SHINGLE + 1)]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > WORDS_HELD:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def labelled(words: np.ndarray) -> np.ndarray:
    """The labelled k-mers of a sequence of word hashes, in text order, all different."""
    n = max(1, len(words) - SHINGLE + 1)
    kmers = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        kmers += _mix(words[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(_power[k])
    kmers = _mix(kmers + np.uint64(min(len(words), SHINGLE)))
    order = np.argsort(kmers, kind="stable")
    same = kmers[order]
    new = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    if len(new) < n:
        nth = np.empty(n, np.uint64)
        nth[order] = np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))
        kmers = np.where(nth > 0, _mix(kmers + nth * np.uint64(_power[1])), kmers)
    return kmers


def sketches(kmers: np.ndarray) -> np.ndarray:
    """One number per sketch: the smallest ``PICK`` k-mers under its hash, in text order."""
    out = np.empty(SKETCHES, np.uint64)
    # few rows at a time for very long texts: the table below stays small
    step = SKETCHES if len(kmers) < 100_000 else 1
    for a in range(0, SKETCHES, step):
        values = kmers[None, :] * _mixers[a : a + step, None]
        values ^= values >> np.uint64(32)
        picked = np.argpartition(values, PICK - 1, axis=1)[:, :PICK] if len(kmers) > PICK else np.tile(np.arange(len(kmers)), (step, 1))
        ordered = kmers[np.sort(picked, axis=1)]
        value = np.arange(a + 1, a + 1 + step, dtype=np.uint64) * np.uint64(_power[2])
        for k in range(ordered.shape[1]):
            value = _mix(value * np.uint64(_power[1]) + ordered[:, k])
        out[a : a + step] = value
    return out


def first_kmers(kmers: np.ndarray) -> np.ndarray:
    """A bucket for each of the smallest k-mers, as many as make a common one certain at the threshold."""
    n = len(kmers)
    return _mix(np.sort(kmers)[: n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1] * np.uint64(_power[3]) + np.uint64(1))


def buckets(kmers: np.ndarray) -> np.ndarray:
    exact = first_kmers(kmers) if len(kmers) <= SHORT / SIMILARITY else kmers[:0]
    return exact if len(kmers) < SHORT else np.concatenate([exact, sketches(kmers)])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Hashes()
    for batch in slices(batches):
        content, count, bands, blobs = [], [], [], []
        for text in batch.column("text").to_pylist():
            words = np.array([held[w] for w in _words.findall(text.lower())], np.uint32)
            blob = words.tobytes()
            content.append(xxhash.xxh3_128_hexdigest(blob) if len(words) else None)
            count.append(max(1, len(words) - SHINGLE + 1) if len(words) else 0)
            bands.append(buckets(labelled(words)).view(np.int64) if len(words) else np.zeros(0, np.int64))
            blobs.append(blob)
        bounds = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
        columns = [batch.column("row"), batch.column("doc_id"), pa.array(content, pa.string()), pa.array(count, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "content", "n", "bands", "words"])


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Most labelled k-mers that can be aligned in order inside the band a similarity of 0.8 allows."""
    band = int((1 - SIMILARITY) / (1 + SIMILARITY) * (len(a) + len(b))) + 1
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    place = order[at]
    hit = (b[place] == a) & (np.abs(place - np.arange(len(a))) <= band)
    tails: list[int] = []
    for x in place[hit].tolist():  # all places differ: the longest rising run is the longest alignment
        if not tails or x > tails[-1]:
            tails.append(x)
        else:
            tails[bisect_left(tails, x)] = x
    return len(tails)


def similarity(a: bytes, b: bytes) -> float:
    x, y = labelled(np.frombuffer(a, np.uint32)), labelled(np.frombuffer(b, np.uint32))
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return 0.0
    m = aligned(x, y)
    return m / (len(x) + len(y) - m)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [similarity(a, b) for a, b in zip(batch.column("words_a").to_pylist(), batch.column("words_b").to_pylist(), strict=True)]
        good = pa.array([v >= SIMILARITY - 1e-12 for v in values])
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(values)], ["a", "b", "similarity"]).filter(good)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) that reach the threshold; ``texts``: (row, words)."""
    one = pairs.join(texts.select(F.col("row").alias("a"), F.col("words").alias("words_a")), "a")
    both = one.join(texts.select(F.col("row").alias("b"), F.col("words").alias("words_b")), "b")
    return both.select("a", "b", "words_a", "words_b").mapInArrow(_verified, "a long, b long, similarity double")


def shared_kmers(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many labelled k-mers each text of ``a`` has in common with each of ``b``, by products of narrow 0/1 tables."""
    kmers, column = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    first = row < len(a)
    both = np.bincount(column[first], minlength=len(kmers)).astype(bool) & np.bincount(column[~first], minlength=len(kmers)).astype(bool)
    place = np.cumsum(both) - 1
    keep = both[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, int(both.sum()), TABLE):
        s, e = np.searchsorted(column, (lo, lo + TABLE))
        table = np.zeros((len(a) + len(b), TABLE), np.float32)
        table[row[s:e], column[s:e] - lo] = 1
        out += table[: len(a)] @ table[len(a) :].T
    return out.astype(np.int64)


def block_links(members: list[tuple[int, int, int, bytes]], crossing: bool) -> Iterator[tuple[int, int, float]]:
    """Links that join classes of one pair of blocks: (row, row, similarity), fewer than there are texts.

    ``members``: (side, row, label, words). Only texts of different classes are aligned, and a class that was
    joined on the way counts as one, so copies of copies add no links.
    """
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    kmers = [labelled(np.frombuffer(m[3], np.uint32)) for m in members]
    left = [i for i, m in enumerate(members) if m[0] == 0]
    right = [i for i, m in enumerate(members) if m[0] == 1] if crossing else left
    if not left or not right:
        return
    common = shared_kmers([kmers[i] for i in left], [kmers[i] for i in right])
    n = np.array([len(k) for k in kmers])
    total = n[left][:, None] + n[right][None, :] - common
    # a share of common k-mers below the threshold cannot reach it in order either
    near = common >= SIMILARITY * total - 1e-9
    for x, y in zip(*np.nonzero(near if crossing else np.triu(near, 1)), strict=True):
        i, j = left[x], right[y]
        p, q = find(members[i][2]), find(members[j][2])
        if p == q:
            continue
        m = aligned(kmers[i], kmers[j])
        value = m / (len(kmers[i]) + len(kmers[j]) - m)
        if value >= SIMILARITY - 1e-12:
            parent[p] = q
            yield members[i][1], members[j][1], value


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (band, i, j): one pair of blocks after the other."""
    at, members, found = None, [], []

    def closed() -> None:
        if at is not None and len({m[2] for m in members}) > 1:
            found.extend(block_links(members, at[1] != at[2]))

    for batch in batches:
        for band, i, j, *member in zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j", "side", "row", "label", "words")), strict=True):
            if (band, i, j) != at:
                closed()
                at, members = (band, i, j), []
            members.append(tuple(member))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "similarity"])
            found = []
    closed()
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "similarity"])


def rest_links(member: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between texts of one bucket that star comparisons left in different classes.

    A bucket is cut into blocks of bounded size, and each pair of blocks is one step of a task: the k-mers its texts
    have in common are counted by small matrix products, pairs that can reach the threshold are aligned, and only
    links that join two classes leave the step. No pair of texts is ever a row.
    """
    named = member.join(labels, "row")
    per_class = named.groupBy("band", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("kmers"))
    most = per_class.groupBy("band").agg(F.max(F.struct("m", "kmers", "label")).alias("top"), F.count(F.lit(1)).alias("classes"), F.sum("m").alias("m"), F.sum("kmers").alias("kmers")).where("classes > 1")
    cut = lambda m, kmers: F.ceil(F.greatest(m / BLOCK_TEXTS, kmers / BLOCK_KMERS)).cast("int")
    rest = cut(F.col("m") - F.col("top.m"), F.col("kmers") - F.col("top.kmers"))
    sizes = most.select("band", F.col("top.label").alias("crowd"), rest.alias("few"), cut(F.col("top.m"), F.col("top.kmers")).alias("many"))
    # blocks of the other classes come first, then those of the largest class, which meet only the former
    inside = F.col("label") == F.col("crowd")
    draw = F.xxhash64("row")
    block = F.when(inside, F.col("few") + F.pmod(draw, F.col("many"))).otherwise(F.pmod(draw, F.col("few"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1))
    spread = named.join(sizes, "band").select("band", "row", "label", block.alias("block"), other.alias("other"))
    spread = spread.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "row", "label")
    carried = spread.join(texts.select("row", "words"), "row").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return carried.select("band", "i", "j", "side", "row", "label", "words").mapInArrow(_block_links, "a long, b long, similarity double")


def _labels(links: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, label): the least row of each connected class."""
    found = components(links.select("a", "b")).withColumnRenamed("label", "component")
    return rows.join(found, "row", "left").select("row", F.coalesce("component", "row").alias("label"))


def classes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, class_row, class_id, class_size, kept) for each row of ``docs`` keyed as by ``keyed``."""
    rows, key = keyed(docs)
    return row_classes(rows, key)


def row_classes(rows: DataFrame, key: str) -> DataFrame:
    small_batches(rows)
    read = rows.select(F.col(key).alias("row"), rows["doc_id"].cast("bigint").alias("doc_id"), text_of(rows).alias("text"))
    prints = saved(read.mapInArrow(_fingerprints, "row long, doc_id long, content string, n long, bands array<long>, words binary"), "prints")
    folded = saved(prints.where("content is not null").groupBy("content").agg(F.min("row").alias("leader")), "folded")
    leaders = folded.select(F.col("leader").alias("row"))
    texts = prints.select("row", "words")
    member = prints.select("row", "n", "bands").join(leaders, "row", "left_semi").select("row", "n", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("band")
    member = saved(member.join(shared, "band"), "buckets")
    # one leader stands for each bucket, another one in each
    leader = member.groupBy("band").agg(F.min(F.struct(F.xxhash64("row", "band").alias("draw"), "row", "n")).alias("leader"))
    toward = member.join(leader, "band").where("row <> leader.row")
    least, most = (f(F.struct("n", "row"), F.struct("leader.n", "leader.row")) for f in (F.least, F.greatest))
    toward = toward.select(least.alias("least"), most.alias("most")).where(F.col("least.n") >= F.col("most.n") * SIMILARITY)
    stars = saved(verified(toward.select(F.col("least.row").alias("a"), F.col("most.row").alias("b")).distinct(), texts), "stars")
    labels = saved(_labels(stars, leaders), "labels")
    links = stars.unionByName(saved(rest_links(member, labels, texts), "rest"))
    labels = _labels(links, leaders)
    named = prints.select("row", "doc_id", "content").join(folded, "content", "left").join(labels.select(F.col("row").alias("leader"), "label"), "leader", "left")
    named = saved(named.select("row", "doc_id", F.coalesce("label", "row").alias("class_row")), "named")
    last = F.lit(2**63 - 1)
    best = named.groupBy("class_row").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("o"), F.col("row"), F.col("doc_id"))).alias("best"), F.count(F.lit(1)).alias("class_size"))
    return named.join(best, "class_row").select("row", "doc_id", "class_row", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("best.row") == F.col("row")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, all columns as they were."""
    rows, key = keyed(docs)
    kept = row_classes(rows, key).where("kept").select(F.col("row").alias(key))
    return rows.join(kept, key, "left_semi").select(*docs.columns)
