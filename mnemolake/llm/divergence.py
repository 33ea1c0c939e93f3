"""How sources of one language differ in their terms: one-hot level products, and the terms that mark a source.

A group is a (language, source), a term's level in a group is its count there, and a level has one probability, so
the divergence of two groups needs only the joint table of their levels: how many terms have level i here and level
j there. Terms of a language are cut into blocks of bounded size, terms of like frequency together. A block is a matrix with one
row per term and one indicator column per (group, level), level zero included; the product with its transpose holds
every joint table of the block, exact as counts stay far below 2^24. Each entry is priced in 64-bit integers and
summed by pair of groups, and sums of blocks add up. With many sources a block is cut into tiles of groups, and each
pair of tiles is a product of its own.

All arithmetic is exact: probabilities are billionths, in decimals where counts could pass 64 bits; a divergence sum is at most
(10^9 + terms)^2 and fits 64 bits.

Defined results: missing text, lang and source are read as ''; a group without terms takes part with counts of zero;
a language without kept terms has divergences of 0 and no term rows; repeated rows and ids count as documents of
their own; an empty table gives no row. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import saved, slices, small_batches, text_of

MIN_DOCUMENTS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000
#: Terms of a block, groups of a tile, columns of one product.
TERMS = 1024
TILE = 32
COLUMNS = 4096
#: (group, term) counts a task holds before it hands them on.
HELD = 300_000
#: Fixed by the data contract: letters and all that is not ASCII make terms, A-Z in lower case; the rest separates.
LETTERS = bytes(ord(chr(i).lower()) if chr(i).isalpha() else 32 for i in range(128)) + bytes(range(128, 256))
COUNTS = "lang string, source string, term string, n long, documents long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms by group, with occurrences and documents, added up in the task as far as they fit."""
    n: dict[tuple[str, str], Counter] = defaultdict(Counter)
    documents: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in n.items():
            rows = len(counts)
            term = pa.array(list(counts), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * rows), pa.array([source] * rows), term, pa.array(list(counts.values()), pa.int64()), pa.array(list(documents[lang, source].values()), pa.int64())], ["lang", "source", "term", "n", "documents"])
        n.clear()
        documents.clear()

    for batch in slices(batches):
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            if found := terms_of(text):
                # both keep their keys in order of first sight, so that values stand side by side
                seen = dict.fromkeys(found).keys()
                n[lang, source].update(found)
                documents[lang, source].update(seen)
        if sum(map(len, n.values())) > HELD:
            yield from told()
    yield from told()


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), exact."""
    exact = lambda c, digits: c.cast(f"decimal({digits},0)")
    top = exact(F.lit(UNIT), 10) * exact(n + 1, 19)
    return F.call_function("div", top, exact(total + terms, 19)).cast("bigint") + 1


def _priced(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Each level of ``p`` against each of ``q``."""
    apart = p[:, None] - q[None, :]
    return apart * apart // q[None, :]


def block_sums(group: np.ndarray, term: np.ndarray, p: np.ndarray, groups: np.ndarray, zero: np.ndarray, terms: int, left: np.ndarray) -> dict[tuple[int, int], int]:
    """Divergence of each pair of groups over one block, by one-hot level products.

    ``group``, ``term``, ``p``: one entry per group and term that occurs in it. ``groups`` are all groups of the block in
    ascending order, ``zero`` what level zero means in each; ``terms`` counts all terms of the block. ``left``: which
    groups stand left; with all of them, every pair comes in both directions, otherwise pairs of a left and another group.
    """
    _, row = np.unique(term, return_inverse=True)
    here = int(row.max(initial=-1)) + 1
    level, column = np.unique(np.stack([np.searchsorted(groups, group), p]), axis=1, return_inverse=True)
    # columns: the levels that occur, then level zero of each group
    of, price = np.concatenate([level[0], np.arange(len(groups))]), np.concatenate([level[1], zero])
    hot = np.zeros((here, len(of)), np.float32)
    hot[row, column.ravel()] = 1
    hot[:, len(level[0]) :] = 1
    hot[row, len(level[0]) + np.searchsorted(groups, group)] = 0
    order = np.argsort(of, kind="stable")
    hot, of, price = hot[:, order], of[order], price[order]
    sums: dict[tuple[int, int], int] = defaultdict(int)
    both = bool(left.all())
    for i in np.flatnonzero(left).tolist():
        own = of == i
        for at in range(0, len(of), COLUMNS):
            part = slice(at, at + COLUMNS)
            joint = (hot[:, own].T @ hot[:, part]).astype(np.int64)
            firsts = np.flatnonzero(np.concatenate([[True], np.diff(of[part]) != 0]))
            forth = np.add.reduceat((joint * _priced(price[own], price[part])).sum(axis=0), firsts)
            back = None if both else np.add.reduceat((joint.T * _priced(price[part], price[own])).sum(axis=1), firsts)
            for k, j in enumerate(of[part][firsts].tolist()):
                if j != i and (both or not left[j]):
                    sums[i, j] += int(forth[k])
                    if back is not None:
                        sums[j, i] += int(back[k])
    # terms of the block that no group here holds
    if terms > here:
        for i, j in list(sums):
            apart = int(zero[i]) - int(zero[j])
            sums[i, j] += (terms - here) * (apart * apart // int(zero[j]))
    return sums


def _block(rows: pa.Table) -> pa.Table:
    lang, a, b = (rows[c][0].as_py() for c in ("lang", "ti", "tj"))
    sheet = rows["term"].is_null().to_numpy()
    group, p = rows["nth"].to_numpy(), rows["p"].to_numpy()
    order = np.argsort(group[sheet])
    groups, zero = group[sheet][order], p[sheet][order]
    term = rows["term"].filter(pa.array(~sheet)).dictionary_encode().combine_chunks()
    codes = term.indices.to_numpy() if isinstance(term, pa.DictionaryArray) else np.zeros(0, np.int64)
    terms = rows["terms"].filter(pa.array(sheet))[0].as_py()
    sums = block_sums(group[~sheet], codes, p[~sheet], groups, zero, terms, groups // TILE == a)
    pairs = [(int(groups[i]), int(groups[j]), v) for (i, j), v in sums.items()]
    columns = list(zip(*pairs, strict=True)) or [(), (), ()]
    return pa.table([pa.array([lang] * len(pairs), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["lang", "g", "h", "value"])


def pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, g, h, value) from counts (lang, nth, term, total, p) and groups (lang, nth, zero, tiles)."""
    band = F.floor(F.log2("total")).cast("int")
    banded = counts.withColumn("band", band)
    per_band = banded.select("lang", "term", "band").distinct().groupBy("lang", "band").agg(F.ceil(F.count(F.lit(1)) / TERMS).alias("slots"))
    slotted = saved(banded.join(per_band, ["lang", "band"]).withColumn("slot", F.pmod(F.xxhash64("term"), F.col("slots"))), "slotted")
    blocks = slotted.groupBy("lang", "band", "slot").agg(F.countDistinct("term").alias("terms"))
    # one row per group and block says what level zero means there
    sheet = blocks.join(groups, "lang").select("lang", "band", "slot", "nth", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"), "tiles", "terms")
    own = slotted.join(groups.select("lang", "nth", "tiles"), ["lang", "nth"]).select("lang", "band", "slot", "nth", "term", "p", "tiles", F.lit(None).cast("bigint").alias("terms"))
    tile = F.floor(F.col("nth") / TILE).cast("int")
    spread = own.unionByName(sheet).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select("lang", "band", "slot", F.least(tile, "other").alias("ti"), F.greatest(tile, "other").alias("tj"), "nth", "term", "p", "terms")
    found = spread.groupBy("lang", "band", "slot", "ti", "tj").applyInArrow(_block, "lang string, g long, h long, value long")
    return found.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, *, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): each group against the other groups of its language, and its marking terms."""
    small_batches(docs)
    none = F.lit("")
    named = docs.select(F.coalesce(docs["lang"].cast("string"), none).alias("lang"), F.coalesce(docs["source"].cast("string"), none).alias("source"), text_of(docs).alias("text"))
    counted = named.mapInArrow(_counts, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    counted = saved(counted, "counts")
    kept = counted.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("total")).where(F.col("documents") >= min_documents)
    kept = saved(kept.select("lang", "term", "total"), "kept")
    counts = saved(counted.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept_counts")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_words"))
    words = counts.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    groups = named.select("lang", "source").distinct().join(words, ["lang", "source"], "left").join(langs, "lang", "left")
    # one row per (language, source) from here to the sums
    order = Window.partitionBy("lang").orderBy("source")
    groups = groups.na.fill(0, ["words", "v", "lang_words"]).withColumn("nth", F.row_number().over(order).cast("bigint") - 1)
    groups = groups.withColumn("tiles", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / TILE).cast("int"))
    zero = F.when(F.col("v") > 0, probability(F.lit(0).cast("bigint"), F.col("words"), F.col("v")))
    groups = saved(groups.withColumn("zero", zero), "groups")
    levelled = counts.join(groups.select("lang", "source", "nth", "words", "v", "lang_words"), ["lang", "source"])
    levelled = levelled.withColumn("p", probability(F.col("n"), F.col("words"), F.col("v"))).withColumn("q", probability(F.col("total"), F.col("lang_words"), F.col("v")))
    levelled = saved(levelled.select("lang", "source", "nth", "term", "total", "p", "q"), "levels")

    sums = pair_sums(levelled.select("lang", "nth", "term", "total", "p"), groups.where("v > 0").select("lang", "nth", "zero", "tiles"))
    one = groups.select("lang", "source", F.col("nth").alias("g"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("nth").alias("h"))
    pairs = one.join(two, "lang").where("g <> h").join(sums, ["lang", "g", "h"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))
    marking = levelled.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    best = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(best))
    return ranked(pairs).unionByName(ranked(marking).where(F.col("rank") <= top_terms))
