"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets the fractional number of copies its source's target asks for. Within one source, two documents
with fractional parts at a time exchange mass (words, so that the source's words stay as they are) in a random
direction, chosen so that expectations hold, until one part is 0 or 1. That runs in many small groups at once; each
group hands on at most one undecided document, and groups of those are settled again, level by level, until one is
left per source, which is drawn by itself. So a source's words miss its target by one document's size at most.

Defined results: a missing text has size 0, and a document of size 0 gets no copy; missing sources form one source,
the last one; repeated rows and ids are rounded row by row; an empty table gives an empty mix. Draws depend on the
seed, the row keys and the table's size alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import WORD, fresh, keyed, saved, text_of

#: Documents settled together by one task step, and undecided documents settled together on each level above.
GROUP_ROWS = 20_000
FAN_IN = 64
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(docs: DataFrame) -> Column:
    return F.regexp_count(text_of(docs), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size).

    ``share`` of all words is dealt by weight; a source takes ``most`` times its own words at most, and what is cut
    off goes to the others by weight. The level at which that settles is found in one pass: sources are ordered by
    how soon they are full, and the first place from which on nobody is above its limit decides (later ones give less). One row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    named = by_source.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = named.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * float(most)).withColumn("total", F.sum("source_size").over(everything) * float(share))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levelled = weighed.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    return levelled.select("source", "source_size", F.coalesce(F.least(F.max("level").over(everything) * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def _pivot(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Settle all rows of one group but one at most. ``part`` becomes 0 or 1, or stays fractional for that one."""
    rows = rows.sort_values(["draw", "row"], kind="stable")
    size, part = rows["size"].to_numpy(float), rows["part"].to_numpy(float).copy()
    rng = np.random.default_rng(xxhash.xxh64_intdigest(f"{seed}|{rows['source'].iloc[0]}|{rows['level'].iloc[0]}|{rows['bucket'].iloc[0]}"))
    coin = rng.random(len(rows)).tolist()
    held = -1
    sizes, parts = size.tolist(), part.tolist()
    for i in range(len(parts)):
        if not 0.0 < parts[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        p, q, a, b = parts[held], parts[i], sizes[held], sizes[i]
        up, down = min((1.0 - p) * a, q * b), min(p * a, (1.0 - q) * b)
        move = up if coin[i] * (up + down) < down else -down
        p, q = p + move / a, q - move / b
        parts[held], parts[i] = (round(x) if abs(x - round(x)) < 1e-9 else x for x in (p, q))
        held = held if 0.0 < parts[held] < 1.0 else i if 0.0 < parts[i] < 1.0 else -1
    return rows.assign(part=parts)


def rounded(rows: DataFrame, *, seed: int) -> DataFrame:
    """(row, part) with ``part`` 0 or 1, from (row, source, size, part): fractional parts below 1 of documents with words."""
    n = rows.count()
    schema = "row long, source string, size long, part double, draw long, level int, bucket long"
    groups = max(1, -(-n // GROUP_ROWS))
    level = 0
    open_rows = rows.withColumn("draw", F.xxhash64("row", F.lit(seed))).withColumn("level", F.lit(0)).withColumn("bucket", F.pmod("draw", F.lit(groups)))
    settled = None
    while True:
        last = groups == 1
        done = saved(open_rows.groupBy("source", "bucket").applyInPandas(lambda g: _pivot(g, seed), schema), f"level{level}")
        whole = done.where("part in (0, 1)") if not last else done
        settled = whole if settled is None else settled.unionByName(whole)
        if last:
            break
        groups, level = -(-groups // FAN_IN), level + 1
        open_rows = done.where("part not in (0, 1)").withColumn("level", F.lit(level)).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
    # the last undecided document of a source: its own draw, uniform by hash
    luck = F.pmod(F.xxhash64("row", F.lit(seed), F.lit("last")), F.lit(1 << 30)) / float(1 << 30)
    return settled.select("row", F.when(F.col("part").isin(0.0, 1.0), F.col("part")).otherwise((luck < F.col("part")).cast("double")).cast("int").alias("part"))


def copies(docs: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17) -> tuple[DataFrame, DataFrame, str]:
    """(plan, documents with a row key, that key's name); plan: (row, doc_id, source, size, source_size, target, copies)."""
    rows, key = keyed(docs)
    sizes = saved(rows.select(F.col(key).alias("row"), rows["doc_id"].alias("doc_id"), rows["source"].cast("string").alias("source"), word_count(rows).alias("size")), "sizes")
    goal = targets(sizes, weights=weights, share=share, most=most)
    # a null-safe match on the source; there is one row per source
    aimed = sizes.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aimed = aimed.withColumn("whole", F.floor(rate)).withColumn("part", rate - F.floor(rate))
    open_rows = aimed.where("part > 0").select("row", "source", "size", "part")
    plan = aimed.join(rounded(open_rows, seed=seed).withColumnRenamed("part", "more"), "row", "left")
    return plan.select("row", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.coalesce("more", F.lit(0))).alias("copies")), rows, key


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it."""
    plan, rows, key = copies(docs, **options)
    nth = fresh(rows, "copy_number")
    chosen = plan.where("copies > 0").select(F.col("row").alias(key), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(nth))
    return rows.join(chosen, key).select(*docs.columns)
