"""Posting lists of tags in blocks with bounds: voted retrieval that scores importance without a row per vote.

Every tag has the list of its facts, ordered by cell of their vectors and by time, cut into blocks of ``BLOCK`` facts. A
block carries what bounds the value of its facts from above: the cells it touches with their radius, the fewest tags of a
fact, the most distinct tags per counted tag, and its oldest and newest time.

A search ranks the blocks of a query's chosen tags by that bound. A fact that several chosen tags hold is counted at its
heaviest one only, so in the list of a query's j-th heaviest tag no fact gathers more weight than the tags from j on
can give. The best ``FIRST`` blocks of each query and its direct hits are scored first; their k-th value then says which other
blocks can still hold a better fact, and only those are opened. The rows are those of scoring every vote; rows formed are
bounded by the blocks opened.

The components of the value function have to be monotone, rising or falling, as bounds are taken at the ends of a block's
ranges. Defined results: facts without a vector have relevance 0, as zero vectors do; a fact without a time cannot be
chosen by a value that reads recency; facts without tags, and queries without chosen tags, take part by direct hits only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.functions.value import Component, ValueFunction
from mnemolake.functions.vector import cosine
from mnemolake.operators import vector_index
from mnemolake.operators.ordered import number_rows
from mnemolake.operators.retrieve import DIRECT_WEIGHT, GQ, graph_clock
from mnemolake.operators.similarity import _matrix

BLOCK = 256
FIRST = 8
LIST = ["graph_id", "tag_id", "block"]


def _angles(queries: DataFrame, centres: np.ndarray) -> DataFrame:
    """``queries`` with the angle to every centre; null where the vector is missing or zero."""
    shared = queries.sparkSession.sparkContext.broadcast(centres)  # vector_index.CELLS rows at most
    out = T.StructType([*queries.schema, T.StructField("angles", T.ArrayType(T.FloatType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles: list = [None] * batch.num_rows
            there = np.flatnonzero(batch.column("embedding").is_valid().to_numpy(zero_copy_only=False))
            if len(there) and len(shared.value):
                matrix, norms = _matrix(batch.column("embedding").take(pa.array(there)))
                near = np.arccos(np.clip(vector_index._unit(matrix, norms) @ shared.value.T, -1, 1)).astype(np.float32)
                for i, row, length in zip(there, near, norms):
                    angles[i] = row if length > 0 else None
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angles, pa.list_(pa.float32()))], [*batch.schema.names, "angles"])

    return queries.mapInArrow(measure, out)


def _at_most(fn: Component | None, low: Column) -> Component | None:
    """A monotone component as its maximum between ``low`` and the argument."""
    return None if fn is None else lambda high: F.greatest(fn(low), fn(high))


class VotePostings:
    """Stored lists: ``facts`` with vectors and tags, ``postings`` (one row per block), ``centres``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.facts = spark.read.parquet(f"{self.path}/facts")
        self.postings = spark.read.parquet(f"{self.path}/postings")
        rows = spark.read.parquet(f"{self.path}/centres").orderBy("cell").toArrow()  # vector_index.CELLS rows at most
        self.centres = _matrix(rows["centre"])[0]

    @classmethod
    def write(cls, facts: DataFrame, path: str, *, block: int = BLOCK, cells: int | None = None) -> VotePostings:
        """Lists over ``facts`` (graph_id, semantic_id, embedding, tags, tag_ids, time)."""
        spark = facts.sparkSession
        rows = facts.select(
            "graph_id", "semantic_id", "embedding", F.array_distinct("tag_ids").alias("tag_ids"),
            F.greatest(F.lit(1), F.size("tags")).alias("n_tags"), F.col("time").cast("bigint").alias("time"),
        )
        centres, _ = vector_index.fit(rows, cells=cells)
        placed = vector_index.build(rows, centres)
        bare = rows.where(F.col("embedding").isNull()).select("*", F.lit(vector_index.ZERO_CELL).alias("cell"), F.lit(0.0).alias("angle"))
        placed.unionByName(bare).write.parquet(f"{path}/facts")
        stored = spark.read.parquet(f"{path}/facts")
        entry = stored.select("graph_id", F.explode("tag_ids").alias("tag_id"), "cell", "time", "semantic_id", "angle", "n_tags", F.size("tag_ids").alias("n_ids"))
        entry = entry.where(F.col("tag_id").isNotNull())
        numbered = number_rows(entry, ["graph_id", "tag_id"], ["cell", "time", "semantic_id"], "place", span=1)
        lists = numbered.groupBy("graph_id", "tag_id", F.floor(F.col("place") / block).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("cell", "angle", "semantic_id"))).alias("entries"),  # ``block`` entries at most
            F.count(F.lit(1)).alias("n"),
            F.min("n_tags").alias("fewest"),
            F.max(F.col("n_ids") / F.col("n_tags")).alias("ratio"),
            F.min("time").alias("oldest"),
            F.max("time").alias("newest"),
        )
        radius = lambda c: F.array_max(F.transform(F.filter("entries", lambda e: e["cell"] == c), lambda e: e["angle"]))
        lists.select(
            *LIST, "n", "fewest", "ratio", "oldest", "newest",
            F.transform(F.array_distinct(F.transform("entries", lambda e: e["cell"])), lambda c: F.struct(c.alias("cell"), radius(c).alias("radius"))).alias("cells"),
            F.transform("entries", lambda e: e["semantic_id"]).alias("ids"),
        ).write.parquet(f"{path}/postings")
        dim = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("centre", T.ArrayType(T.DoubleType()))])
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], dim).write.parquet(f"{path}/centres")
        return cls(spark, path)

    def _bounds(self, asked: DataFrame, value: ValueFunction, clock: DataFrame) -> DataFrame:
        """(graph_id, query_id, place, tag_id, block, n, bound) for every block of every chosen tag."""
        top = replace(
            value,
            relevance=_at_most(value.relevance, F.lit(-1.0)),
            importance=_at_most(value.importance, F.lit(0.0)),
            recency=_at_most(value.recency, F.col("now") - F.col("newest")),
        )
        # a cosine is highest where the query's angle to the centre, less the radius, is least; zero vectors have cosine 0
        slack = F.lit(vector_index.SLACK)
        reach = F.transform("cells", lambda c: F.when(F.col("angles").isNull() | (c["cell"] < 0), F.lit(0.0)).otherwise(
            F.cos(F.greatest(F.lit(0.0), F.get("angles", c["cell"]).cast("double") - c["radius"] - slack))))
        # the tags from the j-th heaviest on: together over the fewest tags, or at most the j-th's weight for each tag counted
        weight = F.get("weights", F.lit(0))
        together = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w) / F.col("fewest")
        heads = self.postings.drop("ids").join(clock, "graph_id", "left")
        tags = asked.select(*GQ, "angles", "chosen", F.posexplode("chosen").alias("place", "_tag")).select(
            *GQ, "angles", "place", F.col("_tag.tag_id").alias("tag_id"),
            F.transform(F.slice("chosen", F.col("place") + 1, F.size("chosen")), lambda t: -t["minus_weight"]).alias("weights"),
        )
        rows = tags.join(heads, ["graph_id", "tag_id"])
        total = top.score(F.array_max(reach), F.least(together, weight * F.col("ratio")), F.col("now") - F.col("oldest"))
        return rows.select(*GQ, "place", "tag_id", "block", "n", total.alias("bound"))

    def _scored(self, candidates: DataFrame, asked: DataFrame, value: ValueFunction, clock: DataFrame) -> DataFrame:
        """Value of candidates (graph_id, query_id, semantic_id, place; place null for direct hits), each fact at its heaviest tag."""
        nodes = self.facts.drop("cell", "angle").join(clock, "graph_id", "left").withColumn("recency", F.col("now") - F.col("time"))
        rows = candidates.join(nodes, ["graph_id", "semantic_id"]).join(asked.drop("angles").withColumnRenamed("embedding", "_asked"), GQ)
        heavier = F.transform(F.slice("chosen", F.lit(1), F.coalesce("place", F.lit(0))), lambda t: t["tag_id"])
        again = F.coalesce(F.arrays_overlap(heavier, F.col("tag_ids")), F.lit(False)) | F.coalesce(F.array_contains("direct", F.col("semantic_id")), F.lit(False))
        rows = rows.where(F.col("place").isNull() | ~again)
        own = F.filter("chosen", lambda t: F.coalesce(F.array_contains("tag_ids", t["tag_id"]), F.lit(False)))
        hit = F.when(F.col("place").isNull(), 1).otherwise(0)
        rows = rows.withColumn("_own", F.coalesce(own, F.slice("chosen", 1, 0))).withColumn("relevance", cosine(F.col("_asked"), F.col("embedding")))
        weight = F.coalesce(F.aggregate("_own", F.lit(0.0), lambda a, t: a - t["minus_weight"]), F.lit(0.0)) + hit * DIRECT_WEIGHT
        votes = F.coalesce(F.aggregate("_own", F.lit(0).cast("bigint"), lambda a, t: a + t["hit_votes"]), F.lit(0)) + hit
        rows = rows.select(*GQ, "semantic_id", "relevance", (weight / F.col("n_tags")).alias("importance"), votes.alias("tag_votes"), "recency")
        return rows.withColumn("value", F.round(value.score(F.col("relevance"), F.col("importance"), F.col("recency")), 12)).drop("recency")

    def _entries(self, blocks: DataFrame) -> DataFrame:
        return blocks.join(self.postings.select(*LIST, "ids"), LIST).select(*GQ, F.explode("ids").alias("semantic_id"), "place")

    def search(
        self, queries: DataFrame, chosen: DataFrame, direct: DataFrame, value: ValueFunction, *,
        clock: DataFrame | None = None, first: int = FIRST, scratch: str | None = None,
    ) -> tuple[DataFrame, DataFrame]:
        """Facts kept per query as ``retrieve.retrieve_semantic`` gives them, and every block of the chosen tags with ``opened``.

        ``chosen`` is the result of ``retrieve.choose_tags``, ``direct`` that of ``retrieve.direct_facts``. ``scratch``
        is a folder for the bounds and the first round, which the second reads again (default: next to the lists).
        """
        folder = scratch or f"{self.path}/search-{uuid.uuid4().hex}"
        clock = graph_clock(self.facts) if clock is None else clock

        def written(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{folder}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{folder}/{name}")

        tag = F.struct((-F.col("hit_weight").cast("double")).alias("minus_weight"), "tag_id", F.col("hit_votes").cast("bigint").alias("hit_votes"))
        lists = chosen.groupBy(*GQ).agg(F.sort_array(F.collect_list(tag)).alias("chosen"))  # the tags chosen for one query
        hits = direct.groupBy(*GQ).agg(F.collect_list("semantic_id").alias("direct"))
        asked = _angles(queries.select(*GQ, "embedding"), self.centres).join(lists, GQ, "left").join(hits, GQ, "left")
        asked = written(asked, "asked")
        best = Window.partitionBy(*GQ).orderBy(F.desc("value"), "semantic_id")
        cut = lambda rows: rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= value.k)

        bounds = written(self._bounds(asked, value, clock).where(F.col("bound") >= value.threshold - vector_index.SLACK), "bounds")
        order = Window.partitionBy(*GQ).orderBy(F.desc("bound"), "place", "block")
        opened = written(bounds.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= first).drop("_nth"), "first")
        start = self._entries(opened).unionByName(direct.select(*GQ, "semantic_id", F.lit(None).cast("int").alias("place")))
        found = written(cut(self._scored(start, asked, value, clock)).drop("rank"), "found")
        # a query with fewer than k facts so far has to open all that can pass the threshold
        kth = found.where(F.col("value").isNotNull()).groupBy(*GQ).agg(F.count(F.lit(1)).alias("_hits"), F.min("value").alias("_least"))
        left = bounds.join(opened, [*GQ, "tag_id", "block"], "left_anti").join(kth, GQ, "left")
        # equal values go to the lower id, so a block that can only tie is opened as well
        short = F.coalesce("_hits", F.lit(0)) < value.k
        more = written(left.where(short | (F.col("bound") >= F.col("_least") - vector_index.SLACK)).drop("_hits", "_least"), "second")
        rows = cut(found.unionByName(self._scored(self._entries(more), asked, value, clock))).where(F.col("value") >= value.threshold)
        every = asked.select(*GQ, F.explode("chosen.tag_id").alias("tag_id")).join(self.postings.select(*LIST, "n"), ["graph_id", "tag_id"])
        used = opened.unionByName(more).select(*GQ, "tag_id", "block", F.lit(True).alias("opened"))
        blocks = every.join(used, [*GQ, "tag_id", "block"], "left").withColumn("opened", F.coalesce("opened", F.lit(False)))
        return rows.select(*GQ, "semantic_id", "relevance", "importance", "tag_votes", "value", "rank"), blocks
