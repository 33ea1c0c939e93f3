"""Inverted-file index over vectors: exact search that stops early, and approximate search by probes.

Coarse centres are fitted on a bounded sample (``FIT_ROWS`` rows at most, those of least hash); every row is then put into the
cell of its nearest centre, by angle, with the angle between them. Stored, the index is partitioned by cell, so a
search reads the cells it asks for.

A search ranks the cells of a query's graph by the angle to their centres. The best ``probes`` are searched first, and
a cell cannot hold a vector closer than the angle to its centre less its radius (triangle inequality on the sphere). The
exact mode goes on with just the cells whose bound reaches the k-th value found so far, so results equal those
of a full search. The approximate mode stops after the probes. How many probes that takes follows the data: unless a
search says so, as many as find ``RECALL`` of the ten nearest neighbours of up to ``TRIED`` sampled rows among the sample. A
sample's neighbours lie farther off than those among all rows, so this errs to the safe side.

Rows without a vector are in no cell; zero vectors have a cell of their own, where every cosine is 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.operators.similarity import _matrix, nearest

FIT_ROWS = 1 << 16
CELLS = 1024
ROUNDS = 8
RECALL = 0.95
TRIED = 512
#: Queries that meet the cell list of their graph in one step.
QUERY_BLOCK = 4096
#: Slack for angles computed in floating point.
SLACK = 1e-6
ZERO_CELL = -1


def _unit(matrix: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return np.divide(matrix, norms[:, None], out=np.zeros_like(matrix), where=norms[:, None] > 0)


def fit(nodes: DataFrame, *, node_id: str = "semantic_id", vector: str = "embedding", cells: int | None = None, rows: int = FIT_ROWS) -> tuple[np.ndarray, int]:
    """Unit centres from at most ``rows`` vectors, about two per square root of their number unless ``cells`` says how many, and the probes they need."""
    sample = nodes.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(node_id), node_id).limit(rows).select(F.col(vector).alias("v")).toArrow()
    matrix, norms = _matrix(sample["v"])
    units = _unit(matrix, norms)[norms > 0]
    if not len(units):
        return np.zeros((0, matrix.shape[1])), 1
    wanted = min(len(units), cells or min(CELLS, max(1, int(np.sqrt(len(units)) * 2))))
    rng = np.random.default_rng(7)
    centres = units[rng.choice(len(units), wanted, replace=False)]
    for _ in range(ROUNDS):
        own = _nearest_centre(units, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
    return centres, _probes_needed(units, centres)


def _nearest_centre(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(units[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(units), 4096)])


def _probes_needed(units: np.ndarray, centres: np.ndarray, k: int = 10) -> int:
    """The fewest best cells that hold ``RECALL`` of the sampled rows' nearest neighbours, themselves aside."""
    own, tried = _nearest_centre(units, centres), min(TRIED, len(units))
    places = []
    for i in range(tried):
        cosines = units @ units[i]
        cosines[i] = -2.0
        near = np.argsort(-cosines)[: min(k, len(units) - 1)]
        order = np.argsort(-(centres @ units[i]), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        places.append(place[own[near]])
    found = np.sort(np.concatenate(places))
    return int(found[max(0, int(np.ceil(RECALL * len(found))) - 1)]) + 1 if len(found) else 1


def build(nodes: DataFrame, centres: np.ndarray, *, vector: str = "embedding") -> DataFrame:
    """``nodes`` with ``cell`` and ``angle`` (to the cell's centre), for every row that has a vector."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)  # CELLS rows at most
    nodes = nodes.where(F.col(vector).isNotNull())
    out = T.StructType([*nodes.schema, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix, norms = _matrix(batch.column(vector))
            if len(shared.value):
                cosines = _unit(matrix, norms) @ shared.value.T
                own = np.argmax(cosines, axis=1)
                angle = np.arccos(np.clip(cosines[np.arange(len(own)), own], -1, 1))
            else:
                own, angle = np.zeros(len(norms), np.int64), np.zeros(len(norms))
            cell = np.where(norms > 0, own, ZERO_CELL).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(np.where(norms > 0, angle, 0.0))], [*batch.schema.names, "cell", "angle"])

    return nodes.mapInArrow(assign, out)


class VectorIndex:
    """A stored index: ``vectors`` partitioned by cell, ``cells`` (graph_id, cell, n, radius), ``centres`` and the ``probes`` fitted."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.vectors = spark.read.parquet(f"{self.path}/vectors")
        self.cells = spark.read.parquet(f"{self.path}/cells")
        rows = spark.read.parquet(f"{self.path}/centres").orderBy("cell").toArrow()  # CELLS rows at most
        self.centres = _matrix(rows["centre"])[0]
        self.fitted_probes = spark.read.parquet(f"{self.path}/probes").first()["probes"]

    @classmethod
    def write(cls, nodes: DataFrame, path: str, *, node_id: str = "semantic_id", vector: str = "embedding", cells: int | None = None, rows: int = FIT_ROWS) -> VectorIndex:
        """Fit, assign and store ``nodes`` (graph_id, id, vector and whatever a search may filter by)."""
        spark = nodes.sparkSession
        centres, probes = fit(nodes, node_id=node_id, vector=vector, cells=cells, rows=rows)
        # a cell with very many rows gets several files
        build(nodes, centres, vector=vector).hint("rebalance", "cell").sortWithinPartitions("cell", "graph_id").write.partitionBy("cell").parquet(f"{path}/vectors")
        stored = spark.read.parquet(f"{path}/vectors")
        stored.groupBy("graph_id", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).write.parquet(f"{path}/cells")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
        spark.createDataFrame([(probes,)], "probes int").write.parquet(f"{path}/probes")
        return cls(spark, path)

    def probes(self, queries: DataFrame, *, most: int | None = None, skip: int = 0, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
        """(graph_id, query id, cell, n): the best ``most`` cells of each query's graph, or all but the ``skip`` best that reach its ``floor``."""
        blocks = queries.groupBy("graph_id").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
        left = queries.join(blocks, "graph_id").withColumn("block", F.pmod(F.xxhash64(query_id), F.col("blocks")).cast("int"))
        right = self.cells.join(blocks, "graph_id").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        shared = self.spark.sparkContext.broadcast(self.centres)
        kind = queries.schema[query_id]
        floors = "floor" in queries.columns

        def choose(asked: pa.Table, cells: pa.Table) -> pa.Table:
            names = ["graph_id", query_id, "cell", "n"]
            if not asked.num_rows or not cells.num_rows:
                return pa.table([asked["graph_id"][:0], asked[query_id][:0], pa.array([], pa.int32()), pa.array([], pa.int64())], names)
            matrix, norms = _matrix(asked[vector])
            cell, radius = cells["cell"].to_numpy(), cells["radius"].to_numpy()
            angle = np.full((len(norms), len(cell)), np.pi / 2)
            real = cell >= 0
            angle[:, real] = np.arccos(np.clip(_unit(matrix, norms) @ shared.value[cell[real]].T, -1, 1))
            bound = np.cos(np.maximum(0.0, angle - radius[None, :] - SLACK))
            bound[:, ~real] = 0.0
            bound[norms == 0] = 0.0
            order = np.argsort(angle, axis=1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(len(cell))[None, :], axis=1)
            wanted = place >= skip
            if most is not None:
                wanted &= place < most
            if floors:
                # equal values go to the lower id, so a cell that can only tie is searched as well
                wanted &= bound >= asked["floor"].to_numpy()[:, None] - SLACK
            i, j = np.nonzero(wanted)
            return pa.table([asked["graph_id"].take(pa.array(i)), asked[query_id].take(pa.array(i)), pa.array(cell[j], pa.int32()), cells["n"].take(pa.array(j))], names)

        needed = ["graph_id", "block", query_id, vector, *(["floor"] if floors else [])]
        grouped = left.select(*needed).groupBy("graph_id", "block").cogroup(right.select("graph_id", "block", "cell", "n", "radius").groupBy("graph_id", "block"))
        return grouped.applyInArrow(choose, T.StructType([queries.schema["graph_id"], kind, T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType())]))

    def _searched(self, queries: DataFrame, probes: DataFrame, k: int, node_id: str, query_id: str, vector: str, keep: str | None) -> DataFrame:
        asked = probes.drop("n").join(queries.select("graph_id", query_id, F.col(vector).alias("_asked")), ["graph_id", query_id])
        nodes = self.vectors if keep is None else self.vectors.where(keep)
        few = [r["cell"] for r in probes.select("cell").distinct().limit(257).collect()]
        if len(few) <= 256:
            nodes = nodes.where(F.col("cell").isin(few))  # prunes the files read
        found = nearest(asked, nodes, k=k, query_id=query_id, node_id=node_id, by=("graph_id", "cell"), query_vector="_asked", node_vector=vector, broadcast_rows=0)
        return found.select("graph_id", query_id, node_id, "relevance", "value")

    def search(self, queries: DataFrame, *, k: int, probes: int | None = None, exact: bool = True, node_id: str = "semantic_id", query_id: str = "query_id", vector: str = "embedding", keep: str | None = None, scratch: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The k best nodes of each query (columns of ``similarity.nearest``), and (graph_id, query id, cell, n) of the cells searched.

        ``keep`` is a condition on stored columns that hits must meet. ``scratch`` is a folder for the first round's
        results, which the second reads twice (default: next to the index).
        """
        probes = self.fitted_probes if probes is None else probes
        folder = scratch or f"{self.path}/search-{uuid.uuid4().hex}"
        asked = queries.where(F.col(vector).isNotNull()).select("graph_id", query_id, vector)

        def written(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{folder}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{folder}/{name}")

        best = Window.partitionBy("graph_id", query_id).orderBy(F.desc("value"), node_id)
        cut = lambda rows: rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        first = written(self.probes(asked, most=probes, query_id=query_id, vector=vector), "first")
        found = self._searched(asked, first, k, node_id, query_id, vector, keep)
        if not exact:
            return cut(found), first
        found = written(cut(found).drop("rank"), "found")
        # queries with fewer than k hits so far have to look everywhere
        kth = found.groupBy("graph_id", query_id).agg(F.count(F.lit(1)).alias("hits"), F.min("value").alias("least"))
        floor = F.when(F.col("hits") >= k, F.col("least")).otherwise(F.lit(-2.0))
        open_queries = asked.join(kth, ["graph_id", query_id], "left").withColumn("floor", F.coalesce(floor, F.lit(-2.0)))
        second = written(self.probes(open_queries, skip=probes, query_id=query_id, vector=vector), "second")
        more = self._searched(asked, second, k, node_id, query_id, vector, keep)
        return cut(found.unionByName(more)), first.unionByName(second)
