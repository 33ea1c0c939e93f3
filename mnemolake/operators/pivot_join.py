"""Similarity join inside hot keys by pivots: a vector meets only the cells that can hold one close enough.

A key (a graph, or a tag of a graph) with many nodes is searched against itself by all its facts; plain blocks compare every
pair. Here pivots are fitted on a bounded sample (``vector_index.fit``), every node lies in the cell of its nearest pivot,
and a query meets the cells that the ball of its threshold can reach. Two bounds decide, and no pair at the threshold escapes them:

* the cell lies on the far side of the plane halfway between its pivot and the query's nearest one, and so does
  everything in it: the angle to that plane is above the threshold's;
* both are split into their part in the plane of those two pivots and a rest. The product of the parts is bounded by the
  range of the cell's products with the two pivots, that of the rests by their lengths. This holds far more apart than
  the triangle inequality where vectors have many directions to differ in.

Vectors travel by blocks, not by cells: the cells of a key, in an order that keeps close ones together, are laid end to end and
cut into blocks of the sizes of ``similarity.nearest`` on either side, and a row is copied once for every block of the other side
with a cell it may meet. So a search ships at most what the plain blocked search does, however many cells a query
reaches; inside a pair of blocks a query is compared with the cells it reaches and no others. A very large cell is many blocks.
Which cells meet is settled before on counts and bits per (key, cell), without vectors. Keys of at most ``few`` nodes are searched whole. Rows
equal those of ``nearest`` for every threshold above 0; how much is saved depends on how the vectors cluster, and ``compared`` counts it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mnemolake.functions.value import ValueFunction
from mnemolake.operators import vector_index
from mnemolake.operators.similarity import ALL_BLOCK, COSINE, NODE_BLOCK, QUERY_BLOCK, _best, _compact, _emit, _matrix, _side, nearest
from mnemolake.session import checkpointed

FEW = 4096
#: Queries whose bounds are worked out in one step.
_STEP = 1024


def _ranges(placed: DataFrame, centres: np.ndarray, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of every cell's unit vectors (rows) with every pivot (columns); an empty cell has none."""
    shared = placed.sparkSession.sparkContext.broadcast(centres)
    out = T.StructType([T.StructField("cell", T.IntegerType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("low", "high")]])

    def rows(kept: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        lists = [pa.array([kept[c][i] for c in kept], pa.list_(pa.float64())) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), *lists], ["cell", "low", "high"])

    def add(kept: dict[int, list[np.ndarray]], cell: int, low: np.ndarray, high: np.ndarray) -> None:
        held = kept.setdefault(cell, [low, high])
        held[0], held[1] = np.minimum(held[0], low), np.maximum(held[1], high)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            matrix, norms = _matrix(batch.column(vector))
            products, cells = vector_index._unit(matrix, norms) @ shared.value.T, batch.column("cell").to_numpy()
            for cell in np.unique(cells):
                own = products[cells == cell]
                add(kept, int(cell), own.min(axis=0), own.max(axis=0))
        yield rows(kept)

    def merge(table: pa.Table) -> pa.Table:
        kept: dict[int, list[np.ndarray]] = {}
        for cell, low, high in zip(table["cell"].to_pylist(), _matrix(table["low"])[0], _matrix(table["high"])[0]):
            add(kept, cell, low, high)
        return pa.Table.from_batches([rows(kept)])

    parts = placed.select(vector, "cell").where(F.col("cell") >= 0).mapInArrow(measure, out)
    found = parts.groupBy("cell").applyInArrow(merge, out).toArrow()  # vector_index.CELLS rows at most
    low, high = np.full((2, len(centres), len(centres)), np.nan)
    if found.num_rows:
        cells = found["cell"].to_numpy()
        low[cells], high[cells] = _matrix(found["low"])[0], _matrix(found["high"])[0]
    return low, high


def _places(centres: np.ndarray) -> np.ndarray:
    """Place of every centre on a walk that goes on to the nearest one left, so that neighbours in line lie close together."""
    places, left, at = np.zeros(len(centres), np.int64), np.ones(len(centres), bool), 0
    for i in range(len(centres)):
        places[at], left[at] = i, False
        at = int(np.argmax(np.where(left, centres @ centres[at], -np.inf)))
    return places


class _Bounds:
    """Which cells may hold a node at a floor or above for a query; sent to the tasks."""

    def __init__(self, centres: np.ndarray, low: np.ndarray, high: np.ndarray, floor: float):
        self.centres, self.low, self.high = centres, low, high
        # values are rounded to twelve digits before they meet the floor
        self.limit = float(np.arccos(np.clip(floor - 1e-12, -1, 1))) + vector_index.SLACK
        self.least = floor - vector_index.SLACK

    def near(self, matrix: np.ndarray, norms: np.ndarray, cells: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Queries (rows) by ``cells`` (columns); ``own`` is each query's nearest centre where that is known."""
        parts = [self._near(matrix[i : i + _STEP], norms[i : i + _STEP], cells, None if own is None else own[i : i + _STEP]) for i in range(0, len(norms), _STEP)]
        return np.concatenate(parts) if parts else np.zeros((0, len(cells)), bool)

    def _near(self, matrix: np.ndarray, norms: np.ndarray, cells: np.ndarray, own: np.ndarray | None) -> np.ndarray:
        if not len(self.centres) or not len(cells):
            return np.zeros((len(norms), len(cells)), bool)
        units = vector_index._unit(matrix, norms)
        if own is None:
            own = np.argmax(units @ self.centres.T, axis=1)
        own = np.maximum(own, 0)  # a query of length 0 has no cell, and reaches none
        pivots = self.centres[cells]
        a, b = np.einsum("ij,ij->i", units, self.centres[own])[:, None], units @ pivots.T
        g = np.clip(self.centres @ pivots.T, -1, 1)[own]
        low_b, high_b = self.low[cells, cells], self.high[cells, cells]  # of each cell: products with its own pivot
        rest_y = np.sqrt(1 - np.clip(low_b, 0, 1) ** 2)
        near = np.arcsin(np.clip((a - b) / np.sqrt(np.maximum(2 - 2 * g, 1e-300)), 0, 1)) <= self.limit
        # rounding counts for much between pivots that all but coincide, and for all of it in the query's own cell
        near |= (g > 1 - 1e-6) | (cells[None, :] == own[:, None])
        # the query as alpha * nearest pivot + beta * the cell's pivot + a rest orthogonal to both
        det = np.maximum(1 - g**2, 1e-6)
        alpha, beta = (a - g * b) / det, (b - g * a) / det
        rest_x = np.sqrt(np.clip(1 - alpha * a - beta * b, 0, 1))
        low_a, high_a = self.low[cells][:, own].T, self.high[cells][:, own].T
        bound = np.maximum(alpha * low_a, alpha * high_a) + np.maximum(beta * low_b, beta * high_b) + rest_x * rest_y
        # pivots that all but coincide span no plane
        near &= (bound >= self.least) | (g**2 > 1 - 1e-6)
        return near & (norms > 0)[:, None] & ~np.isnan(low_b)[None, :]


class PivotJoin:
    """Pivots with the ranges of their cells over ``nodes`` (graph_id, id, vector); searches must look among these nodes."""

    def __init__(self, nodes: DataFrame, *, node_id: str = "semantic_id", vector: str = "embedding", cells: int | None = None, few: int = FEW):
        self.few = few
        self.centres, _ = vector_index.fit(nodes, node_id=node_id, vector=vector, cells=cells)
        self.low, self.high = _ranges(vector_index.build(nodes.select(vector), self.centres, vector=vector), self.centres, vector)

    def _reached(self, queries: DataFrame, by: list[str], floor: float) -> DataFrame:
        """``by``, ``cell``, how many queries lie there, and as bits of words ``_w0``, ``_w1``, … the cells they may meet."""
        bounds = queries.sparkSession.sparkContext.broadcast(_Bounds(self.centres, self.low, self.high, floor))
        words = [f"_w{i}" for i in range(max(1, -(-len(self.centres) // 64)))]
        out = T.StructType([*[queries.schema[c] for c in (*by, "cell")], *[T.StructField(w, T.LongType()) for w in words]])

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every = np.arange(len(bounds.value.centres))
            for batch in batches:
                matrix, norms = _matrix(batch.column("_vector"))
                near = bounds.value.near(matrix, norms, every, batch.column("cell").to_numpy())
                bits = np.zeros((len(norms), 8 * len(words)), np.uint8)
                packed = np.packbits(near, axis=1, bitorder="little")
                bits[:, : packed.shape[1]] = packed
                marks = bits.view("<i8")
                yield pa.RecordBatch.from_arrays([*batch.select([*by, "cell"]).columns, *[pa.array(np.ascontiguousarray(marks[:, i])) for i in range(len(words))]], out.names)

        return queries.select(*by, "cell", "_vector").mapInArrow(mark, out).groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"), *[F.bit_or(w).alias(w) for w in words])

    def _plan(self, queries: DataFrame, held: DataFrame, by: list[str], floor: float, sizes: tuple[int, int]) -> DataFrame:
        """Per key, side (``_asks``) and cell: where its rows lie on the line of their side (``_start``, ``_n``) and the blocks of the other side they go to."""
        counts = held.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"))
        asked = self._reached(queries, by, floor)
        places = queries.sparkSession.sparkContext.broadcast(_places(self.centres))
        out = T.StructType(
            [queries.schema[c] for c in by]
            + [T.StructField("_asks", T.BooleanType()), T.StructField("cell", T.IntegerType()), T.StructField("_start", T.LongType()), T.StructField("_n", T.LongType())]
            + [T.StructField("_others", T.ArrayType(T.IntegerType()))]
        )
        schema, words = to_arrow_schema(out), [c for c in asked.columns if c.startswith("_w")]

        def line(table: pa.Table, size: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Cells in their order, with their counts, starts and the blocks (columns) that each lies in."""
            table = table.filter(pc.greater_equal(table["cell"], 0))
            cells = table["cell"].to_numpy()
            order = np.argsort(places.value[cells], kind="stable")
            table, cells, n = table.take(pa.array(order)), cells[order], table["n"].to_numpy()[order]
            ends = np.cumsum(n)
            blocks = np.arange(-(-int(ends[-1]) // size) if len(ends) else 0)
            lies = ((ends - n) // size)[:, None] <= blocks
            return table, cells, n, ends - n, lies & (((ends - 1) // size)[:, None] >= blocks)

        def settle(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
            asked, cells, n, starts, lies = line(asked, sizes[0])
            held, other_cells, other_n, other_starts, other_lies = line(held, sizes[1])
            if not len(cells) or not len(other_cells):
                return schema.empty_table()
            bits = np.stack([asked[w].to_numpy() for w in words], axis=1).astype("<i8").view(np.uint8)
            meets = np.unpackbits(bits, axis=1, bitorder="little")[:, other_cells].astype(np.float32)
            parts = []
            for asks, c, count, start, goes in (
                (True, cells, n, starts, meets @ other_lies.astype(np.float32) > 0), (False, other_cells, other_n, other_starts, meets.T @ lies.astype(np.float32) > 0)
            ):
                row, block = np.nonzero(goes)
                ends = np.r_[0, np.cumsum(goes.sum(axis=1))]
                columns = [pa.repeat(v if isinstance(v, pa.Scalar) else pa.scalar(v, schema.field(i).type), len(c)) for i, v in enumerate(key)]
                others = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(block, pa.int32()))
                columns += [pa.repeat(pa.scalar(asks), len(c)), pa.array(c, pa.int32()), pa.array(start, pa.int64()), pa.array(count, pa.int64()), others]
                parts.append(pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, schema)], schema=schema))
            return pa.Table.from_batches(parts)

        return checkpointed(asked.groupBy(*by).cogroup(counts.groupBy(*by)).applyInArrow(settle, out))

    def _sides(self, queries: DataFrame, nodes: DataFrame, by: list[str], query_vector: str, node_vector: str) -> tuple:
        """Queries and nodes of small keys, then those of large keys with their cells; nodes of length 0 meet nothing above 0."""
        queries, nodes = queries.where(F.col(query_vector).isNotNull()), nodes.where(F.col(node_vector).isNotNull())
        hot = nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > self.few).select(*by)
        split = [df.join(hot, by, how) for how in ("left_anti", "left_semi") for df in (queries, nodes)]
        cells = [vector_index.build(df, self.centres, vector=v).drop("angle").where(F.col("cell") >= 0) for df, v in ((split[2], query_vector), (split[3], node_vector))]
        return split[0], split[1], *cells

    def _blocks(self, queries: DataFrame, nodes: DataFrame, by: list[str], k: int | None, floor: float, query_id: str, node_id: str, value: ValueFunction, later_only: bool) -> DataFrame:
        """Pairs of blocks of hot keys, co-grouped; rows have ``_vector`` and their ``cell``."""
        sizes = tuple(min(size, ALL_BLOCK) if k is None else size for size in (QUERY_BLOCK, NODE_BLOCK))
        plan = self._plan(queries, nodes, by, floor, sizes)
        keys = [*by, "_query_block", "_node_block"]

        def dealt(rows: DataFrame, asks: bool, row_id: str) -> DataFrame:
            own, other = ("_query_block", "_node_block") if asks else ("_node_block", "_query_block")
            # rows that a function made look small to Spark, so that side must not be chosen for a broadcast
            met = rows.join(plan.where(F.col("_asks") == asks).drop("_asks").hint("merge"), [*by, "cell"])
            place = F.col("_start") + F.pmod(F.xxhash64(row_id), F.col("_n"))
            met = met.withColumn(own, F.floor(place / F.lit(sizes[0 if asks else 1])).cast("int")).withColumn(other, F.explode("_others"))
            return met.select(*keys, row_id, "_vector", "cell")

        out = T.StructType(
            [queries.schema[c] for c in by] + [queries.schema[query_id], nodes.schema[node_id]]
            + [T.StructField("relevance", T.DoubleType()), T.StructField("value", T.DoubleType())]
        )
        schema = to_arrow_schema(out)
        bounds = queries.sparkSession.sparkContext.broadcast(_Bounds(self.centres, self.low, self.high, floor))

        def run(key: tuple, query_rows: pa.Table, node_rows: pa.Table) -> pa.Table:
            if not query_rows.num_rows or not node_rows.num_rows:
                return schema.empty_table()
            node_rows = node_rows.sort_by("cell")
            asked, held = _side(query_rows, query_id)[:3], _side(node_rows, node_id)[:3]
            cells, starts = np.unique(node_rows["cell"].to_numpy(), return_index=True)
            near = bounds.value.near(asked[1], asked[2], cells, query_rows["cell"].to_numpy())
            parts = []
            for i, (start, end) in enumerate(zip(starts, [*starts[1:], len(held[0])])):
                rows = np.nonzero(near[:, i])[0]
                if len(rows):
                    some = _best((*[x[rows] for x in asked], {}), (*[x[start:end] for x in held], {}), value, k, later_only, floor)
                    parts.append((rows[some[0]], *some[1:]))
            if not parts:
                return schema.empty_table()
            found = tuple(np.concatenate(x) for x in zip(*parts))
            plain = tuple(v.as_py() if hasattr(v, "as_py") else v for v in key[: len(by)])
            return pa.Table.from_batches([_emit(schema, plain, asked[0], found if k is None else _compact(found, k))])

        return dealt(queries, True, query_id).groupBy(*keys).cogroup(dealt(nodes, False, node_id).groupBy(*keys)).applyInArrow(run, out)

    def nearest(
        self, queries: DataFrame, nodes: DataFrame, *, k: int | None, floor: float, query_id: str = "query_id", node_id: str = "semantic_id",
        by: Sequence[str] = ("graph_id",), query_vector: str = "embedding", node_vector: str = "embedding",
        value: ValueFunction = COSINE, later_only: bool = False,
    ) -> DataFrame:
        """As ``similarity.nearest``, for plain cosines at a ``floor`` above 0."""
        if floor is None or floor <= 0 or value.with_limits(COSINE.k, COSINE.threshold) != COSINE:
            raise ValueError("pivots bound plain cosines at a floor above 0; use similarity.nearest")
        by = list(by)
        queries = queries.select(*by, query_id, F.col(query_vector).alias("_vector"))
        nodes = nodes.select(*by, node_id, F.col(node_vector).alias("_vector"))
        few_queries, few_nodes, queries, nodes = self._sides(queries, nodes, by, "_vector", "_vector")
        same = {"k": k, "query_id": query_id, "node_id": node_id, "value": value, "floor": floor, "later_only": later_only}
        small = nearest(few_queries, few_nodes, by=by, **same, query_vector="_vector", node_vector="_vector", broadcast_rows=0)
        large = self._blocks(queries, nodes, by, **same)
        if k is None:
            return small.unionByName(large)
        best = Window.partitionBy(*by, query_id).orderBy(F.desc("value"), node_id)
        large = large.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return small.unionByName(large)

    def compared(self, queries: DataFrame, nodes: DataFrame, *, floor: float, by: Sequence[str] = ("graph_id",), query_vector: str = "embedding", node_vector: str = "embedding") -> DataFrame:
        """Per key above ``few`` nodes: how many pairs of vectors are compared."""
        by = list(by)
        _, _, queries, nodes = self._sides(queries, nodes, by, query_vector, node_vector)
        bounds = queries.sparkSession.sparkContext.broadcast(_Bounds(self.centres, self.low, self.high, floor))

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            every = np.arange(len(bounds.value.centres))
            for batch in batches:
                for part in (batch.slice(i, _STEP) for i in range(0, batch.num_rows, _STEP)):
                    row, cell = np.nonzero(bounds.value.near(*_matrix(part.column("_vector")), every, part.column("_own").to_numpy()))
                    yield pa.RecordBatch.from_arrays([*part.select(by).take(pa.array(row)).columns, pa.array(cell.astype(np.int32))], [*by, "cell"])

        out = T.StructType([*[queries.schema[c] for c in by], T.StructField("cell", T.IntegerType())])
        met = queries.select(*by, F.col("cell").alias("_own"), F.col(query_vector).alias("_vector")).mapInArrow(reach, out)
        count = F.count(F.lit(1))
        both = met.groupBy(*by, "cell").agg(count.alias("_q")).join(nodes.groupBy(*by, "cell").agg(count.alias("_n")), [*by, "cell"])
        return both.groupBy(*by).agg(F.sum(F.col("_q") * F.col("_n")).alias("compared"))
