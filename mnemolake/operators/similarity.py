"""Exact nearest-node search for batches of queries over many graphs at once.

Spark partitions the nodes; inside a task one matrix product scores a block of nodes against the
queries of the same graph and only each query's best rows leave the task. Two exact routes:

* the query side is small (``BROADCAST_QUERIES`` rows and ``BROADCAST_BYTES`` at most, measured first): queries are broadcast and
  the node table is scanned where it lies, with no shuffle of vectors;
* otherwise both sides are split into bounded blocks per graph and block pairs are co-grouped, so a
  graph with a third of all rows becomes many equal tasks.

A final window keeps the k best per query. Ties go to the lower node id.
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

BROADCAST_QUERIES = 8192
BROADCAST_BYTES = 32 << 20
QUERY_BLOCK = 4096
NODE_BLOCK = 16384
#: Rows of a block on either side when every pair at the floor is asked for: all pairs of two blocks fit a task.
ALL_BLOCK = 2048
SCORE_DIGITS = 12  # scores closer than this are ties, whatever order the product summed in
_CHUNK = 512
#: Scores of one step: fewer queries are taken at a time against many nodes, so working tables stay at some megabytes.
STEP_SCORES = 1 << 20

COSINE = ValueFunction()


def _one_chunk(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _matrix(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as a DOUBLE matrix with its norms."""
    column = _one_chunk(column)
    rows = len(column)
    widths = np.unique(pc.list_value_length(column).to_numpy(zero_copy_only=False)) if rows else ()
    if len(widths) > 1:
        raise ValueError(f"vectors of unequal width: {sorted(widths.tolist())}")
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    matrix = flat.reshape(rows, -1) if rows else np.zeros((0, 1))
    return matrix, np.sqrt(np.einsum("ij,ij->i", matrix, matrix))


def _side(table: pa.Table, id_column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """One side of a product: ids, vectors, norms and numeric inputs of the value function."""
    matrix, norms = _matrix(table.column("_vector"))
    inputs = {
        name: table.column(name).to_numpy().astype(np.float64)
        for name in ("importance", "recency", "ret")
        if name in table.column_names
    }
    return table.column(id_column).to_numpy(), matrix, norms, inputs


def _step(nodes: int) -> int:
    return max(1, min(_CHUNK, STEP_SCORES // max(1, nodes)))


def _best(
    queries: tuple, nodes: tuple, value: ValueFunction, k: int | None, later_only: bool, floor: float | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, node id, relevance, value) of each query's k best nodes in this block."""
    query_ids, query_matrix, query_norms, _ = queries
    ids, matrix, norms, inputs = nodes
    order = np.argsort(ids, kind="stable")
    ids, matrix, norms = ids[order], matrix[order], norms[order]
    inputs = {name: column[order][None, :] for name, column in inputs.items()}
    parts = []
    step = _step(len(ids))
    for lo in range(0, len(query_ids), step):
        hi = min(lo + step, len(query_ids))
        scale = query_norms[lo:hi, None] * norms[None, :]
        products = query_matrix[lo:hi] @ matrix.T
        relevance = np.divide(products, scale, out=np.zeros_like(products), where=scale > 0)
        scores = np.round(np.broadcast_to(value.score(relevance, **inputs), relevance.shape), SCORE_DIGITS)
        keep = np.ones(scores.shape, dtype=bool)
        if later_only:
            keep &= ids[None, :] > query_ids[lo:hi, None]
        if floor is not None:
            keep &= scores >= floor
        if k is not None and scores.shape[1] > k:
            masked = np.where(keep, scores, -np.inf)
            kth = -np.partition(-masked, k - 1, axis=1)[:, k - 1 : k]
            above = masked > kth
            ties = keep & (masked == kth)
            room = k - above.sum(axis=1, keepdims=True)
            keep = above | (ties & (np.cumsum(ties, axis=1) <= room))
        rows, cols = np.nonzero(keep)
        parts.append((rows + lo, ids[cols], relevance[rows, cols], scores[rows, cols]))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, int),) * 4


def _compact(rows: tuple, k: int) -> tuple:
    """Keep the k best per query row of an accumulated (query row, node id, relevance, value) set."""
    query, ids, _, scores = rows
    order = np.lexsort((ids, -scores, query))
    query = query[order]
    starts = np.r_[0, np.nonzero(np.diff(query))[0] + 1] if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    return tuple(column[order][rank < k] for column in rows)


def _inputs(value: ValueFunction, df: DataFrame) -> list[str]:
    return [
        name
        for name, fn in (("importance", value.importance), ("recency", value.recency), ("ret", value.ret))
        if fn is not None and name in df.columns
    ]


def nearest(
    queries: DataFrame,
    nodes: DataFrame,
    *,
    k: int | None,
    query_id: str = "query_id",
    node_id: str = "semantic_id",
    by: Sequence[str] = ("graph_id",),
    query_vector: str = "embedding",
    node_vector: str = "embedding",
    value: ValueFunction = COSINE,
    floor: float | None = None,
    later_only: bool = False,
    broadcast_rows: int = BROADCAST_QUERIES,
) -> DataFrame:
    """The k best nodes of each query: ``by``, query id, node id, relevance, value, rank.

    ``nodes`` may carry ``importance``, ``recency`` and ``ret`` columns, used by ``value``.
    ``k=None`` returns every pair with value >= ``floor`` (needed by score traces only).
    ``later_only`` keeps nodes whose id is above the query id (half of a symmetric self-search).
    Rows without a vector never match.
    """
    by = list(by)
    queries = queries.where(F.col(query_vector).isNotNull()).select(
        *[F.col(c).alias(c) for c in (*by, query_id)], F.col(query_vector).alias("_vector")
    )
    nodes = nodes.where(F.col(node_vector).isNotNull()).select(
        *by, node_id, F.col(node_vector).alias("_vector"), *_inputs(value, nodes)
    )
    out = T.StructType(
        [queries.schema[c] for c in by]
        + [queries.schema[query_id], nodes.schema[node_id]]
        + [T.StructField("relevance", T.DoubleType()), T.StructField("value", T.DoubleType())]
    )
    sample = _small(queries, broadcast_rows) if broadcast_rows else None
    if sample is not None:
        pairs = _scan(sample, nodes, by, query_id, node_id, out, value, k, floor, later_only)
    else:
        pairs = _blocks(queries, nodes, by, query_id, node_id, out, value, k, floor, later_only)
    if k is None:
        return pairs
    best = Window.partitionBy(*by, query_id).orderBy(F.desc("value"), node_id)
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _small(queries: DataFrame, rows: int) -> pa.Table | None:
    """The query side if it has at most ``rows`` rows and ``BROADCAST_BYTES`` of vectors; measured before it is fetched."""
    width = F.size("_vector").cast("bigint") * 8
    n, size = queries.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return queries.toArrow() if n <= rows and size <= BROADCAST_BYTES else None


def _keys(table: pa.Table | pa.RecordBatch, by: list[str]) -> dict[tuple, np.ndarray]:
    """Row positions per key tuple."""
    coded = [_one_chunk(table.column(c)).dictionary_encode(null_encoding="encode") for c in by]
    codes = np.stack([c.indices.to_numpy(zero_copy_only=False) for c in coded], axis=1)
    unique, inverse, sizes = np.unique(codes, axis=0, return_inverse=True, return_counts=True)
    # one sort brings the rows of every key together
    runs = np.split(np.argsort(inverse.reshape(-1), kind="stable"), np.cumsum(sizes)[:-1])
    return {tuple(c.dictionary[int(i)].as_py() for c, i in zip(coded, row)): rows for row, rows in zip(unique, runs)}


def _emit(schema: pa.Schema, key: tuple, query_ids: np.ndarray, found: tuple) -> pa.RecordBatch:
    query, ids, relevance, scores = found
    columns = [pa.repeat(pa.scalar(v, schema.field(i).type), len(query)) for i, v in enumerate(key)]
    n = len(key)
    columns.append(pa.array(query_ids[query], type=schema.field(n).type))
    columns.append(pa.array(ids, type=schema.field(n + 1).type))
    columns += [pa.array(relevance, type=pa.float64()), pa.array(scores, type=pa.float64())]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _scan(sample, nodes, by, query_id, node_id, out, value, k, floor, later_only) -> DataFrame:
    """Queries broadcast, nodes scanned in place; each task keeps k rows per query."""
    sides = {
        key: _side(sample.take(pa.array(rows)), query_id)
        for key, rows in _keys(sample, by).items()
    }
    shared = nodes.sparkSession.sparkContext.broadcast(sides)
    if len(sides) <= 256:
        # also keeps the scan to the partitions asked for
        first = sorted({key[0] for key in sides if key[0] is not None})
        nodes = nodes.where(F.col(by[0]).isin(first) if first else F.lit(False))
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list[tuple]] = {}
        held: dict[tuple, int] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for key, rows in _keys(table, by).items():
                queries = shared.value.get(key)
                if queries is None:
                    continue
                block = _side(table.take(pa.array(rows)), node_id)
                if k is None:
                    step = _step(len(rows))
                    for lo in range(0, len(queries[0]), step):
                        some = tuple(x[lo : lo + step] for x in queries[:3])
                        yield _emit(schema, key, some[0], _best((*some, {}), block, value, k, later_only, floor))
                    continue
                found = _best(queries, block, value, k, later_only, floor)
                kept.setdefault(key, []).append(found)
                held[key] = held.get(key, 0) + len(found[0])
                if held[key] > 4 * k * len(queries[0]):
                    merged = tuple(np.concatenate(c) for c in zip(*kept[key]))
                    kept[key] = [_compact(merged, k)]
                    held[key] = len(kept[key][0][0])
        for key, parts in kept.items():
            merged = _compact(tuple(np.concatenate(c) for c in zip(*parts)), k)
            yield _emit(schema, key, shared.value[key][0], merged)

    return nodes.mapInArrow(run, out)


def _split(df: DataFrame, sizes: DataFrame, large: DataFrame, by: list[str], row_id: str, own: str, other: str) -> DataFrame:
    """Give each row its own block by hash and copy it to every block of the other side; keys of one side only go.

    Only keys of several blocks are joined for their numbers. They are few (rows / block size at most), so that table is
    broadcast and never the rows, whose size Spark underestimates where a function makes them.
    """
    n_own, n_other = (F.coalesce(f"_{side}_blocks", F.lit(1).cast("bigint")) for side in (own, other))
    return (
        df.join(sizes.select(*by), by, "left_semi").join(F.broadcast(large), by, "left")
        .withColumn(f"_{own}_block", F.pmod(F.xxhash64(row_id), n_own))
        .withColumn(f"_{other}_block", F.explode(F.sequence(F.lit(0).cast("bigint"), n_other - 1)))
        .drop("_query_blocks", "_node_blocks")
    )


def _blocks(queries, nodes, by, query_id, node_id, out, value, k, floor, later_only) -> DataFrame:
    """Bounded (query block, node block) pairs per key, co-grouped."""
    most = [min(size, ALL_BLOCK) if k is None else size for size in (QUERY_BLOCK, NODE_BLOCK)]
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    rows = queries.select(*by, one.alias("_q"), none.alias("_n")).unionByName(nodes.select(*by, none.alias("_q"), one.alias("_n")))
    sizes = (
        rows.groupBy(*by)
        .agg(F.ceil(F.sum("_q") / F.lit(most[0])).alias("_query_blocks"), F.ceil(F.sum("_n") / F.lit(most[1])).alias("_node_blocks"))
        .where("_query_blocks > 0 and _node_blocks > 0")
    )
    large = sizes.where("_query_blocks > 1 or _node_blocks > 1")
    keys = [*by, "_query_block", "_node_block"]
    left = _split(queries, sizes, large, by, query_id, "query", "node").groupBy(*keys)
    right = _split(nodes, sizes, large, by, node_id, "node", "query").groupBy(*keys)
    schema = to_arrow_schema(out)

    def run(key: tuple, query_rows: pa.Table, node_rows: pa.Table) -> pa.Table:
        if not query_rows.num_rows or not node_rows.num_rows:
            return schema.empty_table()
        side = _side(query_rows, query_id)
        found = _best(side, _side(node_rows, node_id), value, k, later_only, floor)
        plain = tuple(v.as_py() if hasattr(v, "as_py") else v for v in key[: len(by)])
        return pa.Table.from_batches([_emit(schema, plain, side[0], found)])

    return left.cogroup(right).applyInArrow(run, out)
