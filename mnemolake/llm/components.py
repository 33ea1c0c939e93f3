"""Classes of linked rows by star contraction.

Links are cut into chunks of bounded size, and each chunk is reduced to a spanning forest inside one task, whatever
it holds. If one chunk is all there is, that forest is the answer. Otherwise two steps alternate until only stars
are left or one chunk can hold the rest. The large-star step ties each end of a link to the least neighbour of its
lesser end; the small-star step ties all lesser neighbours of a row to the least of them. Both keep what is
connected connected, and links become fewer with each round. Repeated links are dropped in every round, and rows with very many links
(at most ``HUBS`` by construction) get their least neighbour by broadcast, so that no list of neighbours meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.llm.common import saved

#: Links that one task may hold.
CHUNK = 1 << 20
#: Rows that may get their neighbour by broadcast: those with more than 1 / HUBS of all links.
HUBS = 10_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the links (a, b) and for each of them the least end it is connected with."""
    ends, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(ends))
    while len(x):
        p, q = label[x], label[y]
        split = p != q
        x, y, p, q = x[split], y[split], p[split], q[split]
        low = np.minimum(p, q)
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        while not np.array_equal(far := label[label], label):
            label = far
    return ends, ends[label]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    u, v = roots(table["u"].to_numpy(), table["v"].to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])


def _with_least(edges: DataFrame, least: DataFrame, key: str, links: int) -> DataFrame:
    """(u, v, low): the least lesser neighbour of the end named ``key``, missing if that end has none."""
    often = edges.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1000, links // HUBS)).select(F.col(key).alias("hub"))
    often = often.join(least, often["hub"] == least["x"], "left").select("hub", F.col("low").alias("hub_low"))
    marked = edges.join(F.broadcast(often), edges[key] == often["hub"], "left")
    rest = marked.where("hub is null")
    rest = rest.join(least, rest[key] == least["x"], "left").select("u", "v", "low")
    return marked.where("hub is not null").select("u", "v", F.col("hub_low").alias("low")).unionByName(rest)


def _round(edges: DataFrame, links: int) -> DataFrame:
    """One large-star and one small-star step on links (u, v) with u > v."""
    least = lambda e: e.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("low"))
    large = saved(_with_least(edges, least(edges), "v", links).select("u", F.coalesce("low", "v").alias("v")).distinct(), "large")
    small = _with_least(large, least(large), "u", large.count()).where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return saved(small.unionByName(least(large).select(F.col("x").alias("u"), F.col("low").alias("v"))).distinct(), "small")


def components(links: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """(row, label) for each row that has a link in ``links`` (a, b): the least row of its class. No link, no row."""
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").cast("bigint").alias("u"), F.least("a", "b").cast("bigint").alias("v")), "links")
    n, shape = edges.count(), "u long, v long"
    if n > chunk:
        edges = saved(edges.repartition(-(-n // chunk)).mapInArrow(_forest, shape), "forests")
        n = edges.count()
    mark = None
    while n > chunk:
        edges = _round(edges, n)
        n, now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == (mark := (n, now)):
            break  # only stars are left
    else:
        edges = saved(edges.repartition(1).mapInArrow(_forest, shape), "stars")
    heads = edges.select(F.col("v").alias("row")).distinct()
    return edges.select(F.col("u").alias("row"), F.col("v").alias("label")).unionByName(heads.select("row", F.col("row").alias("label")))
