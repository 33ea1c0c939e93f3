"""The index against full search: exact mode on clustered, uniform and odd vectors, recall and share read of probes."""

import numpy as np
from pyspark.sql import functions as F

from mnemolake.operators.similarity import nearest
from mnemolake.operators.vector_index import VectorIndex

NODES = "graph_id string, semantic_id long, embedding array<float>, is_active boolean"


def _vectors(spark, n=3000, dim=16, spread=0.15):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(25, dim))
    made = middle[rng.integers(0, 25, n)] + spread * rng.normal(size=(n, dim))
    rows = [("a" if i % 3 else "b", i, [float(x) for x in v], i % 7 != 0) for i, v in enumerate(made.astype(np.float32))]
    odd = [("a", 9000 + i, [0.0] * dim, True) for i in range(3)] + [("a", 9100, None, True), ("a", 9101, rows[1][2], True), ("c", 9200, rows[0][2], True)]
    return spark.createDataFrame(rows + odd, NODES)


def _queries(nodes):
    own = nodes.where("semantic_id % 20 = 0").select("graph_id", F.col("semantic_id").alias("query_id"), "embedding")
    return own.unionByName(own.limit(1).withColumn("graph_id", F.lit("nowhere")).withColumn("query_id", F.lit(-1).cast("long")))


def _hits(rows):
    return sorted((r.graph_id, r.query_id, r.rank, r.semantic_id) for r in rows.collect())


def test_exact_search_equals_full_search_and_reads_less(spark, tmp_path):
    nodes = _vectors(spark)
    queries = _queries(nodes)
    index = VectorIndex.write(nodes, str(tmp_path / "index"))
    assert index.vectors.count() == 3005 and index.cells.agg(F.sum("n")).first()[0] == 3005
    found, cells = index.search(queries, k=10, probes=2)
    assert _hits(found) == _hits(nearest(queries, nodes, k=10))
    asked = queries.groupBy("graph_id").agg(F.count("*").alias("q")).join(nodes.where("embedding is not null").groupBy("graph_id").agg(F.count("*").alias("n")), "graph_id").agg(F.sum(F.col("q") * F.col("n"))).first()[0]
    assert cells.agg(F.sum("n")).first()[0] < asked / 2
    active, _ = index.search(queries, k=4, probes=1, keep="is_active")
    assert _hits(active) == _hits(nearest(queries, nodes.where("is_active"), k=4))


def test_more_hits_asked_for_than_there_are(spark, tmp_path):
    nodes = _vectors(spark, n=60, spread=5.0)
    index = VectorIndex.write(nodes, str(tmp_path / "index"), cells=4)
    found, _ = index.search(_queries(nodes), k=100, probes=1)
    assert _hits(found) == _hits(nearest(_queries(nodes), nodes, k=100))


def test_recall_of_probes(spark, tmp_path):
    nodes = _vectors(spark)
    queries = _queries(nodes)
    index = VectorIndex.write(nodes, str(tmp_path / "index"))
    found, cells = index.search(queries, k=10, exact=False)
    full = {h[:2] + h[3:] for h in _hits(nearest(queries, nodes, k=10))}
    got = {h[:2] + h[3:] for h in _hits(found)}
    assert len(full & got) >= 0.9 * len(full)
    assert cells.groupBy("graph_id", "query_id").count().agg(F.max("count")).first()[0] <= index.fitted_probes < 30
