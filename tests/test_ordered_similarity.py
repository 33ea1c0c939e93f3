import tracemalloc

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemolake.functions.value import ValueFunction
from mnemolake.functions.vector import cosine, hash_embedding
from mnemolake.operators import similarity
from mnemolake.operators.ordered import groups_are_small, number_rows, previous_row, running_sum
from mnemolake.operators.similarity import nearest


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(int(rng.integers(0, 3)), i, int(rng.integers(0, 5))) for i in range(60)]
    return spark.createDataFrame(data, "k int, o long, v int")


def test_blocks_equal_plain_windows(rows):
    assert groups_are_small(rows, ["k"]) and not groups_are_small(rows, ["k"], limit=5)
    for make in (
        lambda small: running_sum(rows, ["k"], ["o"], F.col("v"), "x", span=4, small=small),
        lambda small: number_rows(rows, ["k"], ["o"], "x", span=4, small=small),
        lambda small: previous_row(rows, ["k"], ["o"], ["v", "o"], "x", span=4, small=small),
    ):
        assert sorted(map(str, make(True).collect())) == sorted(map(str, make(False).collect()))


def test_previous_row_is_lag(rows):
    plain = Window.partitionBy("k").orderBy("o")
    got = previous_row(rows, ["k"], ["o"], ["v"], "p", span=3, small=False).withColumn("q", F.lag("v").over(plain))
    assert got.where(~F.col("p.v").eqNullSafe(F.col("q"))).count() == 0


def _brute(queries, nodes, k, later=False, floor=None):
    out = set()
    for g, q, u in queries:
        scored = []
        for h, n, v in nodes:
            if g != h or (later and n <= q):
                continue
            a, b = np.linalg.norm(u), np.linalg.norm(v)
            s = 0.0 if a == 0 or b == 0 else float(np.dot(u, v) / (a * b))
            if floor is None or s >= floor:
                scored.append((-round(s, 12), n))
        out |= {(g, q, n) for _, n in sorted(scored)[:k]}
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    nodes = [("g%d" % (i % 2), i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(80)]
    nodes[4] = ("g0", 4, [0.0] * 6)
    nodes += [("g0", 200 + i, nodes[2][2]) for i in range(5)]  # copies tie
    queries = [("g%d" % (i % 2), i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(9)] + [("g0", 50, [0.0] * 6), ("gone", 51, [1.0] * 6)]
    return queries, nodes


@pytest.mark.parametrize("limit", [similarity.BROADCAST_QUERIES, 0])
@pytest.mark.parametrize("later,floor", [(False, None), (True, None), (False, 0.3)])
def test_nearest_equals_brute_force(spark, vectors, monkeypatch, limit, later, floor):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 3)
    monkeypatch.setattr(similarity, "NODE_BLOCK", 7)
    queries, nodes = vectors
    q = spark.createDataFrame(queries, "graph_id string, query_id long, embedding array<float>")
    n = spark.createDataFrame(nodes, "graph_id string, semantic_id long, embedding array<float>").repartition(3)
    got = nearest(q, n, k=4, later_only=later, floor=floor, broadcast_rows=limit)
    assert {(r.graph_id, r.query_id, r.semantic_id) for r in got.collect()} == _brute(queries, nodes, 4, later, floor)


def test_value_function_reads_node_columns(spark, vectors):
    queries, nodes = vectors
    rule = ValueFunction(k=3, importance=lambda x: 0.1 * x, recency=lambda x: -0.01 * x)
    q = spark.createDataFrame(queries, "graph_id string, query_id long, embedding array<float>")
    n = spark.createDataFrame(
        [(g, i, e, float(i % 4), i) for g, i, e in nodes], "graph_id string, semantic_id long, embedding array<float>, importance double, recency long"
    )
    got = nearest(q, n, k=3, value=rule)
    check = n.join(q.withColumnRenamed("embedding", "e"), "graph_id").withColumn(
        "v", F.round(rule.score(cosine(F.col("e"), F.col("embedding")), F.col("importance"), F.col("recency")), 12)
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("v"), "semantic_id")
    check = check.withColumn("r", F.row_number().over(best)).where("r <= 3")
    assert {(r.query_id, r.semantic_id, r["rank"]) for r in got.collect()} == {(r.query_id, r.semantic_id, r.r) for r in check.collect()}


def test_vectors(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>").select(
        cosine(F.col("a"), F.col("b")).alias("zero"), cosine(F.col("b"), F.col("b")).alias("one"),
        hash_embedding(F.lit("x"), 40).alias("h"), hash_embedding(F.lit(None).cast("string"), 32).alias("n"), hash_embedding(F.lit(""), 32).alias("e"),
    ).first()
    assert row.zero == 0.0 and abs(row.one - 1.0) < 1e-12
    assert len(row.h) == 40 and row.h[32:] == row.h[:8] and row.n == row.e


def test_working_tables_of_a_block_stay_small():
    rng = np.random.default_rng(2)
    ids, matrix = np.arange(similarity.NODE_BLOCK), rng.normal(size=(similarity.NODE_BLOCK, 8))
    side = ids, matrix, np.linalg.norm(matrix, axis=1), {}
    few = ids[:512], matrix[:512], side[2][:512], {}
    tracemalloc.start()
    found = similarity._best(few, side, similarity.COSINE, 32, True, 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found[0]) == 512 * 32 and peak < 100 << 20


def test_all_pairs_come_in_small_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(similarity, "ALL_BLOCK", 5)
    queries, nodes = vectors
    q = spark.createDataFrame(queries, "graph_id string, query_id long, embedding array<float>")
    n = spark.createDataFrame(nodes, "graph_id string, semantic_id long, embedding array<float>").repartition(3)
    for rows in (0, similarity.BROADCAST_QUERIES):
        got = nearest(q, n, k=None, floor=0.31, broadcast_rows=rows)
        assert sorted((r.graph_id, r.query_id, r.semantic_id) for r in got.collect()) == sorted(_brute(queries, nodes, len(nodes), floor=0.31))
    plan = nearest(q, n, k=None, floor=0.31, broadcast_rows=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "/ 5" in plan


def test_keys_of_one_side_and_missing_keys_match_nothing(spark):
    rows = "graph_id string, {} long, embedding array<float>"
    q = spark.createDataFrame([("a", 1, [1.0]), (None, 2, [1.0]), ("q", 3, [1.0])], rows.format("query_id"))
    n = spark.createDataFrame([("a", 4, [1.0]), (None, 5, [1.0]), ("n", 6, [1.0])], rows.format("semantic_id"))
    assert [(r.query_id, r.semantic_id) for r in nearest(q, n, k=3, broadcast_rows=0).collect()] == [(1, 4)]


def test_a_group_of_whole_texts_is_dealt_to_many_tasks(spark):
    rows = spark.range(20_000, numPartitions=4).select(F.lit("g").alias("graph_id"), "id", F.repeat(F.lit("x"), 100).alias("text"))
    numbered = number_rows(rows, ["graph_id"], ["id"], "place")
    assert numbered.where("place <> id").count() == 0 and numbered.count() == 20_000
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    windows = [line[line.index("], [") :] for line in plan.split("\n") if "Window [" in line]
    # the outer one meets the texts, the inner one only a row per block
    assert len(windows) == 2 and "_block" in windows[0].split("], [")[1]


def _shuffled_rows(node):
    """Rows written by all exchanges of an executed plan."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return _shuffled_rows(node.executedPlan())
    if "QueryStage" in name:
        return _shuffled_rows(node.plan())
    children, own = node.children(), node.metrics().get("shuffleRecordsWritten").get().value() if name == "Exchange" else 0
    return own + sum(_shuffled_rows(children.apply(i)) for i in range(children.size()))


def test_blocked_rows_are_dealt_out_once(spark):
    rows = spark.range(20_000, numPartitions=4).select(F.when(F.col("id") % 2 == 0, "g").alias("k"), "id", F.repeat(F.lit("x"), 100).alias("text"))
    known = spark.createDataFrame([("g", 5)], "k string, first long")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for numbered in (number_rows(rows, ["k"], ["id"], "place", small=False, known=known), previous_row(rows, ["k"], ["id"], ["id"], "before", small=False)):
            got = numbered.collect()
            assert len(got) == 20_000
            assert _shuffled_rows(numbered._jdf.queryExecution().executedPlan()) < 21_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    by_id = {r.id: (r.place, r.first) for r in number_rows(rows, ["k"], ["id"], "place", small=False, known=known).collect()}
    assert by_id == {i: (i // 2, 5 if i % 2 == 0 else None) for i in range(20_000)}
    assert by_id == {r.id: (r.place, r.first) for r in number_rows(rows, ["k"], ["id"], "place", small=True, known=known).collect()}
