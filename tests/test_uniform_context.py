"""Draws of a random context: every subset and order alike, small graphs whole, reruns equal."""

from collections import Counter

from mnemolake.operators import evaluate


def test_every_subset_and_order_is_equally_likely(spark):
    facts = spark.createDataFrame([("g", 10 * i) for i in range(6)] + [("h", 1)], "graph_id string, semantic_id long")
    queries = spark.createDataFrame([("g", q) for q in range(12_000)] + [("h", -1), ("none", -2)], "graph_id string, query_id long")
    rows = evaluate.uniform_context(queries, facts, 2, seed=3).collect()
    drawn: dict = {}
    for r in rows:
        drawn.setdefault((r.graph_id, r.query_id), {})[r["rank"]] = r.semantic_id
    assert drawn.pop(("h", -1)) == {1: 1} and len(drawn) == 12_000
    counts = Counter((d[1], d[2]) for d in drawn.values())
    # 30 ordered pairs, 400 each: chi-square with 29 degrees of freedom is below 58.3 but once in a thousand
    assert len(counts) == 30 and all(a != b for a, b in counts)
    assert sum((n - 400) ** 2 / 400 for n in counts.values()) < 58.3
    assert sorted(map(str, evaluate.uniform_context(queries, facts, 2, seed=3).collect())) == sorted(map(str, rows))
    assert evaluate.uniform_context(queries, facts, 0).count() == 0 and evaluate.uniform_context(queries, facts.limit(0), 2).count() == 0
