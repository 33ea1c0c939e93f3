"""Posting blocks against scoring every vote: odd rows, several value functions, and a tag that holds a third of all facts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.functions.value import ValueFunction
from mnemolake.operators import retrieve
from mnemolake.operators.vote_postings import VotePostings

FACT = "graph_id string, semantic_id long, embedding array<float>, tags array<string>, tag_ids array<long>, time long, is_active boolean"
CHOSEN = "graph_id string, query_id long, tag_id long, hit_votes long, hit_weight double"
HOT = 0


def _graph(spark, n=4000, dim=8):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        ids = sorted({int(t) for t in rng.integers(1, 30, rng.integers(0, 4))} | ({HOT} if i % 3 == 0 else set()))
        vector = (middle[i % 12] + 0.2 * rng.normal(size=dim)).astype(np.float32)
        rows.append(("ab"[i % 5 == 0], i, [float(x) for x in vector], [f"t{t}" for t in ids], ids, i, i % 7 != 0))
    rows += [
        ("a", n, None, ["t0"], [0], n, True), ("a", n + 1, [0.0] * dim, ["t0", "t1"], [0, 1], n, True),
        ("a", n + 2, rows[0][2], ["t0"], [0, 0, 2, None], n, True), ("a", n + 3, rows[1][2], [], [], n, True),
        ("a", n + 4, rows[1][2], None, None, n, True), ("a", n + 5, rows[3][2], ["t0"], [0], None, True), ("a", n + 6, rows[3][2], ["t0"], [0], 3, True),
    ]
    facts = spark.createDataFrame(rows, FACT)
    queries, chosen = [], []
    for q in range(24):
        near = rows[q * 31][2] if q else [0.0] * dim
        queries.append(("ab"[q % 4 == 0], q, near))
        if q != 5:  # one query without tags
            for t in {HOT, *[int(t) for t in rng.integers(1, 30, 3)]}:
                chosen.append((queries[-1][0], q, t, int(rng.integers(1, 4)), float(rng.integers(1, 200))))
    return facts, spark.createDataFrame(queries, "graph_id string, query_id long, embedding array<float>"), spark.createDataFrame(chosen, CHOSEN)


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    facts, queries, chosen = (df.cache() for df in _graph(spark))
    return facts, queries, chosen, VotePostings.write(facts, str(tmp_path_factory.mktemp("lists") / "p"), block=32)


RULES = {
    "all": ValueFunction(k=10, threshold=0.0, importance=lambda v: 0.001 * v, recency=lambda a: -0.0001 * a),
    "falling": ValueFunction(k=5, threshold=-2.0, importance=lambda v: -0.02 * v),
    "votes only": ValueFunction(k=7, threshold=0.0, relevance=None, importance=lambda v: v),
    "high bar": ValueFunction(k=10, threshold=0.97, importance=lambda v: 0.0001 * v),
    "many": ValueFunction(k=5000, threshold=-9.0, importance=lambda v: 0.01 * v),
}


def _plain(rows):
    return sorted((r.graph_id, r.query_id, r["rank"], r.semantic_id, r.tag_votes, round(r.importance, 9), round(r.value, 9)) for r in rows.collect())


@pytest.mark.parametrize("rule", RULES)
def test_equals_scoring_every_vote(graph, rule):
    facts, queries, chosen, lists = graph
    value = RULES[rule]
    plain = retrieve.retrieve_semantic(queries, None, None, facts, value=value, chosen=chosen, prune=False)
    assert _plain(retrieve.retrieve_semantic(queries, None, None, facts, value=value, chosen=chosen, postings=lists)) == _plain(plain)


def test_hot_tag_opens_few_blocks(graph):
    facts, queries, chosen, lists = graph
    _, blocks = lists.search(queries, chosen, retrieve.direct_facts(queries, facts), RULES["all"])
    share = {r.hot: r.opened / r.n for r in blocks.groupBy((F.col("tag_id") == HOT).alias("hot")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("opened"), F.col("n")).otherwise(0)).alias("opened")).collect()}
    print(share)
    assert share[True] < 0.25
    largest = lists.postings.agg(F.max("n")).first()[0]
    assert largest <= 32


def test_empty_tables(graph, spark, tmp_path):
    facts, queries, chosen, lists = graph
    assert lists.search(queries.limit(0), chosen.limit(0), retrieve.direct_facts(queries.limit(0), facts), RULES["all"])[0].count() == 0
    none = VotePostings.write(facts.limit(0), str(tmp_path / "none"))
    assert none.search(queries, chosen, retrieve.direct_facts(queries, facts.limit(0)), RULES["all"])[0].count() == 0
