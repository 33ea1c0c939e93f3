"""The join by pivots against the plain search: thresholds, odd vectors, ties, and the share compared in a hot tag."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.functions.value import ValueFunction
from mnemolake.operators import consolidate
from mnemolake.operators.pivot_join import PivotJoin
from mnemolake.operators.similarity import nearest

FACT = "graph_id string, semantic_id long, embedding array<float>, tag_ids array<long>"


def _facts(spark, n=3000, dim=24, spread=0.12, middles=60):
    rng = np.random.default_rng(11)
    middle = rng.normal(size=(middles, dim)) / np.sqrt(dim)
    rows = []
    for i in range(n):
        # drawn, so that the hot tag of each graph holds vectors of every cluster
        vector = (middle[rng.integers(0, middles)] + spread * rng.normal(size=dim) / np.sqrt(dim) * 3).astype(np.float32)
        rows.append(("a" if i % 4 else "b", i, [float(x) for x in vector], [0, 1 + i % 50] if i % 3 == 0 else [1 + i % 50]))
    rows += [("a", n + i, rows[1][2], [0, 2]) for i in range(5)]  # copies
    rows += [("a", n + 10, [0.0] * dim, [0]), ("a", n + 11, None, [0]), ("a", n + 12, rows[2][2], None), ("a", n + 13, [-x for x in rows[1][2]], [0]), ("c", n + 14, rows[1][2], [0])]
    return spark.createDataFrame(rows, FACT)


@pytest.fixture(scope="module")
def facts(spark):
    return _facts(spark).cache()


def _plain(rows, *ids):
    return sorted(tuple(r[c] for c in ids) + tuple(round(r[c], 9) for c in r.asDict() if c in ("score", "value")) for r in rows.collect())


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95, 1.0])
def test_pairs_equal_plain_search(facts, threshold):
    joined = PivotJoin(facts, few=100)
    got = consolidate.all_pairs(facts, facts, threshold=threshold, search=joined.nearest)
    want = _plain(consolidate.all_pairs(facts, facts, threshold=threshold), "graph_id", "id_a", "id_b")
    assert _plain(got, "graph_id", "id_a", "id_b") == want and want


def test_lists_equal_plain_search(facts):
    joined = PivotJoin(facts, few=100)
    names = ("graph_id", "id_a", "id_b", "place", "full")
    rows = [consolidate.candidate_lists(facts, facts, threshold=0.6, list_size=4, search=s) for s in (joined.nearest, nearest)]
    assert _plain(rows[0], *names) == _plain(rows[1], *names)


@pytest.mark.parametrize("floor, most", [(0.5, 0.25), (0.8, 0.1)])
def test_hot_tag_is_not_compared_with_itself(facts, floor, most):
    joined = PivotJoin(facts, few=100)
    own = facts.select("graph_id", "semantic_id", "embedding", F.explode("tag_ids").alias("tag_id")).where("tag_id = 0")
    n = {r.graph_id: r.n for r in own.groupBy("graph_id").agg(F.count("embedding").alias("n")).collect()}
    compared = {r.graph_id: r.compared for r in joined.compared(own, own, floor=floor, by=("graph_id", "tag_id")).collect()}
    print({g: c / n[g] ** 2 for g, c in compared.items()})
    assert set(compared) == {"a", "b"} and all(c < most * n[g] ** 2 for g, c in compared.items())


def test_unclustered_empty_and_refused(spark):
    loose = _facts(spark, n=400, spread=5.0, middles=3)
    joined = PivotJoin(loose, cells=20, few=10)
    rows = [consolidate.all_pairs(loose, loose, threshold=0.3, search=s) for s in (joined.nearest, nearest)]
    assert _plain(rows[0], "graph_id", "id_a", "id_b") == _plain(rows[1], "graph_id", "id_a", "id_b")
    assert consolidate.all_pairs(loose.limit(0), loose.limit(0), search=PivotJoin(loose.limit(0)).nearest).count() == 0
    with pytest.raises(ValueError):
        joined.nearest(loose.withColumnRenamed("semantic_id", "query_id"), loose, k=1, floor=0.0)
    with pytest.raises(ValueError):
        joined.nearest(loose.withColumnRenamed("semantic_id", "query_id"), loose, k=1, floor=0.5, value=ValueFunction(importance=lambda v: v))


def test_rows_made_by_a_function_are_never_broadcast(facts):
    # Spark takes them for as small as their input, whatever number of copies the function makes
    by = ["graph_id", "tag_id"]
    rows = facts.select("graph_id", "semantic_id", "embedding", F.explode("tag_ids").alias("tag_id"))
    found = PivotJoin(facts, few=100).nearest(rows.withColumnRenamed("semantic_id", "id_a"), rows, k=None, query_id="id_a", by=by, floor=0.8, later_only=True)
    assert found.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    lines = found._jdf.queryExecution().sparkPlan().toString().split("\n")
    for i, line in enumerate(lines):
        if "Join" in line and "Build" in line:
            depth = line.index("B" if line.lstrip(" :+-").startswith("B") else "S")
            sides = [j for j in range(i + 1, len(lines)) if len(lines[j]) - len(lines[j].lstrip(" :+-")) == depth + 3]
            ends = next((j for j in range(i + 1, len(lines)) if len(lines[j]) - len(lines[j].lstrip(" :+-")) <= depth), len(lines))
            left, right = (j for j in sides if j < ends)
            built = lines[left:right] if "BuildLeft" in line else lines[right:ends]
            assert "_vector" not in built[0] and not any("MapInArrow" in x for x in built[:3]), (line, built[:3])


def _shuffled_rows(node):
    """Rows written by all exchanges of an executed plan."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return _shuffled_rows(node.executedPlan())
    if "QueryStage" in name:
        return _shuffled_rows(node.plan())
    children, own = node.children(), node.metrics().get("shuffleRecordsWritten").get().value() if name == "Exchange" else 0
    return own + sum(_shuffled_rows(children.apply(i)) for i in range(children.size()))


def test_vectors_travel_by_blocks_not_by_cells(spark):
    # without clusters a query reaches most cells; it must not be copied to each of them
    loose = _facts(spark, n=3000, spread=5.0, middles=3).where("embedding is not null")
    joined = PivotJoin(loose, cells=200, few=10)
    rows = loose.select("graph_id", "semantic_id", "embedding")
    found = joined.nearest(rows.withColumnRenamed("semantic_id", "id_a"), rows, k=None, query_id="id_a", floor=0.3, later_only=True)
    assert len(found.collect()) > 10000
    assert 0 < _shuffled_rows(found._jdf.queryExecution().executedPlan()) < 15 * rows.count()
