import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from mnemolake.functions.value import ValueFunction
from mnemolake.operators import build, consolidate
from mnemolake.operators.components import connected_components


def _cos(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_tag_upsert_first_seen_order(spark):
    facts = spark.createDataFrame([("g", 0, ["b", "a", "b"], 0), ("g", 1, ["a", "c"], 1), ("h", 0, ["c"], 5)], "graph_id string, semantic_id long, tags array<string>, time long")
    new, edges = build.upsert_tags(facts)
    assert {(r.graph_id, r.tag, r.tag_id, r.time) for r in new.collect()} == {("g", "b", 0, 0), ("g", "a", 1, 0), ("g", "c", 2, 1), ("h", "c", 0, 5)}
    assert edges.count() == 5
    stored = new.where("tag <> 'c'")
    again, _ = build.upsert_tags(facts, stored)
    assert {(r.graph_id, r.tag, r.tag_id) for r in again.collect()} == {("g", "c", 2), ("h", "c", 0)}


def test_insert_batch(spark):
    steps = spark.createDataFrame(
        [("g", 7, 0, 0, "o0", "a0", "s"), ("g", 7, 0, 1, "o1", "a1", "s"), ("g", 3, 0, 0, "p0", "q0", "r")],
        "graph_id string, insert_id long, trajectory_num int, turn_num int, observation string, action string, session_id string",
    )
    facts = spark.createDataFrame(
        [("g", 7, 0, "one", ["x", "x", "y"], 0, 1), ("g", 7, 1, "", ["z"], 0, 0), ("g", 7, 2, "two", ["y"], 5, 5), ("g", 3, 0, "zero", [], None, None)],
        "graph_id string, insert_id long, fact_pos int, text string, tags array<string>, trajectory_num int, turn_num int",
    )
    procedures = spark.createDataFrame(
        [("g", 7, 0, "goal", "do it", 0, [1.0], [1.0]), ("g", 7, 1, "goal", "do more", 0, [1.0], [2.0]), ("g", 3, 0, "other", "", 0, [1.0], [1.0])],
        "graph_id string, insert_id long, proc_pos int, subgoal string, text string, trajectory_num int, embedding array<float>, subgoal_embedding array<float>",
    )
    out = build.insert_batch(steps, facts, procedures)
    semantic = {r.text: r for r in out["semantic"].collect()}
    assert {t: r.semantic_id for t, r in semantic.items()} == {"zero": 0, "one": 1, "two": 2}
    assert sorted(semantic["one"].tags) == ["x", "y"] and semantic["zero"].tag_ids == []
    edges = {(r.src_type, r.src_id, r.kind, r.dst_type, r.dst_id) for r in out["edges"].collect()}
    assert ("semantic", 1, "evidenced_by", "episodic", 2) in edges  # turn 1 of insert 7
    assert ("semantic", 2, "evidenced_by", "insert", 7) in edges  # out of range: the whole insert
    assert ("semantic", 0, "evidenced_by", "episodic", 0) in edges  # missing numbers mean 0
    assert {e for e in edges if e[2] == "grouped_by"} == {("procedural", 0, "grouped_by", "subgoal", 0), ("procedural", 1, "grouped_by", "subgoal", 0)}
    goal = out["subgoal"].first()
    assert goal.embedding == [2.0] and goal.time == 1 and out["subgoal"].count() == 1
    members = out["episodic"].select("graph_id", "insert_id", F.lit("episodic").alias("dst_type"), F.col("episodic_id").alias("dst_id")).unionByName(
        out["semantic"].select("graph_id", "insert_id", F.lit("semantic").alias("dst_type"), F.col("semantic_id").alias("dst_id"))
    )
    wanted = out["semantic"].where("text = 'two'").select("graph_id", F.col("semantic_id").alias("src_id"))
    opened = build.expand_links(out["edges"].where("src_type = 'semantic'"), members, wanted)
    assert {(r.kind, r.dst_id) for r in opened.collect()} == {("tagged", 1), ("evidenced_by", 1), ("evidenced_by", 2), ("related", 1)}


def _leaders(vectors, stored, same):
    leaders, follows = dict(stored), {}
    for key, v in sorted(vectors.items()):
        near = [(-round(_cos(v, u), 12), k) for k, u in leaders.items() if round(_cos(v, u), 12) >= same]
        if near:
            follows[key] = min(near)[1]
        else:
            leaders[key] = v
            follows[key] = key
    return follows


def test_similar_tags_equal_the_ordered_scan(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 5))
    vectors = {100 + i: (centres[i % 6] + 0.35 * rng.normal(size=5)).astype(np.float32).tolist() for i in range(50)}
    vectors[150] = vectors[103]
    stored = {i: centres[i].astype(np.float32).tolist() for i in range(2)}
    rows = spark.createDataFrame([("g", k, v) for k, v in vectors.items()], "graph_id string, tag_key long, embedding array<float>").repartition(3)
    old = spark.createDataFrame([("g", k, v) for k, v in stored.items()], "graph_id string, tag_id long, embedding array<float>")
    got = {r.tag_key: r.leader_key for r in build.match_or_create_tags(rows, old, same=0.9).collect()}
    assert got == _leaders(vectors, stored, 0.9)


def test_lineage(spark):
    edges = spark.createDataFrame([("g", 5, "derived_from", 3), ("g", 5, "derived_from", 4), ("g", 3, "derived_from", 1)], "graph_id string, src_id long, kind string, dst_id long")
    assert {(r.semantic_id, r.ancestor_id, r.depth) for r in build.lineage(edges).collect()} == {(5, 3, 1), (5, 4, 1), (3, 1, 1), (5, 1, 2)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 12)] + [(20, 21), (30, 22), (22, 40)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame([("g", a, b) for a, b in edges], "graph_id string, a long, b long")).collect()}
    assert set(got[i] for i in range(13)) == {0} and got[21] == 20 and got[40] == got[30] == 22


def _scan(facts, k, max_merges, threshold, decisions):
    """Sequential statement of the merge scan."""
    active = {f["id"] for f in facts}
    merges = []
    by_id = {f["id"]: f for f in facts}
    for f in sorted(facts, key=lambda f: f["id"]):
        if f["id"] not in active:
            continue
        scored = []
        for c in facts:
            if c["id"] > f["id"] and c["id"] in active and set(c["tags"]) & set(f["tags"]):
                scored.append((-round(_cos(f["v"], c["v"]), 12), c["id"]))
        done = 0
        for s, c in sorted(scored)[:k]:
            if -s < threshold or set(by_id[c]["ev"]) & set(f["ev"]):
                continue
            drop_a, drop_b = decisions.get((f["id"], c), (True, True))
            merges.append((f["id"], c))
            if drop_a:
                active.discard(f["id"])
            if drop_b:
                active.discard(c)
            done += 1
            if done >= max_merges:
                break
    return merges


@pytest.mark.parametrize("seed,k,max_merges,list_size,fold_size", [(1, 1, 1, 32, 1000), (2, 2, 2, 2, 3), (3, 1, 1, 1, 2), (4, 3, 1, 4, 5)])
def test_merges_equal_the_sequential_scan(spark, seed, k, max_merges, list_size, fold_size):
    rng = random.Random(seed)
    gen = np.random.default_rng(seed)
    centres = gen.normal(size=(4, 4))
    facts, decisions = [], {}
    for i in range(26):
        v = centres[i % 4] if i % 5 == 0 else centres[i % 4] + 0.5 * gen.normal(size=4)
        facts.append({"id": i, "v": v.astype(np.float32).tolist(), "tags": rng.sample(range(4), 2), "ev": [rng.randint(0, 9)]})
    for a in range(26):
        for b in range(a + 1, 26):
            if rng.random() < 0.5:
                decisions[(a, b)] = (rng.random() < 0.5, rng.random() < 0.5)
    df = spark.createDataFrame(
        [("g", f["id"], f["v"], f["tags"], f["ev"], True) for f in facts],
        "graph_id string, semantic_id long, embedding array<float>, tag_ids array<long>, episodic_ids array<long>, is_active boolean",
    )
    table = spark.createDataFrame([("g", a, b, x, y) for (a, b), (x, y) in decisions.items()], "graph_id string, id_a long, id_b long, deactivate_earlier boolean, deactivate_later boolean")
    got = consolidate.resolve_merges(
        df, scanner=F.col("is_active"), candidate=F.col("is_active"), decisions=table, threshold=0.6,
        value=ValueFunction(k=k), max_merges=max_merges, list_size=list_size, fold_size=fold_size,
    )
    want = _scan(facts, k, max_merges, 0.6, decisions)
    assert sorted((r.id_a, r.id_b) for r in got.collect()) == sorted(want) and want


def test_consolidation_run(spark):
    rows = [
        ("g", 0, "a", [1.0, 0.0], [1], ["t"], 0, True, 10, [5]), ("g", 1, "b", [1.0, 0.1], [1], ["t", "u"], 1, True, 10, [6]),
        ("g", 2, "c", [1.0, 0.0], [1], ["t"], 2, False, 10, [7]), ("g", 3, "d", [0.0, 1.0], [2], ["v"], 3, True, -5, [8]),
        ("g", 4, "e", [0.0, 1.0], [2], ["v"], 4, True, 10, [9]),
    ]
    facts = spark.createDataFrame(
        rows, "graph_id string, semantic_id long, text string, embedding array<float>, tag_ids array<long>, tags array<string>, time long, is_active boolean, credibility int, episodic_ids array<long>"
    )
    clock = spark.createDataFrame([("g", 5)], "graph_id string, now long")
    out = consolidate.consolidate(facts, clock, credibility_decay=6)
    stats = out["stats"].first()
    assert (stats.scanned, stats.skipped_inactive, stats.merged_pairs, stats.soft_deactivated) == (5, 2, 1, 1)
    merged = out["merged"].first()
    assert (merged.semantic_id, merged.text, sorted(merged.tags), sorted(merged.episodic_ids), merged.time) == (5, "a b", ["t", "u"], [5, 6], 5)
    assert {r.semantic_id: r.is_active for r in out["facts"].collect()} == {0: False, 1: False, 2: False, 3: False, 4: True}
    links = {(r.kind, r.dst_type, r.src_id, r.dst_id) for r in out["edges"].collect()}
    assert {x for x in links if x[0] == "derived_from"} == {("derived_from", "semantic", 5, 0), ("derived_from", "semantic", 5, 1)}
    assert {x[3] for x in links if x[0] == "tagged"} == {1} and {x[3] for x in links if x[0] == "evidenced_by"} == {5, 6}


def test_many_copies_equal_the_sequential_scan(spark):
    gen = np.random.default_rng(9)
    base = [gen.normal(size=4).astype(np.float32).tolist() for _ in range(3)]
    facts = [{"id": i, "v": base[0 if i % 4 else i % 3], "tags": [1], "ev": [i]} for i in range(40)]
    df = spark.createDataFrame(
        [("g", f["id"], f["v"], f["tags"], f["ev"], True) for f in facts],
        "graph_id string, semantic_id long, embedding array<float>, tag_ids array<long>, episodic_ids array<long>, is_active boolean",
    )
    copies, rest = consolidate._next_copies(df, df, 4)
    assert copies.count() > 60 and rest.count() < 20
    keep = {(a, b): (False, True) for a in range(0, 40, 3) for b in range(40)}
    table = spark.createDataFrame([("g", a, b, x, y) for (a, b), (x, y) in keep.items()], "graph_id string, id_a long, id_b long, deactivate_earlier boolean, deactivate_later boolean")
    got = consolidate.resolve_merges(df, scanner=F.col("is_active"), candidate=F.col("is_active"), decisions=table, threshold=0.6, list_size=4)
    assert sorted((r.id_a, r.id_b) for r in got.collect()) == sorted(_scan(facts, 1, 1, 0.6, keep))


def test_fold_holds_columns_not_rows():
    n, size = 5000, 32
    a = np.repeat(np.arange(n), size)
    place = np.tile(np.arange(1, size + 1), n)
    order = np.random.default_rng(4).permutation(n * size)
    no, yes = np.zeros(n * size, bool), np.ones(n * size, bool)
    columns = {"id_a": a, "id_b": a + place, "place": place.astype(np.int32), "score": 1.0 - place / 100, "full": yes, "barred": no, "deactivate_a": yes, "deactivate_b": yes}
    rows = pa.table({name: column[order] for name, column in columns.items()})
    tracemalloc.start()
    out = consolidate._folder(1, 1)((pa.scalar("g"), pa.scalar(-1)), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    merges = out.filter(pa.compute.equal(out["event"], "merge"))
    assert merges["id_a"].to_pylist() == list(range(0, n, 2)) and merges["id_b"].to_pylist() == list(range(1, n + 1, 2))
    assert set(out["graph_id"].to_pylist()) == {"g"} and peak < 12 << 20
