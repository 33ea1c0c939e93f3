"""Commits of the store: all or nothing whatever write fails, old versions, retries, conflicts, compaction."""

import pytest
from pyspark.sql import functions as F

from mnemolake import schema
from mnemolake.operators import build
from mnemolake.sources import commits
from mnemolake.sources.tables import MemoryStore

SAVED = ("episodic", "semantic", "tag", "procedural", "edges", "subgoal")


def _rows(spark, store, batch_id):
    """Two near-equal facts of one tag and one episode each."""
    at = spark.createDataFrame([("g:1", batch_id * 10 + k, f"obs {k}", f"fact {k}", [1.0, 0.02 * k], ["tag"]) for k in range(2)], "graph_id string, insert_id long, observation string, text string, embedding array<float>, tags array<string>")
    base = at.withColumn("trajectory_num", F.lit(0)).withColumn("turn_num", F.lit(0)).withColumn("session_id", F.lit("s"))
    steps = base.withColumn("action", F.lit("a"))
    facts = base.withColumn("fact_pos", F.lit(0))
    goals = base.withColumn("proc_pos", F.lit(0)).withColumn("subgoal", F.lit("goal")).withColumn("subgoal_embedding", F.array(F.lit(1.0)).cast("array<float>"))
    return build.insert_batch(steps, facts, goals, store.begin_batch(batch_id), embed=lambda tag: F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))


def _content(store, version=None):
    return {t: sorted(map(str, store.load(t, version=version).collect())) for t in SAVED}


def _run(store):
    """What a consolidation hands on: both facts give way to a third one."""
    facts = store.load("semantic", version=0)
    merged = facts.where("semantic_id = 0").withColumn("semantic_id", F.lit(2).cast("long")).withColumn("text", F.lit("fact 0 fact 1"))
    edges = facts.select("graph_id", F.lit("semantic").alias("src_type"), F.lit(2).alias("src_id"), F.lit("derived_from").alias("kind"), F.lit("semantic").alias("dst_type"), F.col("semantic_id").alias("dst_id"))
    return {"facts": facts.withColumn("is_active", F.lit(False)), "merged": merged, "edges": edges}


class Stopped(Exception):
    pass


def _failing(monkeypatch, store, nth):
    """Let the store's ``nth`` write fail before or after it wrote its folder."""
    real, seen = store._write, []

    def write(table, rows, **more):
        seen.append(table)
        if len(seen) == nth:
            rows.write.partitionBy("graph_id").parquet(f"{store.path(table)}/commit=half{len(seen)}-{id(seen)}")
            raise Stopped
        real(table, rows, **more)

    monkeypatch.setattr(store, "_write", write)


@pytest.mark.parametrize("nth", [5])
def test_insert_is_all_or_nothing(spark, tmp_path, monkeypatch, nth):
    store = MemoryStore(spark, str(tmp_path / "store"))
    with monkeypatch.context() as broken, pytest.raises(Stopped):
        _failing(broken, store, nth)
        store.save_insert(_rows(spark, store, 0), batch="loader/0")
    fresh = MemoryStore(spark, store.root)
    assert fresh.version() == -1 and all(not rows for rows in _content(fresh).values()) and not fresh.committed("loader/0")
    fresh.save_insert(_rows(spark, fresh, 0), batch="loader/0")
    once = _content(fresh)
    fresh.save_insert(_rows(spark, fresh, 0), batch="loader/0")
    assert _content(fresh) == once and fresh.version() == 0 and len(once["semantic"]) == 2
    assert fresh.vacuum() >= 1 and _content(fresh) == once


def test_consolidation_is_all_or_nothing_and_inserts_can_be_replayed(spark, tmp_path, monkeypatch):
    store = MemoryStore(spark, str(tmp_path / "store"))
    store.save_insert(_rows(spark, store, 0))
    before = _content(store)
    for nth in (2, 3):
        with monkeypatch.context() as broken, pytest.raises(Stopped):
            _failing(broken, store, nth)
            store.save_consolidation(_run(store))
        assert _content(MemoryStore(spark, store.root)) == before
    store.save_consolidation(_run(store), batch="run")
    after = _content(store)
    assert [r.is_active for r in store.load("semantic").orderBy("semantic_id").collect()] == [False, False, True]
    store.save_consolidation(_run(store), batch="run")
    store.save_insert(_rows(spark, store, 0))  # the insert tried again, after its facts were patched
    assert _content(store) == after
    assert _content(store, version=0) == before
    clash = store.load("semantic", version=0).withColumn("text", F.lit("other"))
    with pytest.raises(ValueError, match="other content"):
        store.append("semantic", clash)


def _fact(graph, i, text="t"):
    return {f: None for f in (c.split()[0] for c in schema.SEMANTIC.split(", "))} | {"graph_id": graph, "semantic_id": i, "text": text, "is_active": True}


def test_two_writers(spark, tmp_path):
    one, two = (MemoryStore(spark, str(tmp_path / "store")) for _ in range(2))
    facts = lambda graph, i: spark.createDataFrame([_fact(graph, i)], schema.SEMANTIC)
    with one.transaction():
        one.append("semantic", facts("a", 0))
        two.append("semantic", facts("b", 0))
        assert one.load("semantic").count() == 1  # what it began on, and its own rows
    assert two.version() == 1 and two.load("semantic").count() == 2
    with pytest.raises(commits.CommitConflict):
        with one.transaction():
            one.patch("semantic", spark.createDataFrame([("a", 0, False)], "graph_id string, semantic_id long, is_active boolean"))
            two.append("semantic", facts("a", 1))
    assert one.load("semantic").where("is_active").count() == 3
    assert two.load("semantic", "a", version=1).count() == 1


def test_folded_log_compaction_and_odd_graph_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "FOLD", 3)
    store = MemoryStore(spark, str(tmp_path / "store"))
    names = ["a/b", "c=d", "é x", "a%b"]
    for i in range(4):
        store.append("semantic", spark.createDataFrame([_fact(g, i) for g in names], schema.SEMANTIC))
    store.patch("semantic", spark.createDataFrame([("c=d", 2, False)], "graph_id string, semantic_id long, is_active boolean"))
    want = sorted((g, i, not (g == "c=d" and i == 2)) for g in names for i in range(4))
    rows = lambda **v: sorted((r.graph_id, r.semantic_id, r.is_active) for r in store.load("semantic", **v).collect())
    assert rows() == want
    assert any(n.endswith(".state.json") for n in store.log.names())
    store.compact("semantic")
    assert rows() == want and len(store._state().paths("semantic")) == 1
    store.delete_graph("a/b")
    assert rows() == [r for r in want if r[0] != "a/b"] and rows(version=5) == want
    store.vacuum()
    assert rows() == [r for r in want if r[0] != "a/b"]
