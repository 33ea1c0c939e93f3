"""The way through a store, and rules that must not drop rows."""

import pytest
from pyspark.sql import functions as F

from mnemolake import session
from mnemolake.functions.vector import hash_embedding
from mnemolake.operators import build, consolidate, ordered, retrieve, similarity
from mnemolake.sources import tables
from mnemolake.sources.tables import MemoryStore
from mnemolake.streaming import jobs

STEP = "graph_id string, insert_id long, trajectory_num int, turn_num int, observation string, action string, session_id string"
FACT = "graph_id string, insert_id long, fact_pos int, text string, tags array<string>, trajectory_num int, turn_num int"
PROC = "graph_id string, insert_id long, proc_pos int, subgoal string, text string, trajectory_num int"


def _batch(spark, store, insert_id, texts, stream="default", batch_id=0):
    steps = spark.createDataFrame([("g", insert_id, 0, k, f"o{insert_id}{k}", "a", "s") for k in range(2)], STEP)
    facts = spark.createDataFrame([("g", insert_id, k, t, ["water"], 0, 0 if k < 2 else 1) for k, t in enumerate(texts)], FACT)
    procedures = spark.createDataFrame([("g", insert_id, 0, "cook", "cook", 0)], PROC)
    embed = lambda c: hash_embedding(F.col(c), 32)
    facts = facts.withColumn("embedding", embed("text"))
    procedures = procedures.withColumn("embedding", embed("text")).withColumn("subgoal_embedding", embed("subgoal"))
    store.save_insert(build.insert_batch(steps, facts, procedures, store.begin_batch(batch_id, stream)))


def test_insert_store_retrieve_consolidate(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "memory"))
    _batch(spark, store, 1, ["water boils", "water boils", "water boils"])
    tables = store.load_all()
    vector = [r.e for r in spark.createDataFrame([("water",), ("water boils",), ("cook",)], "t string").select(hash_embedding(F.col("t"), 32).alias("e")).collect()]
    queries = spark.createDataFrame([("g", 1, "semantic_memory", vector[1], vector[2]), ("g", 2, "procedural_memory", vector[1], vector[2])], "graph_id string, query_id int, mode string, embedding array<float>, subgoal_embedding array<float>")
    tags = spark.createDataFrame([("g", 1, "water", vector[0])], "graph_id string, query_id int, query_tag string, embedding array<float>")
    answers = {r.query_id: r.text for r in retrieve.retrieve(queries, tags, tables).collect()}
    assert "water boils" in answers[1] and "cook" in answers[2]
    # facts 0 and 1 rest on one episode: they must not merge with each other, but either may with fact 2
    facts = consolidate.evidence_lists(store.load("semantic"), store.load("edges"))
    run = consolidate.consolidate(facts, retrieve.graph_clock(facts))
    assert {(r.id_a, r.id_b) for r in run["merges"].collect()} <= {(0, 2), (1, 2)}
    with pytest.raises(ValueError, match="evidence"):
        consolidate.consolidate(store.load("semantic"), retrieve.graph_clock(facts))["merges"].collect()
    store.save_consolidation(run)
    after = {r.semantic_id: r for r in store.load("semantic").collect()}
    n = len(after) - 3
    assert sum(not r.is_active for r in after.values()) == 2 * n
    _batch(spark, store, 2, ["later"], batch_id=1)
    later = store.load("semantic").where("text = 'later'").first()
    assert (later.semantic_id, later.time) == (3 + n, max(r.time for r in after.values()) + 1)


def test_two_streams_into_one_store(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "memory"))
    _batch(spark, store, 1, ["a", "b"], "first", 0)
    _batch(spark, store, 2, ["c", "d"], "second", 0)
    assert sorted(r.text for r in store.load("semantic").collect()) == ["a", "b", "c", "d"]
    clash = store.load("semantic").where("text = 'a'").withColumn("text", F.lit("other"))
    with pytest.raises(ValueError, match="other content"):
        store.append("semantic", session.checkpointed(clash))


def test_missing_keys_survive_the_blocked_route(spark):
    rows = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 7), ("a", None, 8)], "k string, o long, v long")
    for small in (True, False):
        got = {(r.k, r.o): r.s for r in ordered.running_sum(rows, ["k"], ["o"], F.col("v"), "s", span=1, small=small).collect()}
        assert got == {(None, 1): 5, (None, 2): 11, ("a", None): 8, ("a", 1): 15}
        got = {(r.k, r.o): r.p and r.p.v for r in ordered.previous_row(rows, ["k"], ["o"], ["v"], "p", span=1, small=small).collect()}
        assert got == {(None, 1): None, (None, 2): 5, ("a", None): None, ("a", 1): 8}


def test_lineage_of_a_hundred_levels(spark):
    edges = spark.createDataFrame([("g", k + 1, "derived_from", k) for k in range(100)], "graph_id string, src_id long, kind string, dst_id long")
    got = build.lineage(edges)
    assert got.count() == 100 * 101 // 2
    assert {r.depth for r in got.where("semantic_id = 100 and ancestor_id = 0").collect()} == {100}


def test_messages_in_any_order_over_several_triggers(spark, tmp_path):
    ddl = "session_id string, ord long, part string, line string"
    rows = [("a", 0, "observation", "u"), ("a", 1, None, None), ("a", 2, "action", "x"), ("a", 3, "observation", "w"), ("a", 4, "action", "y")]
    for n, part in enumerate((rows[3:], rows[1:3], rows[:2])):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    running = (
        jobs.stream_steps(stream).writeStream.format("parquet").trigger(availableNow=True)
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
    )
    assert running.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 0, "u", "x"), ("a", 1, "w", "y")}


def test_open_windows_and_late_files_count(spark, tmp_path):
    ddl = "graph_id string, recall_id long, ts timestamp, endpoint string, mode string, n_messages int"
    day = lambda d: F.to_timestamp(F.lit(f"2024-01-{d:02d} 10:00:00"))
    for n, d in enumerate((20, 5, 21)):
        spark.range(2).select(F.lit("g").alias("graph_id"), (F.col("id") + 10 * n).alias("recall_id"), day(d).alias("ts"), F.lit("e").alias("endpoint"), F.lit("m").alias("mode"), F.lit(1).alias("n_messages")).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = jobs.latest_windows(jobs.audit_windows(stream, late="31 days"), ["window_start", "endpoint", "mode"], str(tmp_path / "run"))
    assert sorted((r.window_start.day, r.n_recalls) for r in got.collect()) == [(5, 2), (20, 2), (21, 2)]


def test_vectors_of_unequal_width_are_refused(spark):
    nodes = spark.createDataFrame([("g", 1, [1.0] * 32), ("g", 2, [1.0] * 96)], "graph_id string, semantic_id long, embedding array<float>")
    asked = spark.createDataFrame([("g", 1, [1.0] * 64)], "graph_id string, query_id long, embedding array<float>")
    with pytest.raises(Exception, match="unequal width"):
        similarity.nearest(asked, nodes.coalesce(1), k=1).collect()


def test_many_graphs_in_one_batch(spark):
    nodes = spark.range(10_000).select(F.concat(F.lit("g"), "id").alias("graph_id"), F.col("id").alias("semantic_id"), F.array(F.lit(1.0), F.col("id") * 1.0).cast("array<float>").alias("embedding"))
    asked = nodes.where("semantic_id % 50 = 0").select("graph_id", F.col("semantic_id").alias("query_id"), "embedding")
    got = similarity.nearest(asked, nodes.coalesce(1), k=1)
    assert got.count() == 200 and got.where("query_id <> semantic_id").count() == 0


def test_shared_folder_is_required_off_one_machine(spark):
    for master in ("local", "local[2]", "local[*]"):
        session.require_local(master)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.require_local(master)
    import os

    folder = session.run_folder(spark)
    spark.range(1).write.parquet(f"{folder}/x")
    session.remove_run_files(spark)
    assert not os.path.exists(folder.removeprefix("file:"))


def test_a_block_is_one_file_however_its_rows_are_dealt(spark, tmp_path):
    rows = spark.range(200).select("id", F.lit("x").alias("text")).repartition(7)
    for _ in range(2):  # written again, it is replaced
        tables.write_blocks(rows, "id", 20, str(tmp_path / "blocks"))
    assert len(list(tmp_path.glob("blocks/block=*/*.parquet"))) == 10
    assert spark.read.parquet(str(tmp_path / "blocks")).where("block = id div 20").count() == 200


def test_an_insert_is_written_once_and_nowhere_else(spark, tmp_path, monkeypatch):
    settled = []
    monkeypatch.setattr(tables, "checkpointed", lambda df: settled.append(df.columns) or session.checkpointed(df))
    store = MemoryStore(spark, str(tmp_path / "memory"))
    _batch(spark, store, 1, ["a", "b", "c"])
    _batch(spark, store, 1, ["a", "b", "c"])  # again: nothing is added
    _batch(spark, store, 2, ["d"], batch_id=1)
    assert sorted((r.semantic_id, r.text, r.time) for r in store.load("semantic").collect()) == [(0, "a", 0), (1, "b", 1), (2, "c", 2), (3, "d", 3)]
    assert [r.graph_id for r in store.graphs().collect()] == ["g"]
    # whole rows go to the store's files, not to checkpoints before
    assert not any("text" in columns for columns in settled)
    # no file without a reader is left by the first insert; the repeated one wrote its rows before it found them stored
    live = store._state().live["semantic"]
    assert {p.name[7:] for p in (tmp_path / "memory" / "semantic").glob("commit=*") if list(p.glob("graph_id=*"))} == set(live)


def test_repeated_rows_of_an_append_are_added_once(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path / "memory"))
    rows = spark.createDataFrame([("g x/1", i // 2, f"t{i // 2}") for i in range(8)] + [("", 9, "none"), (None, 9, "none")], "graph_id string, semantic_id long, text string")
    store.append("semantic", rows.limit(4))
    store.append("semantic", rows)
    store.append("semantic", rows.where("graph_id <> ''"))
    assert sorted((r.graph_id or "", r.semantic_id, r.text) for r in store.load("semantic").collect()) == [("", 9, "none")] * 2 + [("g x/1", i, f"t{i}") for i in range(4)]


def _exchanges_of(plan, column):
    """Exchanges of an executed plan that move a column."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return _exchanges_of(plan.executedPlan(), column)
    if "QueryStage" in name:
        return _exchanges_of(plan.plan(), column)
    own = [plan.simpleString(200)] if name == "Exchange" and f"{column}#" in plan.output().toString() else []
    children = plan.children()
    return own + [x for i in range(children.size()) for x in _exchanges_of(children.apply(i), column)]


def test_texts_of_an_insert_meet_ids_and_clock_without_being_dealt_by_graph(spark):
    n = 20_000  # above the size that one window takes
    ids = spark.range(n, numPartitions=4)
    facts = ids.select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("graph_id"), F.col("id").alias("insert_id"), F.lit(0).alias("fact_pos"), F.lit(0).alias("trajectory_num"), F.lit(0).alias("turn_num"), F.concat(F.lit("t"), "id").alias("text"), F.array(F.lit("x")).alias("tags"))
    facts = facts.unionByName(facts.limit(1).withColumn("graph_id", F.lit(None))).withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>"))
    steps = facts.select("graph_id", "insert_id", "trajectory_num", "turn_num", F.lit("o").alias("observation"), F.lit("").alias("action")).limit(5)
    goals = facts.select("graph_id", "insert_id", F.lit(0).alias("proc_pos"), F.lit("s").alias("subgoal"), "text", "trajectory_num", "embedding", F.col("embedding").alias("subgoal_embedding")).limit(0)
    stored = {"semantic": spark.createDataFrame([("a", 6, 3), ("a", 4, 2)], "graph_id string, semantic_id long, time long")}
    old, rows_limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), ordered.GROUP_ROWS
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    ordered.GROUP_ROWS = 4096
    try:
        semantic = build.insert_batch(steps, facts, goals, stored)["semantic"].select("graph_id", "semantic_id", "insert_id", "time", "text", "tag_ids")
        rows = semantic.collect()
        moved = _exchanges_of(semantic._jdf.queryExecution().executedPlan(), "text")
    finally:
        ordered.GROUP_ROWS = rows_limit
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    first, tick = {"a": 7, "b": 0}, {"a": 4, "b": 0}
    assert len(rows) == n and all(
        (r.semantic_id, r.time, r.text, r.tag_ids) == (first[r.graph_id] + r.insert_id // 2, tick[r.graph_id] + r.insert_id // 2, f"t{r.insert_id}", [0]) for r in rows
    )
    assert len(moved) <= 2, moved  # to be numbered, and to meet their tags
