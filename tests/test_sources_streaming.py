import json

from pyspark.sql import functions as F

from mnemolake import schema
from mnemolake.operators import ingest
from mnemolake.sources import importers, records, tables
from mnemolake.sources.tables import MemoryStore
from mnemolake.streaming import jobs


def _fact(i, text="t", active=True, graph="g"):
    return (graph, i, text, [1.0], ["a"], [0], i, active, 10, "", "s", 0)


def test_store(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path))
    rows = spark.createDataFrame([_fact(0), _fact(1), _fact(0, graph="h")], schema.SEMANTIC)
    store.create_graph(rows)
    store.append("semantic", rows)
    store.append("semantic", rows)  # a retry adds nothing
    assert store.load("semantic").count() == 3 and store.load("semantic", "h").count() == 1
    store.patch("semantic", spark.createDataFrame([("g", 1, False)], "graph_id string, semantic_id long, is_active boolean"))
    assert {(r.graph_id, r.semantic_id, r.is_active, r.text) for r in store.load("semantic").collect()} == {("g", 0, True, "t"), ("g", 1, False, "t"), ("h", 0, True, "t")}
    store.upsert("semantic", spark.createDataFrame([_fact(1, "new"), _fact(2)], schema.SEMANTIC))
    assert store.get("semantic", "g", 1).first().text == "new" and store.get("semantic", "g", 99).isEmpty()
    assert [r.graph_id for r in store.graphs().collect()] == ["g", "h"] and store.graph_exists("h")
    assert {r.graph_id: r.semantic for r in store.counts().collect()} == {"g": 3, "h": 1}
    store.delete_graph("g")
    assert not store.graph_exists("g") and store.load("semantic").count() == 1 and store.load("tag").isEmpty()


def test_blocks(spark):
    rows = spark.createDataFrame([(0, "a"), (11, "b"), (25, "c")], "node_id long, v string")
    current = rows.withColumn("block", tables.block_of("node_id", 10))
    out = tables.upsert_blocks(current, spark.createDataFrame([(11, "B"), (12, "d")], "node_id long, v string"), "node_id", 10)
    assert {(r.node_id, r.v, r.block) for r in out.collect()} == {(11, "B", 1), (12, "d", 1)}


def test_one_file_graph(spark, tmp_path):
    doc = {
        "session_ids": [], "episodic_nodes": [{"episodic_id": 4, "observation": "o", "time": 3}],
        "semantic_nodes": [{"semantic_id": 2, "semantic_memory": "m", "tags": ["t"], "episodic_nodes": [4, 9], "semantic_embedding": [0.5, 0.5]}],
        "tag_nodes": [{"tag_id": 0, "tag": "t", "semantic_nodes": [2, 77], "importance": 3}], "subgoal_nodes": [{"subgoal": "s", "subgoal_id": 50}],
        "procedural_nodes": [{"procedural_memory": "p", "return": 2}],
    }
    (tmp_path / "g.json").write_text(json.dumps(doc))
    nodes = importers.read_one_file_graph(spark, str(tmp_path / "g.json"), "g")
    fact, sub, proc = nodes["semantic"].first(), nodes["subgoal"].first(), nodes["procedural"].first()
    assert fact.embedding == [0.5, 0.5] and fact.episodic_ids == [4, 9] and fact.time == 0 and fact.credibility == 10
    assert sub.subgoal_id == 0 and len(sub.embedding) == 32 and proc.procedural_id == 0 and proc.return_value == 2.0
    assert nodes["episodic"].first().time == "3" and nodes["tag"].first().importance == 3
    edges = {(r.kind, r.src_id, r.dst_id) for r in importers.rebuild_edges(nodes).collect()}
    assert edges == {("evidenced_by", 2, 4), ("tagged", 2, 0)}


def _write(folder, name, number, item):
    (folder / name).mkdir(exist_ok=True)
    (folder / name / f"{name}_{number}.json").write_text(json.dumps(item, indent=1))


def test_directory_and_numbered_graphs(spark, tmp_path):
    for n in (2, 10, 0):
        _write(tmp_path, "semantic_memory", n, {"semantic_memory": f"m{n}", "episodic_id": 7})
        _write(tmp_path, "episodic_memory", n, {"episodic_memory": f"e{n}", "time": n})
    _write(tmp_path, "subgoal", 0, {"subgoal": "s", "procedural_ids": [0]})
    _write(tmp_path, "procedural_memory", 0, {"procedural_memory": "p", "subgoal_embedding": [1.0], "return": 1.5})
    _write(tmp_path, "tag", 0, {"tag": "t", "tag_id": 8})
    by_name = importers.read_directory_graph(spark, str(tmp_path), "g")
    assert {r.text: r.semantic_id for r in by_name["semantic"].collect()} == {"m0": 0, "m10": 1, "m2": 2}
    assert {r.observation for r in by_name["episodic"].collect()} == {"e0", "e2", "e10"} and by_name["tag"].first().tag_id == 8
    assert by_name["semantic"].first().episodic_ids == [7]
    numbered = importers.read_numbered_graph(spark, str(tmp_path), "g")
    assert {r.text: r.semantic_id for r in numbered["semantic"].collect()} == {"m0": 0, "m2": 1, "m10": 2}
    kept = importers.read_numbered_graph(spark, str(tmp_path), "g", keep_gaps=True)
    assert {r.text: (r.semantic_id, r.time) for r in kept["semantic"].collect()} == {"m0": (0, 0), "m2": (2, 2), "m10": (10, 10)}
    assert numbered["procedural"].first().embedding == [1.0]
    edges = {(r.kind, r.src_id, r.dst_id) for r in importers.rebuild_edges(numbered).collect()}
    assert ("grouped_by", 0, 0) in edges


def test_session_logs(spark, tmp_path):
    lines = [{"type": "meta"}, {"type": "message", "message": {"role": "user", "content": "hi"}}, "{broken", "", {"type": "message"},
             {"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "yo"}]}}]
    (tmp_path / "s1.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    messages = records.read_sessions(spark, str(tmp_path))
    steps = ingest.messages_to_steps(ingest.flatten_messages(messages)).collect()
    assert [(r.session_id, r.observation, r.action) for r in steps] == [("s1", "hi", "yo")]


def test_questions_and_records(spark, tmp_path):
    items = [{"_id": f"q{i}", "question": "?", "answer": "a", "context": [["T", ["s0", "s1"]]], "supporting_facts": [["T", 1]]} for i in range(4)]
    (tmp_path / "qa.json").write_text(json.dumps(items))
    rows = records.read_questions(spark, str(tmp_path / "qa.json"))
    part = records.sliced(rows, 1, 2).collect()
    assert {r.id for r in part} == {"q1", "q2"} and part[0].context[0].sents == ["s0", "s1"] and part[0].supporting_facts[0].idx == 1
    assert {r.id for r in records.not_done(rows, spark.createDataFrame([("q0",), ("q3",)], "id string")).collect()} == {"q1", "q2"}
    (tmp_path / "usage.jsonl").write_text('{"model": "m", "input_tokens": 3, "extra": {"judge_score": 2}}\n\n{"model": "n"}\n')
    usage = records.read_usage(spark, str(tmp_path / "usage.jsonl"))
    records.append_usage(usage, str(tmp_path / "out"))
    records.append_usage(usage, str(tmp_path / "out"))
    assert usage.count() == 2 and records.read_usage(spark, str(tmp_path / "out")).count() == 4
    (tmp_path / "obj.jsonl").write_text('{"objective": "o", "entry_text": "e", "embedding": [1.0]}\n{"objective": "x"}\n')
    assert records.read_objectives(spark, str(tmp_path / "obj.jsonl")).first().embedding == [1.0]
    assert len(records.read_objectives(spark, str(tmp_path / "obj.jsonl"), refresh=True).first().embedding) == 32
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "12.json").write_text('{"trajectory": [{"observation": "a", "action": "b"}]}')
    assert tuple(records.read_recorded_trajectories(spark, str(tmp_path / "t")).first()) == ("12", 0, "a", "b")


def test_stream_equals_batch(spark, tmp_path):
    ddl = "session_id string, ord long, part string, line string"
    rows = [("a", 0, "observation", "u"), ("a", 1, "observation", "v"), ("b", 0, "action", "early"), ("a", 2, "action", "x"), ("b", 1, "observation", "q"),
            ("a", 3, "observation", "w"), ("b", 2, "action", "r"), ("a", 4, "action", "y"), ("a", 5, "observation", "tail")]
    for i in range(0, 9, 3):
        spark.createDataFrame(rows[i : i + 3] + ([rows[0]] if i else []), ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = (
        jobs.stream_steps(source).writeStream.format("parquet").trigger(availableNow=True)
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
    )
    assert running.awaitTermination(90)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {tuple(r) for r in ingest.messages_to_steps(spark.createDataFrame(rows, ddl)).collect()}
    assert got == want == {("a", 0, "u\nv", "x"), ("a", 1, "w", "y"), ("b", 0, "q", "r")}


def test_windows_batch(spark):
    rows = [("g", 1, "2024-01-01 10:00:00", "retrieve", "m", 2), ("g", 1, "2024-01-01 10:00:00", "retrieve", "m", 2), ("g", 2, "2024-01-01 23:00:00", "retrieve", "m", 3)]
    audit = spark.createDataFrame(rows, "graph_id string, recall_id long, ts string, endpoint string, mode string, n_messages int").withColumn("ts", F.to_timestamp("ts"))
    row = jobs.audit_windows(audit).first()
    assert (row.n_recalls, row.n_messages) == (2, 5)


def test_batch_tried_again_adds_nothing(spark, tmp_path):
    from mnemolake.operators import build

    store = MemoryStore(spark, str(tmp_path))
    step = "graph_id string, insert_id long, trajectory_num int, turn_num int, observation string, action string, session_id string"
    fact = "graph_id string, insert_id long, fact_pos int, text string, tags array<string>, trajectory_num int, turn_num int"
    proc = "graph_id string, insert_id long, proc_pos int, subgoal string, text string, trajectory_num int, embedding array<float>, subgoal_embedding array<float>"

    def rows(insert_id):
        steps = spark.createDataFrame([("g", insert_id, 0, 0, "o", "a", "s")], step)
        facts = spark.createDataFrame([("g", insert_id, 0, f"fact {insert_id}", ["t"], 0, 0)], fact)
        procedures = spark.createDataFrame([("g", insert_id, 0, "goal", "do", 0, [1.0], [float(insert_id)])], proc)
        return build.insert_batch(steps, facts, procedures, store.begin_batch(insert_id))

    store.save_insert(rows(0))
    partial = rows(1)
    store.append("episodic", partial["episodic"])  # stops half way
    store.save_insert(rows(1))
    store.save_insert(rows(1))
    counts = store.counts().first()
    assert (counts.episodic, counts.semantic, counts.tag, counts.procedural, counts.subgoal) == (2, 2, 1, 2, 1)
    assert store.load("subgoal").first().embedding == [1.0]
    kinds = {r.kind: r.n for r in store.load("edges").groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"tagged": 2, "evidenced_by": 2, "related": 2, "grouped_by": 2, "from_session": 2}
