import json
import random

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import ingest

RAW = "session_id string, ord long, role string, content string, toolName string, isError boolean, command string, output string, exitCode int"


def _flat(spark, rows):
    full = [(s, o, r.get("role"), r.get("content"), r.get("toolName"), r.get("isError"), r.get("command"), r.get("output"), r.get("exitCode")) for s, o, r in rows]
    return ingest.flatten_messages(spark.createDataFrame(full, RAW))


def test_tool_turns_bash_and_errors(spark):
    call = json.dumps([{"type": "text", "text": "look"}, {"type": "toolCall", "name": "grep", "arguments": {"q": "x" * 90, "n": 3}}])
    rows = [
        ("a", 0, {"role": "system", "content": "ignored"}),
        ("a", 1, {"role": "user", "content": "first"}),
        ("a", 2, {"role": "user", "content": json.dumps([{"type": "text", "text": "second"}, {"type": "image"}])}),
        ("a", 3, {"role": "assistant", "content": call}),
        ("a", 4, {"role": "toolResult", "toolName": "grep", "isError": True, "content": "y" * 600}),
        ("a", 5, {"role": "bashExecution", "command": "ls", "output": "out", "exitCode": 2}),
        ("a", 6, {"role": "bashExecution", "command": "", "output": "", "exitCode": 0}),
        ("a", 7, {"role": "assistant", "content": ""}),
        ("a", 8, {"role": "assistant", "content": "done"}),
        ("a", 9, {"role": "assistant", "content": "nothing pending"}),
        ("a", 10, {"role": "user", "content": "tail"}),
    ]
    steps = ingest.messages_to_steps(_flat(spark, rows)).orderBy("step").collect()
    assert [(s.step, s.observation) for s in steps] == [
        (0, "first\nsecond"), (1, "[ERROR from grep] " + "y" * 600 + "\n[bash exit=2] ls\nout\n[bash] bash"),
    ]
    assert steps[0].action == "look\n[grep(q=" + "x" * 90 + ", n=3)]" and steps[1].action == "done"


def _pair(messages):
    steps, pending = [], None
    for role, text in messages:
        if role == "user" and text:
            pending = text if pending is None else pending + "\n" + text
        elif role == "assistant" and text and pending is not None:
            steps.append((pending, text))
            pending = None
    return steps


def test_pairing_equals_the_state_machine(spark, monkeypatch):
    rng = random.Random(1)
    sessions = {f"s{i}": [(rng.choice(["user", "assistant", "system"]), rng.choice(["", "a", "b", "c"])) for _ in range(rng.randint(0, 12))] for i in range(60)}
    rows = [(s, i, {"role": r, "content": t}) for s, ms in sessions.items() for i, (r, t) in enumerate(ms)]
    want = {(s, i, o, a) for s, ms in sessions.items() for i, (o, a) in enumerate(_pair(ms))}
    lines = _flat(spark, rows).repartition(5)
    for limit in (1 << 20, 3):
        monkeypatch.setattr("mnemolake.operators.ordered.GROUP_ROWS", limit)
        got = ingest.messages_to_steps(lines).collect()
        assert {(r.session_id, r.step, r.observation, r.action) for r in got} == want


def _dialogue(turns):
    blocks = []
    for role, text in turns:
        if role == "user":
            blocks.append([text, None])
        else:
            if not blocks:
                blocks.append([None, None])
            blocks[-1][1] = text
    if blocks and blocks[-1][1] is None:
        blocks.pop()
    return [(f"User Say: {u or '...'}", f"Agent Say: {a or '...'}") for u, a in blocks]


def test_dialogues(spark):
    rng = random.Random(2)
    sessions = {f"s{i}": [(rng.choice(["user", "assistant"]), f"t{j}") for j in range(rng.randint(1, 9))] for i in range(60)}
    rows = [(s, j, r, t) for s, ts in sessions.items() for j, (r, t) in enumerate(ts)]
    got = ingest.dialogue_to_steps(spark.createDataFrame(rows, "session_id string, turn long, role string, text string"))
    assert {(r.session_id, r.step, r.observation, r.action) for r in got.collect()} == {
        (s, i, o, a) for s, ts in sessions.items() for i, (o, a) in enumerate(_dialogue(ts))
    }


def test_goal_and_minimum(spark):
    lines = _flat(spark, [("a", 0, {"role": "user", "content": ""}), ("a", 1, {"role": "user", "content": "g" * 250}), ("b", 0, {"role": "assistant", "content": "x"})])
    assert {r.session_id: r.goal for r in ingest.infer_goal(lines).collect()}["a"] == "g" * 250
    goals = {r.session_id: r.goal for r in ingest.infer_goal(lines, limit=ingest.GOAL_CHARS).collect()}
    assert goals["b"] == "Agent session" and goals["a"] == "g" * 199 + "…"
    steps = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "session_id string, step long")
    assert {r.session_id for r in ingest.long_enough(steps).collect()} == {"a"}


def test_chunks_equal_the_loop(spark):
    texts = {0: "", 1: "  ", 2: "ab" * 50, 3: "é" * 130 + " " * 40 + "z" * 33, 4: "q" * 64, 5: "w" * 100, 6: "line\n" * 41}

    def loop(text, size=64, overlap=16):
        out, start, i = [], 0, 0
        while start < len(text):
            end = min(start + size, len(text))
            piece = text[start:end].strip()
            if piece:
                out.append((i, piece))
            if end == len(text):
                break
            start, i = start + size - overlap, i + 1
        return out

    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    got = {(r.doc_id, r.chunk, r.chunk_text) for r in ingest.chunk_text(docs, size=64, overlap=16).collect()}
    assert got == {(d, i, c) for d, t in texts.items() for i, c in loop(t)}
    with pytest.raises(ValueError):
        ingest.chunk_text(docs, size=10, overlap=10)


def test_segments(spark):
    vecs = {"x": [1.0, 0.0], "y": [0.0, 1.0], "x2": [1.0, 0.1]}
    names = ["x", "x2", "y", "y", "x", "x"]
    rows = spark.createDataFrame([("s", i, vecs[n]) for i, n in enumerate(names)], "session_id string, step long, subgoal_embedding array<float>")
    got = ingest.segment_trajectories(rows, ["session_id"]).orderBy("step").collect()
    assert [(r.trajectory_num, r.turn_num) for r in got] == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1)]
    assert got[0].similarity_subgoal == -1.0


def test_flat_episodes_and_shift(spark):
    flat = spark.createDataFrame([("i", ["a", "b"], [("f", 3)]), ("j", [], [("h", 4)])], "id string, episodic array<string>, semantic array<struct<text string, trajectory_num int>>")
    out = {r.id: r for r in ingest.nest_flat_episodes(flat).collect()}
    assert out["i"].semantic[0].trajectory_num == 0 and out["j"].semantic[0].trajectory_num == 4 and len(out["i"].episodic) == 1
    steps = spark.createDataFrame([(1, i, f"o{i}") for i in range(4)], "k int, turn_num long, observation string")
    assert [r.observation for r in ingest.observation_shift(steps, ["k"]).orderBy("turn_num").collect()] == ["o0", "o0", "o1", "o2"]


def test_validation(spark):
    ddl = "steps array<struct<observation string, action string>>, semantic_facts array<string>, queries array<struct<question string, gold string>>"
    good = ([("o", "a")], ["f"], [("q", "g")])
    rows = [good, ([], ["f"], [("q", "g")]), ([("o", None)], ["f"], [("q", "g")]), (None, ["f"], [("q", "g")]), ([("o", "a")], ["f"], [(None, "g")])]
    got = [r.e for r in spark.createDataFrame(rows, ddl).select(ingest.invalid_trajectory(1, 1).alias("e")).collect()]
    assert got == [None, "steps:size:0", "steps:null", "steps:size:0", "queries:null"]


def test_embedding_cache(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "text string")
    joined, fresh = ingest.embed_texts(rows, "text")
    assert fresh.count() == 2 and joined.where("embedding is null").count() == 1
    _, again = ingest.embed_texts(rows, "text", cache=fresh)
    assert again.count() == 0
    _, anew = ingest.embed_texts(rows, "text", cache=fresh, refresh=True)
    assert anew.count() == 2


def test_user_embedder(spark):
    def embedder(batches):
        for pdf in batches:
            yield pdf.assign(embedding=[[float(len(t))] for t in pdf["text"]])[["text_hash", "embedding"]]

    joined, _ = ingest.embed_texts(spark.createDataFrame([("abc",)], "text string"), "text", model="len", embedder=embedder)
    assert joined.first().embedding == [3.0]


def test_context_window(spark):
    text = "\n".join(f"[{i}] line" for i in range(20))
    row = spark.createDataFrame([(text, "click [7]"), ("no brackets 9 here\nx", "type [9]"), (text, "stop"), (text, "click [99]")], "t string, a string")
    got = [r.c for r in row.select(ingest.context_window(F.col("t"), F.col("a")).alias("c")).collect()]
    assert got[0] == "\n".join(f"[{i}] line" for i in range(2, 13)) and got[1] == "no brackets 9 here\nx" and got[2:] == ["", ""]
