import json

import pytest
from pyspark.sql import functions as F

from mnemolake.functions import parse, templates


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "response string").select(*columns).first()


def test_sections(spark):
    r = F.col("response")
    row = one(spark, "x\n### Subgoal\n find it \n", parse.section_or_default(r, "Subgoal").alias("a"), parse.section_or_default(r, "Reward").alias("b"), parse.score(r).alias("c"))
    assert tuple(row) == ("find it", "<a reward>", 0.0)
    assert one(spark, "### Score\n 7.5\n", parse.score(r)).asDict() and one(spark, "### Score\n 7.5\n", parse.score(r))[0] == 7.5
    assert one(spark, "### Score\nhigh", parse.score(r))[0] == 0.0
    goal, insight = parse.procedure(r)
    assert tuple(one(spark, "### Goal\nG\n### Experiential Insight\nI\nJ", goal, insight)) == ("G", "I\nJ")
    assert tuple(one(spark, "nothing", goal, insight)) == ("<a goal>", None)
    assert one(spark, "### Memory Type\nepisodic_memory \nwhy", parse.mode(r))[0] == "episodic_memory" and one(spark, "", parse.mode(r))[0] == "semantic_memory"


def test_facts(spark):
    text = '### Facts\n1. **Statement:**  Water boils. \n **Tags:** ["physics", "water"]\n2. **Statement:** No tags here\n3. **Statement:** Ice melts\n**Tags:** water,water, `cold`:'
    rows = parse.facts(spark.createDataFrame([(1, text), (2, "no heading **Statement:** x\n**Tags:** y")], "k int, response string")).collect()
    assert [(r.k, r.text, r.tags) for r in rows] == [(1, "Water boils.", ["physics", "water"]), (1, "Ice melts", ["water", "cold"])]
    rows = parse.summaries(spark.createDataFrame([("1. **Summary:** a\nmore\n2. **Summary:** b", "1. **Summary:** c")], "observation_response string, action_response string")).collect()
    assert [(r.fact_pos, r.text) for r in rows] == [(0, "a\nmore"), (1, "b"), (2, "c")]


def test_plan(spark):
    goal, tags = parse.plan(F.col("response"))
    assert tuple(one(spark, '**Tags:** ["a", "b c"]\n### Next Subgoal\ngo\n', goal, tags)) == ("go", ["a", "b c"])
    assert tuple(one(spark, "**Tags:** ['a', 'it\\'s']\nx", goal, tags))[0] == "<the next subgoal>"
    assert tuple(one(spark, "**Tags:** ['a', 'b']\nx", goal, tags))[1] == ["a", "b"]
    assert tuple(one(spark, "**Tags:** none\nx", goal, tags))[1] == []


def test_merge_decision(spark):
    good = {"merged_statement": " m ", "relationship": "UPDATE_SAME_FACT", "deactivate_earlier": True, "deactivate_later": "False", "simple_reasoning": "r"}
    cases = [
        ("```json\n" + json.dumps(good) + "\n```", None), ("so " + json.dumps(good) + " ok", None), ("nothing", "no JSON object"), ("{broken", "no JSON object"),
        (json.dumps({**good, "relationship": "OTHER"}), "invalid relationship"), (json.dumps({**good, "merged_statement": " "}), "empty statement"),
        (json.dumps({**good, "deactivate_later": "maybe"}), "not a boolean"), (json.dumps({k: v for k, v in good.items() if k != "simple_reasoning"}), "missing keys"),
    ]
    rows = parse.merge_decision(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "k int, response string")).orderBy("k").collect()
    assert [r.error for r in rows] == [c[1] for c in cases]
    assert (rows[0].merged_statement, rows[0].deactivate_earlier, rows[0].deactivate_later) == ("m", True, False) and rows[4].merged_statement is None


def test_control_and_judge(spark):
    known = F.array(F.lit(5).cast("bigint"), F.lit(2).cast("bigint"), F.lit(9).cast("bigint"))
    enough, ids = parse.retrieval_control(F.col("response"), known, 2)
    assert tuple(one(spark, 'x {"enough": false, "top_node_ids": [9, "2", 9, 77, "q"]}', enough, ids)) == (False, [9, 2])
    assert tuple(one(spark, '{"enough": true, "top_node_ids": [9]}', enough, ids)) == (True, [])
    assert tuple(one(spark, "unreadable", enough, ids)) == (False, [2, 5])
    score = parse.judge_score(F.col("response"))
    assert [one(spark, t, score)[0] for t in ("4", "score, 7, 3", "none", "", "4.5")] == [4, 3, -1, -1, -1]
    info = parse.reasoning_info(F.col("response"))
    assert one(spark, "a\n### evidence\n e ", info)[0] == "e" and one(spark, "plain", info)[0] == "plain"


def test_templates(spark):
    fill = templates.fill(F.col("t"), F.col("v"))
    ddl = "t string, v map<string,string>"
    assert spark.createDataFrame([("{a}-{b}{a}.", {"a": "{b}", "b": ""})], ddl).select(fill).first()[0] == "{b}-{b}."
    assert spark.createDataFrame([("plain", {})], ddl).select(fill).first()[0] == "plain"
    with pytest.raises(Exception, match="Missing variable 'c'"):
        spark.createDataFrame([("{c}", {"a": "x"})], ddl).select(fill).collect()
    builtin = templates.builtin_templates(spark)
    assert builtin.count() == 13
    more = spark.createDataFrame([("service", None, "get_mode", "s", "u"), ("graph", "g", "get_mode", "gs", "gu"), ("call", "g", "get_plan", None, "u")], "layer string, graph_id string, name string, system string, user string")
    requests = spark.createDataFrame([("g", "get_mode"), ("h", "get_mode"), ("g", "get_plan")], "graph_id string, name string")
    rows = {(r.graph_id, r.name): r.layer for r in templates.resolve_templates(builtin.unionByName(more), requests).collect()}
    assert rows == {("g", "get_mode"): "graph", ("h", "get_mode"): "service", ("g", "get_plan"): "builtin"}
    with pytest.raises(Exception, match="Unknown prompt"):
        templates.resolve_templates(builtin, spark.createDataFrame([("g", "nope")], "graph_id string, name string")).collect()
