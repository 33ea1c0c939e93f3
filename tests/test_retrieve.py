import pytest
from pyspark.sql import functions as F

from mnemolake.functions import value as vf
from mnemolake.functions.value import ValueFunction
from mnemolake.operators import retrieve

FACT = "graph_id string, semantic_id long, text string, embedding array<float>, tags array<string>, tag_ids array<long>, time long, is_active boolean, credibility int, session_id string"
TAG = "graph_id string, tag_id long, tag string, embedding array<float>, time long, importance int"


@pytest.fixture(scope="module")
def graph(spark):
    facts = spark.createDataFrame(
        [
            ("g", 0, "boiling", [1.0, 0.0, 0.0], ["physics", "water"], [0, 1], 0, True, 10, "s1"),
            ("g", 1, "orbit", [0.0, 1.0, 0.0], ["astronomy"], [2], 1, True, 10, "s1"),
            ("g", 2, "hidden", [0.9, 0.1, 0.0], ["physics"], [0], 2, False, 10, "s1"),
            ("g", 3, "untagged", [0.8, 0.0, 0.6], [], [], 3, True, 10, None),
            ("g", 4, "zero", [0.0, 0.0, 0.0], ["water"], [1], 4, True, 10, "s2"),
            ("h", 0, "other graph", [1.0, 0.0, 0.0], ["physics"], [0], 0, True, 10, "s1"),
        ], FACT,
    )
    tags = spark.createDataFrame(
        [("g", 0, "physics", [1.0, 0.0], 0, 2), ("g", 1, "water", [0.6, 0.8], 0, 1), ("g", 2, "astronomy", [0.0, 1.0], 1, 1), ("h", 0, "physics", [1.0, 0.0], 0, 1)], TAG
    )
    queries = spark.createDataFrame([("g", 7, [1.0, 0.0, 0.0])], "graph_id string, query_id long, embedding array<float>")
    asked = spark.createDataFrame([("g", 7, "physics", [1.0, 0.0]), ("g", 7, "rivers", [0.6, 0.81])], "graph_id string, query_id long, query_tag string, embedding array<float>")
    return facts, tags, queries, asked


def test_votes_and_inactive_facts(graph):
    facts, tags, queries, asked = graph
    hits = retrieve.retrieve_tags(asked, tags)
    assert {(r.query_tag, r.tag) for r in hits.collect()} == {("physics", "physics"), ("rivers", "water")}
    votes = {r.semantic_id: (r.tag_votes, r.vote_weight) for r in retrieve.tag_votes(retrieve.weighted_hits(asked, hits), facts, retrieve.direct_facts(queries, facts)).collect()}
    # own tag counts five-fold times importance 2, other tags once, a direct hit 2
    assert votes == {0: (3, 13.0), 1: (1, 2.0), 2: (1, 10.0), 3: (1, 2.0), 4: (2, 3.0)}


def test_semantic_retrieval_keeps_inactive_by_tag(graph):
    facts, tags, queries, asked = graph
    rows = retrieve.retrieve_semantic(queries, asked, tags, facts).orderBy("rank").collect()
    assert [r.semantic_id for r in rows] == [0, 2, 3, 1, 4]
    assert rows[0].importance == 6.5 and rows[2].importance == 2.0  # no tags: divided by one


@pytest.mark.parametrize("value", [vf.SEMANTIC_RELEVANT.with_limits(k=2), ValueFunction(k=3, threshold=0.1, recency=lambda age: 0.05 * age)])
def test_pruned_route_equals_general(graph, value):
    facts, tags, queries, asked = graph
    rows = [sorted(map(str, retrieve.retrieve_semantic(queries, asked, tags, facts, value=value, prune=p).collect())) for p in (True, False)]
    assert rows[0] == rows[1] and rows[0]


def test_trace_marks_selected(graph):
    facts, tags, queries, asked = graph
    rows = {r.semantic_id: r for r in retrieve.trace_semantic(queries, asked, tags, facts, value=vf.SEMANTIC_RELEVANT.with_limits(k=2, threshold=0.5)).collect()}
    assert {i for i, r in rows.items() if r.selected} == {0, 2} and rows[0].recency == 5 and not rows[2].is_active and len(rows) == 5


def test_untagged_retrieval_and_promotion(graph, spark):
    facts, _, queries, _ = graph
    hits = retrieve.retrieve_semantic_untagged(queries, facts)
    items = retrieve.promote_sessions(hits, facts).orderBy("item").collect()
    assert [(r.item, r.kind, r.session_id, r.semantic_id) for r in items] == [(0, "session", "s1", None), (1, "fact", None, 3), (2, "fact", "s2", 4)]
    episodes = spark.createDataFrame([("g", 1, "b", "", "2024", "s1"), ("g", 0, "a", "x", "2023", "s1")], "graph_id string, episodic_id long, observation string, action string, time string, session_id string")
    text = retrieve.episodic_context(retrieve.promote_sessions(hits, facts), facts, episodes).first().text
    assert text == "Relevant Memory 0:\n2023\na\nx\nb\nRelevant Memory 1:\nuntagged\nRelevant Memory 2:\nzero\n"
    nothing = retrieve.episodic_context(retrieve.promote_sessions(hits, facts), facts, episodes.limit(0)).first().text
    assert nothing.startswith("Relevant Memory 0:\nThere is no relevant memoryRelevant Memory 1:")


def _procedures(spark):
    subgoals = spark.createDataFrame([("g", 0, "boil", [1.0, 0.0], 0, 1), ("g", 1, "freeze", [0.0, 1.0], 0, 1)], "graph_id string, subgoal_id long, subgoal string, embedding array<float>, time long, importance int")
    procedures = spark.createDataFrame(
        [("g", 0, "use heat", [1.0, 0.0], 0, 0.0, 0), ("g", 1, "use more heat", [0.9, 0.1], 1, 5.0, 0), ("g", 2, "use ice", [0.0, 1.0], 2, 0.0, 1)],
        "graph_id string, procedural_id long, text string, embedding array<float>, time long, ret double, subgoal_id long",
    )
    return subgoals, procedures


def test_procedures(spark):
    subgoals, procedures = _procedures(spark)
    queries = spark.createDataFrame([("g", 1, [1.0, 0.05]), ("g", 2, [-1.0, -1.0]), ("none", 3, [1.0, 0.0])], "graph_id string, query_id long, embedding array<float>")
    assert {(r.query_id, r.procedural_id) for r in retrieve.retrieve_procedural(queries, subgoals, procedures).collect()} == {(1, 0)}
    rule = ValueFunction(k=1, threshold=0.1, ret=lambda r: r)
    assert {(r.query_id, r.procedural_id) for r in retrieve.retrieve_procedural(queries, subgoals, procedures, value=rule).collect()} == {(1, 1)}
    traced = retrieve.retrieve_procedural(queries, subgoals, procedures, trace=True)
    assert {(r.procedural_id, r.selected) for r in traced.collect()} == {(0, True), (1, False)}
    grown = retrieve.subgoal_matches(retrieve.best_subgoal(queries, subgoals), subgoals)
    assert {(r.subgoal_id, r.importance) for r in grown.collect()} == {(0, 2), (1, 1)}


def test_retrieve_by_mode(graph, spark):
    facts, tags, _, asked = graph
    subgoals, procedures = _procedures(spark)
    episodes = spark.createDataFrame([("g", 0, "a", "x", "2023", "s1")], "graph_id string, episodic_id long, observation string, action string, time string, session_id string")
    ddl = "graph_id string, query_id long, embedding array<float>, subgoal_embedding array<float>, mode string"
    queries = spark.createDataFrame(
        [("g", 7, [1.0, 0.0, 0.0], [1.0, 0.0], "semantic_memory"), ("g", 8, [1.0, 0.0, 0.0], [0.0, 1.0], "procedural_memory"),
         ("g", 9, [1.0, 0.0, 0.0], [-1.0, -1.0], "procedural_memory"), ("g", 10, [1.0, 0.0, 0.0], [1.0, 0.0], "episodic_memory"), ("x", 11, [1.0, 0.0, 0.0], [1.0, 0.0], "semantic_memory")], ddl,
    )
    tables = {"semantic": facts, "tag": tags, "subgoal": subgoals, "procedural": procedures, "episodic": episodes}
    rows = {r.query_id: r for r in retrieve.retrieve(queries, asked, tables).collect()}
    assert rows[7].text.startswith("Fact 0: boiling\nFact 1: hidden\n") and rows[7].selected_semantic_ids[:2] == [0, 2]
    assert rows[8].text == "Experience 0: use ice\n" and rows[9].text == "No relevant experiences" and rows[11].text == "No relevant fact"
    assert rows[10].text.startswith("Relevant Memory 0:\n2023\na\nx\n") and rows[10].selected_procedural_ids == [0] and rows[10].selected_semantic_ids
    with pytest.raises(Exception, match="Invalid mode"):
        retrieve.retrieve(queries.withColumn("mode", F.lit("dream")), asked, tables).collect()


def test_fan_out(spark):
    queries = spark.createDataFrame([(1, "g", ["h", "g", "gone"])], "query_id long, graph_id string, shared_graphs array<string>")
    rows = retrieve.fan_out(queries, spark.createDataFrame([("g",), ("h",)], "graph_id string"))
    assert [(r.target_pos, r.graph_id, r.error) for r in rows.orderBy("target_pos").collect()] == [(0, "g", None), (1, "h", None), (2, "gone", "graph not found: gone")]
    text = retrieve.labelled_blocks(rows.withColumn("text", F.lit("t")).withColumn("mode", F.lit("m"))).first().text
    assert text == "[graph:g | m]\nt\n\n---\n\n[graph:h | m]\nt\n\n---\n\n[graph:gone | error]\ngraph not found: gone"


def test_multi_hop(graph, spark):
    facts, tags, queries, asked = graph
    queries = queries.withColumn("question", F.lit("why"))
    embed = lambda text: F.when(F.contains(text, F.lit("boiling")), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).cast("array<float>")
    rule = ValueFunction(k=1, threshold=0.5)
    found, log = retrieve.multi_hop(queries, asked, tags, facts, value=rule, embed=embed, max_rounds=3)
    assert {(r.semantic_id, r.round) for r in found.collect()} == {(0, 1), (1, 2)}
    assert [(r.round, r.n_new, r.stop_reason) for r in log.orderBy("round").collect()] == [(1, 1, None), (2, 1, None), (3, 0, "no_gain")]
    control = spark.createDataFrame([("g", 7, 1, True, [])], "graph_id string, query_id long, round int, enough boolean, top_ids array<long>")
    _, log = retrieve.multi_hop(queries, asked, tags, facts, value=rule, embed=embed, control=control)
    assert [r.stop_reason for r in log.collect()] == ["enough"]


def test_audit_ids_continue(spark):
    answers = spark.createDataFrame([("g", 5, "a"), ("g", 3, "b"), ("h", 1, "c")], "graph_id string, query_id long, mode string")
    last = spark.createDataFrame([("g", 9)], "graph_id string, last_id long")
    rows = retrieve.audit_rows(answers, last, endpoint="retrieve", ts=F.current_timestamp())
    assert {(r.graph_id, r.recall_id, r["mode"]) for r in rows.collect()} == {("g", 10, "b"), ("g", 11, "a"), ("h", 0, "c")}
