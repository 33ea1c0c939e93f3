import random

import pytest
from pyspark.sql import functions as F

from mnemolake.functions import text as tx
from mnemolake.operators import cost, evaluate, inspect


def test_quotas_equal_the_budget_loop(spark):
    rng = random.Random(4)
    pools = [(f"g{i}", {t: rng.choice([0, 0, 1, 3, 8, 20]) for t in inspect.TYPE_PRIORITY}) for i in range(80)]
    limit = 17
    rows = [(g, t, n) for g, p in pools for t, n in p.items()]
    got = {(r.graph_id, r.node_type): r.quota for r in inspect.node_quotas(spark.createDataFrame(rows, "graph_id string, node_type string, size long"), limit).collect()}
    for g, pool in pools:
        chosen = dict(pool)
        if sum(pool.values()) > limit:
            used = [t for t in inspect.TYPE_PRIORITY if pool[t]]
            chosen = {t: min(limit // max(1, len(used)), pool[t]) for t in inspect.TYPE_PRIORITY}
            left = limit - sum(chosen.values())
            for t in inspect.TYPE_PRIORITY:
                extra = min(left, pool[t] - chosen[t])
                chosen[t] += extra
                left -= extra
        assert {t: got.get((g, t), 0) for t in inspect.TYPE_PRIORITY} == chosen


def test_small_budget_and_topology(spark):
    facts = spark.createDataFrame([("g", i, f"fact {i}", i, i != 2, 1) for i in range(5)], "graph_id string, semantic_id long, text string, time long, is_active boolean, insert_id long")
    tags = spark.createDataFrame([("g", 0, "t", 0, 3), ("g", 1, "u", 1, 0)], "graph_id string, tag_id long, tag string, time long, importance int")
    edges = spark.createDataFrame([("g", "semantic", 4, "tagged", "tag", 0), ("g", "semantic", 0, "tagged", "tag", 0), ("g", "semantic", 4, "related", "semantic", 3)], "graph_id string, src_type string, src_id long, kind string, dst_type string, dst_id long")
    nodes, links = inspect.topology({"semantic": facts, "tag": tags}, edges, limit=4, include_inactive=False, min_importance=1)
    assert {r.uid for r in nodes.collect()} == {"sem-4", "sem-3", "sem-1", "tag-0"} and nodes.first().truncated
    assert {r.uid for r in links.collect()} == {"sem-4__tagged__tag-0", "sem-3__related__sem-4", "sem-1__related__sem-3", "sem-1__related__sem-4"}
    nodes, _ = inspect.topology({"semantic": facts, "tag": tags}, edges, limit=1)
    assert [r.uid for r in nodes.collect()] == ["sem-4"]


def test_search_page_detail(spark):
    facts = spark.createDataFrame([("g", 0, "Straße", "1", True), ("g", 1, "STRASSE", "x", True), ("g", 2, "strasse", "3", False), ("g", 3, None, "4", True)], "graph_id string, semantic_id long, text string, time string, is_active boolean")
    hits = inspect.search(facts, "semantic", " straSSe ", limit=2).orderBy("rank").collect()
    assert [(r.semantic_id, r.total) for r in hits] == [(2, 3), (0, 3)]
    assert [r.semantic_id for r in inspect.search(facts, "semantic", "", only_active=True).orderBy("rank").collect()] == [3, 0, 1]
    assert sorted((r.semantic_id, r.place, r.total) for r in inspect.browse(facts, "semantic", 1, 2).collect()) == [(1, 1, facts.count()), (2, 2, facts.count())]
    with pytest.raises(ValueError):
        inspect.browse(facts, "nonsense")
    edges = spark.createDataFrame([("g", "semantic", 0, "tagged", "tag", 9), ("g", "semantic", 1, "derived_from", "semantic", 0)], "graph_id string, src_type string, src_id long, kind string, dst_type string, dst_id long")
    rows = inspect.node_detail(facts, "semantic", edges, facts.where("semantic_id in (0, 2)")).collect()
    assert sorted((r.semantic_id, r.kind or "", r.direction or "", r.id or 0) for r in rows) == [(0, "derived_from", "in", 1), (0, "tagged", "out", 9), (2, "", "", 0)]
    on = inspect.set_active(facts, spark.createDataFrame([("g", 2, True)], "graph_id string, semantic_id long, is_active boolean"))
    assert on.where("is_active").count() == 4
    with pytest.raises(Exception, match="nothing to change"):
        inspect.set_active(facts, spark.createDataFrame([("g", 2, None)], "graph_id string, semantic_id long, is_active boolean")).collect()


def test_timeline_order(spark):
    episodes = spark.createDataFrame([("g", 0, "", "", "bad", "A", ""), ("g", 1, "o\nx", "a", "2", "A", "sg"), ("g", 2, "o", "a", "1", "B", "")], "graph_id string, episodic_id long, observation string, action string, time string, session_id string, subgoal string")
    recalls = spark.createDataFrame([("g", 0, 2, "A", "retrieve"), ("g", 1, 0, "C", "reason")], "graph_id string, recall_id long, graph_time long, session_id string, endpoint string")
    tables = {"episodic": episodes, "recall_audit": recalls}
    events = inspect.session_timeline(tables).where("session_id = 'A'").orderBy("time", "kind", "node_id").collect()
    assert [(r.kind, r.time, r.label) for r in events] == [("insert", 0, "(empty)"), ("insert", 2, "o x"), ("recall", 2, None)]
    assert {r.session_id for r in inspect.sessions(tables).collect()} == {"A", "B", "C"}
    stats = inspect.graph_stats(tables).first()
    assert (stats.episodic, stats.semantic) == (3, 0)


USAGE = "trajectory_id string, system string, scope string, phase string, model string, input_tokens long, output_tokens long, extra struct<judge_score int>"


def test_cost(spark):
    rows = [
        ("t1", "A@R=1", "EXPOSED", "c", "m", 1_000_000, 0, None), ("t2", "A@R=1", "EXPOSED", "c", "unknown", 0, 1_000_000, None),
        ("t1", "B@R=1", "INTERNAL", "c", "m", 500_000, 0, None), ("t1", "A@R=x", "EXPOSED", "c", "m", 1, 1, None), ("t1", "A", "EXPOSED", "c", "m", 1, 1, None),
        ("t1", "A@R=1", "EVAL", "judge_score", "m", 9, 9, (4,)), ("t1", "A@R=1", "EVAL", "judge_score", "m", 9, 9, (-1,)), ("t1", "B@R=1", "EVAL", "judge_score", "m", 9, 9, (3,)),
    ]
    usage = spark.createDataFrame(rows, USAGE)
    prices = spark.createDataFrame([("m", 2.0, 4.0)], "model string, input double, output double")
    cells = cost.cost_cells(usage, prices)
    got = {(r.letter, r.rounds, r.scope): (r.n_trajectories, r.tokens_in, r.tokens_out, r.usd) for r in cells.collect()}
    assert got == {("A", 1, "EXPOSED"): (2, 500_000.0, 500_000.0, 2.5), ("B", 1, "INTERNAL"): (1, 500_000.0, 0.0, 1.0)}
    assert [(r.letter, r.rounds, r.ratio) for r in cost.reduction_ratio(cells).collect()] == [("B", 1, float("inf"))]
    cross = {r.scope: (r.tokens_rounds, r.usd_rounds) for r in cost.crossover(cost.cost_curves(cells)).collect()}
    assert cross == {"all": (1, 1), "INTERNAL": (None, None)}
    kept = {r.letter: (r.mean_score, r.n, r.retention) for r in cost.quality_retention(cost.quality_cells(usage)).collect()}
    assert kept == {"A": (4.0, 1, None), "B": (3.0, 1, -1.0)}


def test_em_f1(spark):
    rows = [(1, "The cat, the cat!", "cat a cat"), (2, "cat cat dog", "cat bird"), (3, "", "x"), (4, "x", None), (5, "", "")]
    got = {r.k: (r.em, round(r.f1, 6)) for r in evaluate.em_f1(spark.createDataFrame(rows, "k int, pred string, gold string"), "k").collect()}
    assert got == {1: (1.0, 1.0), 2: (0.0, 0.4), 3: (0.0, 0.0), 4: (0.0, 0.0), 5: (1.0, 0.0)}


def test_packing_equals_the_fold(spark):
    rng = random.Random(8)
    sizes = [rng.randint(1, 60) for _ in range(90)]
    passages = spark.createDataFrame([("g", i, n) for i, n in enumerate(sizes)], "graph_id string, passage_id long, n_tokens long")
    queries = spark.createDataFrame([("g", 1, 200), ("g", 2, 5000), ("g", 3, 0)], "graph_id string, query_id long, budget long")
    got: dict = {}
    for r in evaluate.pack_context(queries, passages, block=7).orderBy("query_id", "pick").collect():
        got.setdefault(r.query_id, []).append(r.passage_id)
    orders = evaluate.with_permutation(queries, spark.createDataFrame([("g", 90)], "graph_id string, _n long"), 0).collect()
    for q in orders:
        total, want = 0, []
        for j in range(90):
            i = (q["_start"] + j * q["_stride"]) % 90
            if total + sizes[i] > q["budget"]:
                continue
            total += sizes[i]
            want.append(i)
            if total > q["budget"] * 0.99:
                break
        assert got.get(q.query_id, []) == want
    assert sorted(got[2]) == list(range(90))


def test_random_context(spark):
    facts = spark.createDataFrame([("g", i * 3) for i in range(7)] + [("h", 1)], "graph_id string, semantic_id long")
    queries = spark.createDataFrame([("g", 1), ("g", 2), ("h", 3)], "graph_id string, query_id long")
    rows = evaluate.random_context(queries, facts, 5).collect()
    per = {q: {r.semantic_id for r in rows if r.query_id == q} for q in (1, 2, 3)}
    assert len(per[1]) == 5 and len(per[2]) == 5 and per[3] == {1} and {r.semantic_id for r in rows if r.query_id == 1} == per[1]


def test_text_helpers(spark):
    row = spark.createDataFrame([("  a\nb  ", "A@R=3", "[\"x\", 'y z', `y z`:]", "not a number")], "s string, sys string, tags string, t string").select(
        tx.short_label(F.col("s"), 3).alias("label"), tx.short_label(F.lit("abcdef"), 4).alias("cut"), tx.clean_tags(F.col("tags")).alias("tags"),
        tx.split_system(F.col("sys"))[1].alias("r"), tx.split_system(F.lit("A@R=z"))[1].alias("bad"), tx.safe_time(F.col("t")).alias("t"),
        tx.tag_input(F.lit(" a, ,b ")).alias("typed"), tx.cited_ids(F.lit("Sem Node 3, SemNode4")).alias("ids"), tx.token_estimate(F.lit("abc")).alias("n"),
        tx.decode_ids(F.lit("")).alias("none"), tx.decode_ids(F.lit("[1,2]")).alias("two"),
    ).first()
    assert row.label == "a b" and row.cut == "abc…" and row.tags == ["x", "y z"] and (row.r, row.bad, row.t) == (3, -1, 0)
    assert row.typed == ["a", "b"] and row.ids == [3, 4] and row.n == 1 and row.none == [] and row.two == [1, 2]
