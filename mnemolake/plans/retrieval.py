"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import value as vf
from mnemolake.functions.value import ValueFunction
from mnemolake.functions.vector import hash_embedding
from mnemolake.operators import evaluate, ingest, retrieve
from mnemolake.operators.similarity import nearest
from mnemolake.operators.vector_index import VectorIndex
from mnemolake.operators.vote_postings import VotePostings
from mnemolake.plans import bindings as b
from mnemolake.plans.bindings import with_bindings
from mnemolake.plans.registry import query
from mnemolake.session import run_folder

# Scoring used by the registered queries: three tags per query tag, and a rule that reads every input.
TAG_RULE = ValueFunction(k=3, threshold=0.05)
WEIGHTED_RULE = ValueFunction(
    k=10, threshold=0.0, importance=lambda votes: 0.001 * votes, recency=lambda age: -0.0001 * age
)


def _six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# --- similarity ---

_NEAR = """pairs AS (
  SELECT q.graph_id, q.query_id, f.semantic_id, f.is_active, f.session_id, f.text,
         list_cosine_similarity(q.embedding, f.embedding) AS relevance
  FROM queries q JOIN facts f USING (graph_id))"""


@query("vector_topk", with_bindings("""
SELECT graph_id, query_id, semantic_id, round(relevance, 6) AS relevance, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 12) DESC, semantic_id) AS rank FROM pairs)
WHERE rank <= 10""", _NEAR))
def vector_topk(spark, d) -> DataFrame:
    found = nearest(b.queries(spark, d), b.facts(spark, d), k=10)
    return found.select("graph_id", "query_id", "semantic_id", "rank", *_six("relevance"))


@query("vector_topk_blocks", with_bindings("""
SELECT graph_id, query_id, semantic_id, round(relevance, 6) AS relevance, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 12) DESC, semantic_id) AS rank FROM pairs)
WHERE rank <= 10""", _NEAR))
def vector_topk_blocks(spark, d) -> DataFrame:
    """The route for query sets too large to broadcast."""
    found = nearest(b.queries(spark, d), b.facts(spark, d), k=10, broadcast_rows=0)
    return found.select("graph_id", "query_id", "semantic_id", "rank", *_six("relevance"))


@query("vector_topk_filtered", with_bindings("""
SELECT graph_id, query_id, semantic_id, round(relevance, 6) AS relevance, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 12) DESC, semantic_id) AS rank
  FROM pairs WHERE is_active)
WHERE rank <= 5""", _NEAR))
def vector_topk_filtered(spark, d) -> DataFrame:
    found = retrieve.direct_facts(b.queries(spark, d), b.facts(spark, d))
    return found.select("graph_id", "query_id", "semantic_id", "rank", *_six("relevance"))


def _index(spark, d) -> VectorIndex:
    return VectorIndex.write(b.facts(spark, d).select("graph_id", "semantic_id", "embedding", "is_active"), f"{run_folder(spark)}/index")


@query("vector_index_topk", with_bindings("""
SELECT graph_id, query_id, semantic_id, round(relevance, 6) AS relevance, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 12) DESC, semantic_id) AS rank FROM pairs)
WHERE rank <= 10""", _NEAR))
def vector_index_topk(spark, d) -> DataFrame:
    """Exact search through the index: best cells first, then those that can still hold a better one."""
    found, _ = _index(spark, d).search(b.queries(spark, d), k=10)
    return found.select("graph_id", "query_id", "semantic_id", "rank", *_six("relevance"))


@query("vector_index_filtered", with_bindings("""
SELECT graph_id, query_id, semantic_id, round(relevance, 6) AS relevance, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 12) DESC, semantic_id) AS rank
  FROM pairs WHERE is_active)
WHERE rank <= 5""", _NEAR))
def vector_index_filtered(spark, d) -> DataFrame:
    """The same with a condition on stored columns."""
    found, _ = _index(spark, d).search(b.queries(spark, d), k=5, keep="is_active")
    return found.select("graph_id", "query_id", "semantic_id", "rank", *_six("relevance"))


@query("vector_index_probes")
def vector_index_probes(spark, d) -> DataFrame:
    """Approximate search for every vector whose id is divisible by 20, with the share of vectors that was read for it."""
    vectors = b.table(spark, d, "embeddings").select(F.lit("g").alias("graph_id"), F.col("vec_id").alias("semantic_id"), "embedding")
    index = VectorIndex.write(vectors, f"{run_folder(spark)}/index")
    asked = vectors.where("semantic_id % 20 = 0").withColumnRenamed("semantic_id", "query_id")
    found, cells = index.search(asked, k=10, exact=False)
    n = index.cells.agg(F.sum("n").alias("all_rows"))
    share = cells.groupBy("query_id").agg(F.sum("n").alias("scanned"))
    share = share.withColumn("all_rows", F.lit(n.first()["all_rows"]))
    return found.join(share, "query_id").select("query_id", "semantic_id", "rank", *_six("relevance"), F.round(F.col("scanned") / F.col("all_rows"), 6).alias("scanned_share"))


# --- tags and facts ---

_TAG_HITS = """tag_pairs AS (
  SELECT q.graph_id, q.query_id, q.query_tag, t.tag_id, t.tag, t.importance, t.time,
         list_cosine_similarity(q.embedding, t.embedding) AS relevance
  FROM query_tags q JOIN tags t USING (graph_id)),
ranked_tags AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, query_tag ORDER BY round(relevance, 12) DESC, tag_id) AS rank FROM tag_pairs),
tag_hits AS (SELECT * FROM ranked_tags WHERE rank <= 3 AND round(relevance, 12) >= 0.05)"""

_VOTES = """direct AS (
  SELECT graph_id, query_id, semantic_id FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 12) DESC, semantic_id) AS rank FROM pairs WHERE is_active)
  WHERE rank <= 5),
votes AS (
  SELECT graph_id, query_id, semantic_id, sum(votes)::BIGINT AS tag_votes, sum(weight)::DOUBLE AS vote_weight FROM (
    SELECT h.graph_id, h.query_id, t.semantic_id, 1 AS votes,
           h.importance * CASE WHEN EXISTS (SELECT 1 FROM query_tags n WHERE n.query_id = h.query_id AND n.query_tag = h.tag)
                               THEN 5.0 ELSE 1.0 END AS weight
    FROM tag_hits h JOIN fact_tags t ON t.graph_id = h.graph_id AND t.tag_id = h.tag_id
    UNION ALL SELECT graph_id, query_id, semantic_id, 1, 2.0 FROM direct)
  GROUP BY graph_id, query_id, semantic_id),
clock AS (SELECT graph_id, max(time) + 1 AS now FROM facts GROUP BY graph_id),
candidates AS (
  SELECT v.graph_id, v.query_id, v.semantic_id, v.tag_votes, v.vote_weight / greatest(1, len(f.tags)) AS importance,
         list_cosine_similarity(q.embedding, f.embedding) AS relevance, c.now - f.time AS recency, f.credibility, f.is_active
  FROM votes v JOIN facts f ON f.graph_id = v.graph_id AND f.semantic_id = v.semantic_id
  JOIN queries q ON q.query_id = v.query_id JOIN clock c ON c.graph_id = v.graph_id)"""


@query("tag_retrieve", with_bindings("""
SELECT graph_id, query_id, query_tag, tag_id, tag, round(relevance, 6) AS relevance, rank::INTEGER AS rank FROM tag_hits""", _TAG_HITS))
def tag_retrieve(spark, d) -> DataFrame:
    hits = retrieve.retrieve_tags(b.query_tags(spark, d), b.tags(spark, d), TAG_RULE)
    return hits.select("graph_id", "query_id", "query_tag", "tag_id", "tag", "rank", *_six("relevance"))


@query("tag_trace", with_bindings("""
SELECT r.graph_id, query_id, query_tag, tag_id, round(relevance, 6) AS relevance, c.now - r.time AS recency,
       r.importance, rank <= 3 AND round(relevance, 12) >= 0.05 AS selected
FROM ranked_tags r JOIN (SELECT graph_id, max(time) + 1 AS now FROM tags GROUP BY graph_id) c ON c.graph_id = r.graph_id""", _TAG_HITS))
def tag_trace(spark, d) -> DataFrame:
    hits = retrieve.retrieve_tags(b.query_tags(spark, d), b.tags(spark, d), TAG_RULE, trace=True)
    return hits.select("graph_id", "query_id", "query_tag", "tag_id", "recency", "importance", "selected", *_six("relevance"))


@query("tag_vote", with_bindings("SELECT graph_id, query_id, semantic_id, tag_votes, vote_weight FROM votes", _NEAR, _TAG_HITS, _VOTES))
def tag_vote(spark, d) -> DataFrame:
    asked, facts = b.query_tags(spark, d), b.facts(spark, d)
    chosen = retrieve.weighted_hits(asked, retrieve.retrieve_tags(asked, b.tags(spark, d), TAG_RULE))
    return retrieve.tag_votes(chosen, facts, retrieve.direct_facts(b.queries(spark, d), facts))


def _semantic(spark, d, value, prune) -> DataFrame:
    rows = retrieve.retrieve_semantic(
        b.queries(spark, d), b.query_tags(spark, d), b.tags(spark, d), b.facts(spark, d), tag_value=TAG_RULE, value=value, prune=prune
    )
    return rows.select("graph_id", "query_id", "semantic_id", "tag_votes", "rank", *_six("relevance", "importance", "value"))


def _semantic_sql(value: str) -> str:
    return with_bindings(f"""
SELECT graph_id, query_id, semantic_id, tag_votes, round(relevance, 6) AS relevance, round(importance, 6) AS importance,
       round(value, 6) AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(value, 12) DESC, semantic_id) AS rank
  FROM (SELECT *, {value} AS value FROM candidates))
WHERE rank <= 10 AND round(value, 12) >= 0""", _NEAR, _TAG_HITS, _VOTES)


@query("semantic_retrieve", _semantic_sql("relevance"))
def semantic_retrieve(spark, d) -> DataFrame:
    return _semantic(spark, d, vf.SEMANTIC_RELEVANT, True)


@query("semantic_retrieve_weighted", _semantic_sql("relevance + 0.001 * importance - 0.0001 * recency"))
def semantic_retrieve_weighted(spark, d) -> DataFrame:
    """A user-defined value function over relevance, votes and age."""
    return _semantic(spark, d, WEIGHTED_RULE, True)


def _lists(spark, d) -> VotePostings:
    return VotePostings.write(b.facts(spark, d), f"{run_folder(spark)}/lists")


@query("semantic_retrieve_blocks", _semantic_sql("relevance + 0.001 * importance - 0.0001 * recency"))
def semantic_retrieve_blocks(spark, d) -> DataFrame:
    """The same rule over posting lists in blocks: only blocks that can hold a winner are scored."""
    rows = retrieve.retrieve_semantic(
        b.queries(spark, d), b.query_tags(spark, d), b.tags(spark, d), b.facts(spark, d), tag_value=TAG_RULE, value=WEIGHTED_RULE, postings=_lists(spark, d)
    )
    return rows.select("graph_id", "query_id", "semantic_id", "tag_votes", "rank", *_six("relevance", "importance", "value"))


@query("vote_blocks", with_bindings("""
SELECT graph_id, query_id, t.tag_id, count(*) AS listed FROM (SELECT DISTINCT graph_id, query_id, tag_id FROM tag_hits) h
JOIN fact_tags t USING (graph_id, tag_id) GROUP BY graph_id, query_id, t.tag_id""", _TAG_HITS))
def vote_blocks(spark, d) -> DataFrame:
    """Facts in the lists of each query's chosen tags: the blocks hold every fact of a tag once."""
    chosen = retrieve.choose_tags(b.query_tags(spark, d), b.tags(spark, d), TAG_RULE)
    direct = retrieve.direct_facts(b.queries(spark, d), b.facts(spark, d))
    _, blocks = _lists(spark, d).search(b.queries(spark, d), chosen, direct, WEIGHTED_RULE)
    return blocks.groupBy("graph_id", "query_id", "tag_id").agg(F.sum("n").alias("listed"))


@query("retrieve_trace", with_bindings("""
SELECT graph_id, query_id, semantic_id, tag_votes, round(relevance, 6) AS relevance, round(importance, 6) AS importance,
       recency, credibility, is_active, rank::INTEGER AS rank, rank <= 10 AND round(relevance, 12) >= 0 AS selected FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 12) DESC, semantic_id) AS rank FROM candidates)
""", _NEAR, _TAG_HITS, _VOTES))
def retrieve_trace(spark, d) -> DataFrame:
    rows = retrieve.trace_semantic(b.queries(spark, d), b.query_tags(spark, d), b.tags(spark, d), b.facts(spark, d), tag_value=TAG_RULE)
    return rows.select(
        "graph_id", "query_id", "semantic_id", "tag_votes", "recency", "credibility", "is_active", "rank", "selected", *_six("relevance", "importance")
    )


_UNTAGGED = """untagged AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 12) DESC, semantic_id) AS rank FROM pairs
  QUALIFY rank <= 30),
sized AS (SELECT *, count(*) OVER (PARTITION BY query_id, session_id) AS n FROM untagged WHERE round(relevance, 12) >= 0),
items AS (
  SELECT graph_id, query_id, 'session' AS kind, session_id, NULL::BIGINT AS semantic_id, min(rank) AS rank, 0 AS part
  FROM sized WHERE n >= 3 GROUP BY graph_id, query_id, session_id
  UNION ALL SELECT graph_id, query_id, 'fact', session_id, semantic_id, rank, 1 FROM sized WHERE n < 3)"""


@query("semantic_no_tag", with_bindings("""
SELECT graph_id, query_id, semantic_id, round(relevance, 6) AS relevance, rank::INTEGER AS rank FROM untagged
WHERE round(relevance, 12) >= 0""", _NEAR, _UNTAGGED))
def semantic_no_tag(spark, d) -> DataFrame:
    found = retrieve.retrieve_semantic_untagged(b.queries(spark, d), b.facts(spark, d))
    return found.select("graph_id", "query_id", "semantic_id", "rank", *_six("relevance"))


@query("session_promotion", with_bindings("""
SELECT graph_id, query_id, kind, session_id, semantic_id,
       (row_number() OVER (PARTITION BY query_id ORDER BY part, rank) - 1)::INTEGER AS item FROM items""", _NEAR, _UNTAGGED))
def session_promotion(spark, d) -> DataFrame:
    facts = b.facts(spark, d)
    return retrieve.promote_sessions(retrieve.retrieve_semantic_untagged(b.queries(spark, d), facts), facts)


@query("session_text", with_bindings("""
SELECT graph_id, session_id, first(time ORDER BY episodic_id) || chr(10)
       || string_agg(CASE WHEN observation <> '' THEN observation ELSE action END, chr(10) ORDER BY episodic_id) || chr(10) AS text
FROM episodes GROUP BY graph_id, session_id"""))
def session_text(spark, d) -> DataFrame:
    return retrieve.session_text(b.episodes(spark, d))


# --- subgoals and procedures ---

_GOALS = """goal_pairs AS (
  SELECT q.graph_id, q.query_id, q.embedding AS asked, s.subgoal_id, s.subgoal, list_cosine_similarity(q.embedding, s.embedding) AS relevance
  FROM goal_queries q JOIN subgoals s USING (graph_id)),
best_goal AS (
  SELECT * FROM goal_pairs
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 12) DESC, subgoal_id) = 1 AND round(relevance, 12) >= 0.1)"""


@query("best_subgoal", with_bindings("SELECT graph_id, query_id, subgoal_id, round(relevance, 6) AS relevance FROM best_goal", _GOALS))
def best_subgoal(spark, d) -> DataFrame:
    found = retrieve.best_subgoal(b.goal_queries(spark, d), b.subgoals(spark, d))
    return found.select("graph_id", "query_id", "subgoal_id", *_six("relevance"))


@query("subgoal_importance", with_bindings("""
SELECT s.graph_id, s.subgoal_id, s.importance + coalesce(n, 0) AS importance FROM subgoals s
LEFT JOIN (SELECT graph_id, subgoal_id, count(*) AS n FROM best_goal GROUP BY ALL) m
  ON m.graph_id = s.graph_id AND m.subgoal_id = s.subgoal_id""", _GOALS))
def subgoal_importance(spark, d) -> DataFrame:
    goals = b.subgoals(spark, d)
    matches = retrieve.best_subgoal(b.goal_queries(spark, d), goals)
    return retrieve.subgoal_matches(matches, goals).select("graph_id", "subgoal_id", "importance")


_PROCEDURE_RULE = ValueFunction(k=3, threshold=-1.0, ret=lambda r: 0.01 * r)


@query("procedural_retrieve", with_bindings("""
SELECT graph_id, query_id, subgoal_id, procedural_id, round(value, 6) AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(value, 12) DESC, procedural_id) AS rank FROM (
    SELECT g.graph_id, g.query_id, g.subgoal_id, p.procedural_id,
           list_cosine_similarity(g.asked, p.embedding) + 0.01 * p.return_value AS value
    FROM best_goal g JOIN procedures p ON p.graph_id = g.graph_id AND p.subgoal_id = g.subgoal_id))
WHERE rank <= 3""", _GOALS))
def procedural_retrieve(spark, d) -> DataFrame:
    procedures = b.procedures(spark, d).withColumn("ret", F.col("return_value"))
    found = retrieve.retrieve_procedural(b.goal_queries(spark, d), b.subgoals(spark, d), procedures, value=_PROCEDURE_RULE)
    return found.select("graph_id", "query_id", "subgoal_id", "procedural_id", "rank", *_six("value"))


# --- modes, fan-out, passages ---


_MODES = f"""modes AS (
  SELECT graph_id, query_id, embedding, ['semantic_memory', 'procedural_memory', 'episodic_memory'][query_id % 3 + 1] AS mode,
         {b.sql_hash("'src' || (query_id % 20)")} AS goal FROM queries),
mode_facts AS (
  SELECT c.query_id, c.semantic_id, f.text, row_number() OVER (PARTITION BY c.query_id ORDER BY round(c.relevance, 12) DESC, c.semantic_id) AS rank
  FROM candidates c JOIN facts f ON f.semantic_id = c.semantic_id JOIN modes m ON m.query_id = c.query_id AND m.mode <> 'procedural_memory'
  QUALIFY rank <= 10 AND round(c.relevance, 12) >= 0),
mode_procedures AS (SELECT * REPLACE (CASE graph_id WHEN 'en' THEN 'g0' WHEN 'de' THEN 'g1' ELSE 'g2' END AS graph_id) FROM procedures),
mode_goals AS (
  SELECT m.query_id, m.graph_id, m.goal, s.subgoal_id FROM modes m
  JOIN (SELECT DISTINCT graph_id, subgoal_id, subgoal FROM mode_procedures) s ON s.graph_id = m.graph_id
  WHERE m.mode <> 'semantic_memory'
  QUALIFY row_number() OVER (PARTITION BY m.query_id ORDER BY round(list_cosine_similarity(m.goal, {b.sql_hash('s.subgoal')}), 12) DESC, s.subgoal_id) = 1
      AND round(list_cosine_similarity(m.goal, {b.sql_hash('s.subgoal')}), 12) >= 0.1),
mode_experience AS (
  SELECT g.query_id, p.procedural_id, p.text FROM mode_goals g JOIN mode_procedures p ON p.graph_id = g.graph_id AND p.subgoal_id = g.subgoal_id
  QUALIFY row_number() OVER (PARTITION BY g.query_id ORDER BY round(list_cosine_similarity(g.goal, p.embedding), 12) DESC, p.procedural_id) = 1
      AND round(list_cosine_similarity(g.goal, p.embedding), 12) >= 0.1),
mode_sessions AS (
  SELECT 's' || conv_id AS session_id, first(turn::VARCHAR ORDER BY turn) || chr(10) || string_agg(text, chr(10) ORDER BY turn) || chr(10) AS text
  FROM conversations GROUP BY conv_id),
mode_items AS (
  SELECT i.query_id, row_number() OVER (PARTITION BY i.query_id ORDER BY i.part, i.rank) - 1 AS item,
         CASE i.kind WHEN 'session' THEN coalesce(s.text, 'There is no relevant memory') ELSE f.text || chr(10) END AS text
  FROM items i LEFT JOIN mode_sessions s ON s.session_id = i.session_id LEFT JOIN facts f ON f.semantic_id = i.semantic_id)"""


@query("retrieve_modes", with_bindings("""
SELECT m.graph_id, m.query_id, m.mode,
       CASE m.mode
         WHEN 'semantic_memory' THEN coalesce((SELECT string_agg('Fact ' || (rank - 1) || ': ' || text || chr(10), '' ORDER BY rank) FROM mode_facts h WHERE h.query_id = m.query_id), 'No relevant fact')
         WHEN 'procedural_memory' THEN coalesce((SELECT 'Experience 0: ' || min(text) || chr(10) FROM mode_experience h WHERE h.query_id = m.query_id), 'No relevant experiences')
         ELSE (SELECT string_agg('Relevant Memory ' || item || ':' || chr(10) || text, '' ORDER BY item) FROM mode_items h WHERE h.query_id = m.query_id) END AS text,
       coalesce((SELECT string_agg(semantic_id, ',' ORDER BY rank) FROM mode_facts h WHERE h.query_id = m.query_id), '') AS fact_ids,
       coalesce((SELECT min(procedural_id)::VARCHAR FROM mode_experience h WHERE h.query_id = m.query_id), '') AS procedure_ids
FROM modes m""", _NEAR, _TAG_HITS, _VOTES, _UNTAGGED, _MODES))
def retrieve_modes(spark, d) -> DataFrame:
    """Every benchmark item answered in one of the three modes over one graph of facts and documents."""
    asked = b.queries(spark, d)
    mode = F.element_at(F.array(*[F.lit(m) for m in ("semantic_memory", "procedural_memory", "episodic_memory")]), (F.col("query_id") % 3 + 1).cast("int"))
    asked = asked.withColumn("mode", mode)
    facts = b.facts(spark, d)
    episodes = b.turns(spark, d).select(
        F.explode(F.array(F.lit("g0"), F.lit("g1"), F.lit("g2"))).alias("graph_id"),
        (F.col("conv_id") * 1000000000 + F.col("turn")).alias("episodic_id"),
        F.col("text").alias("observation"), F.lit("").alias("action"), F.col("turn").cast("string").alias("time"),
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
    )
    graphs = {"en": "g0", "de": "g1", "es": "g2", "fr": "g2"}
    renamed = F.element_at(F.create_map(*[F.lit(x) for kv in graphs.items() for x in kv]), F.col("graph_id"))
    procedures = b.procedures(spark, d).withColumn("graph_id", renamed)
    subgoals = procedures.groupBy("graph_id", "subgoal_id", "subgoal").agg(F.max("time").alias("time"))
    tables = {
        "semantic": facts, "tag": b.tags(spark, d), "episodic": episodes, "procedural": procedures,
        "subgoal": subgoals.withColumn("embedding", hash_embedding(F.col("subgoal"), b.DIM)),
    }
    asked = asked.withColumn("subgoal_embedding", hash_embedding(F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")), b.DIM))
    rows = retrieve.retrieve(asked, b.query_tags(spark, d), tables, tag_value=TAG_RULE)
    return rows.select(
        "graph_id", "query_id", "mode", "text", F.array_join(F.transform("selected_semantic_ids", lambda x: x.cast("string")), ",").alias("fact_ids"),
        F.array_join(F.transform("selected_procedural_ids", lambda x: x.cast("string")), ",").alias("procedure_ids"),
    )


_TARGETS = """targets AS (
  SELECT query_id, graph_id, (row_number() OVER (PARTITION BY query_id ORDER BY min(p)) - 1)::INTEGER AS target_pos FROM (
    SELECT query_id, unnest([graph_id, 'g0', 'g1', 'gone']) AS graph_id, unnest([0, 1, 2, 3]) AS p FROM queries)
  GROUP BY query_id, graph_id),
target_hits AS (
  SELECT t.query_id, t.graph_id, f.semantic_id,
         row_number() OVER (PARTITION BY t.query_id, t.graph_id
                            ORDER BY round(list_cosine_similarity(q.embedding, f.embedding), 12) DESC, f.semantic_id) AS rank
  FROM targets t JOIN queries q ON q.query_id = t.query_id JOIN facts f ON f.graph_id = t.graph_id)"""


@query("multi_graph_fanout", with_bindings("""
SELECT t.query_id, t.target_pos, t.graph_id, h.fact_ids,
       CASE WHEN t.graph_id NOT IN (SELECT graph_id FROM facts) THEN 'graph not found: ' || t.graph_id END AS error
FROM targets t LEFT JOIN (
  SELECT query_id, graph_id, string_agg(semantic_id, ',' ORDER BY rank) AS fact_ids FROM target_hits WHERE rank <= 3
  GROUP BY query_id, graph_id) h ON h.query_id = t.query_id AND h.graph_id = t.graph_id""", _TARGETS))
def multi_graph_fanout(spark, d) -> DataFrame:
    """Each item asked of its own graph, two shared graphs and one that does not exist."""
    shared = F.array(F.lit("g0"), F.lit("g1"), F.lit("gone"))
    facts = b.facts(spark, d)
    targets = retrieve.fan_out(b.queries(spark, d).withColumn("shared_graphs", shared), facts.select("graph_id").distinct())
    found = nearest(targets.where(F.col("error").isNull()), facts, k=3)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "semantic_id"))), lambda r: r["semantic_id"].cast("string"))
    ids = found.groupBy("graph_id", "query_id").agg(F.array_join(ids, ",").alias("fact_ids"))
    return targets.join(ids, ["graph_id", "query_id"], "left").select("query_id", "target_pos", "graph_id", "error", "fact_ids")


_CHUNKS = """numbered AS (
  SELECT lang AS graph_id, doc_id, text, unnest(range(greatest(1, ceil((length(text) - 256) / 192.0)::INTEGER + 1))) AS chunk
  FROM documents WHERE length(text) > 0),
chunks AS (
  SELECT graph_id, doc_id, chunk::INTEGER AS chunk, trim(substr(text, (chunk * 192 + 1)::INTEGER, 256), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS chunk_text FROM numbered)"""


_PASSAGE_PAIRS = f"""passages AS (
  SELECT doc_id * 10000000 + chunk AS passage_id, chunk_text, {b.sql_hash('chunk_text')} AS embedding FROM chunks WHERE chunk_text <> ''),
passage_pairs AS (
  SELECT q.query_id, p.passage_id, p.chunk_text, list_cosine_similarity(q.embedding, p.embedding) AS relevance FROM queries q, passages p)"""


@query("dense_passages", with_bindings("""
SELECT query_id, passage_id, rank::INTEGER AS rank, round(relevance, 6) AS relevance, '[' || rank || '] (sim) ' || chunk_text AS line FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 12) DESC, passage_id) AS rank FROM passage_pairs)
WHERE rank <= 5""", _CHUNKS, _PASSAGE_PAIRS))
def dense_passages(spark, d) -> DataFrame:
    """Benchmark items against every chunk of every document."""
    chunks = ingest.chunk_text(b.table(spark, d, "documents").select("doc_id", "text"))
    passages = chunks.select(
        F.lit("corpus").alias("graph_id"), (F.col("doc_id") * 10000000 + F.col("chunk")).alias("passage_id"),
        F.col("chunk_text").alias("text"), hash_embedding(F.col("chunk_text"), b.DIM).alias("embedding"),
    )
    asked = b.queries(spark, d).withColumn("graph_id", F.lit("corpus"))
    found = retrieve.dense_passages(asked, passages, k=5)
    line = F.regexp_replace("line", r"^(\[\d+\]) \(sim=-?\d\.\d{4}\)", "$1 (sim)")
    return found.select("query_id", "passage_id", "rank", *_six("relevance"), line.alias("line"))


@query("plan_source", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'override' WHEN 1 THEN 'llm' WHEN 2 THEN source ELSE 'default' END AS source FROM documents")
def plan_source(spark, d) -> DataFrame:
    """Documents as plans handed in, parsed, stated or left out."""
    kind, text = F.col("doc_id") % 4, F.col("text")
    found = retrieve.plan_source(F.when(kind == 0, text), F.when(kind == 1, text), F.when(kind == 2, F.col("source")))
    return b.table(spark, d, "documents").select("doc_id", found.alias("source"))


@query("labelled_blocks", """
SELECT doc_id // 5 AS query_id, string_agg('[graph:' || lang || ' | ' || CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE source END || ']' || chr(10) ||
  CASE WHEN doc_id % 7 = 0 THEN 'no ' || lang ELSE text END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id % 5) AS text
FROM documents GROUP BY doc_id // 5""")
def labelled_blocks(spark, d) -> DataFrame:
    """Documents as the answers of five graphs to one query."""
    failed = F.col("doc_id") % 7 == 0
    answers = b.table(spark, d, "documents").select(
        F.floor(F.col("doc_id") / 5).alias("query_id"), (F.col("doc_id") % 5).alias("target_pos"), F.col("lang").alias("graph_id"), F.col("source").alias("mode"),
        F.when(failed, F.concat(F.lit("no "), F.col("lang"))).alias("error"), "text",
    )
    return retrieve.labelled_blocks(answers)


@query("turn_retrieval", with_bindings(f"""
SELECT query_id, turn_id, round(relevance, 6) AS relevance, rank::INTEGER AS rank FROM (
  SELECT q.query_id, conv_id * 1000000000 + turn AS turn_id,
         list_cosine_similarity(q.embedding, {b.sql_hash("t.role || ' say: ' || t.text")}) AS relevance,
         row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 12) DESC, turn_id) AS rank
  FROM queries q, turns t)
WHERE rank <= 10"""))
def turn_retrieval(spark, d) -> DataFrame:
    """Benchmark items against every dated conversation turn."""
    line = F.concat("role", F.lit(" say: "), "text")
    rows = b.turns(spark, d).select(
        F.lit("chat").alias("graph_id"), (F.col("conv_id") * 1000000000 + F.col("turn")).alias("turn_id"), hash_embedding(line, b.DIM).alias("embedding")
    )
    found = nearest(b.queries(spark, d).withColumn("graph_id", F.lit("chat")), rows, k=10, node_id="turn_id")
    return found.select("query_id", "turn_id", "rank", *_six("relevance"))


@query("nearest_objective", with_bindings(f"""
SELECT query_id, entry_id, round(relevance, 6) AS relevance FROM (
  SELECT q.query_id, p.page_id AS entry_id, list_cosine_similarity(q.embedding, {b.sql_hash('p.url')}) AS relevance
  FROM queries q, pages p)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 12) DESC, entry_id) = 1"""))
def nearest_objective(spark, d) -> DataFrame:
    """Page addresses as stored objectives."""
    pages = b.table(spark, d, "pages").select(
        F.lit("web").alias("graph_id"), F.col("page_id").alias("entry_id"), hash_embedding(F.col("url"), b.DIM).alias("embedding")
    )
    found = retrieve.nearest_objective(b.queries(spark, d).withColumn("graph_id", F.lit("web")), pages)
    return found.select("query_id", "entry_id", *_six("relevance"))


@query("render_fact_ids", with_bindings("""
SELECT graph_id, query_id, string_agg('Fact ' || n || ' (Sem Node ' || semantic_id || '): ' || text, chr(10) ORDER BY semantic_id) AS text FROM (
  SELECT graph_id, query_id, semantic_id, text, row_number() OVER (PARTITION BY query_id ORDER BY semantic_id) - 1 AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 12) DESC, semantic_id) AS rank FROM pairs)
  WHERE rank <= 10) GROUP BY graph_id, query_id""", _NEAR))
def render_fact_ids(spark, d) -> DataFrame:
    facts = b.facts(spark, d)
    return retrieve.render_fact_ids(nearest(b.queries(spark, d), facts, k=10), facts)


@query("recall_logging", with_bindings("""
SELECT graph_id, (row_number() OVER (PARTITION BY graph_id ORDER BY query_id) - 1)::BIGINT AS recall_id, 'retrieve' AS endpoint, fact_ids FROM (
  SELECT graph_id, query_id, string_agg(semantic_id, ',' ORDER BY rank) AS fact_ids FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 12) DESC, semantic_id) AS rank FROM pairs WHERE is_active)
  WHERE rank <= 5 GROUP BY graph_id, query_id)""", _NEAR))
def recall_logging(spark, d) -> DataFrame:
    """Audit rows of one batch of direct retrievals."""
    found = retrieve.direct_facts(b.queries(spark, d), b.facts(spark, d))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "semantic_id"))), lambda r: r["semantic_id"].cast("string"))
    answers = found.groupBy("graph_id", "query_id").agg(F.array_join(ids, ",").alias("fact_ids"))
    none = answers.select("graph_id").distinct().withColumn("last_id", F.lit(None).cast("bigint"))
    rows = retrieve.audit_rows(answers, none, endpoint="retrieve", ts=F.current_timestamp())
    return rows.select("graph_id", "recall_id", "endpoint", "fact_ids")


def _hop(r: int) -> str:
    """One round of iterated retrieval as SQL: asked{r} to hits{r}, new{r} and asked{r+1}."""
    seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM hits{i} s WHERE s.query_id = h.query_id AND s.semantic_id = h.semantic_id)" for i in range(1, r))
    text = "'original question: ' || min(a.question) || chr(10) || string_agg(f.text, chr(10) ORDER BY f.semantic_id)"
    return f"""hop_pairs{r} AS (
  SELECT a.graph_id, a.query_id, f.semantic_id, f.is_active, list_cosine_similarity(a.embedding, f.embedding) AS relevance
  FROM asked{r} a JOIN facts f USING (graph_id)),
hop_pool{r} AS (
  SELECT query_id, semantic_id FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 12) DESC, semantic_id) AS rank FROM hop_pairs{r} WHERE is_active)
  WHERE rank <= 5
  UNION SELECT h.query_id, t.semantic_id FROM tag_hits h JOIN fact_tags t ON t.graph_id = h.graph_id AND t.tag_id = h.tag_id),
hits{r} AS (
  SELECT p.graph_id, p.query_id, p.semantic_id FROM hop_pairs{r} p JOIN hop_pool{r} c ON c.query_id = p.query_id AND c.semantic_id = p.semantic_id
  QUALIFY row_number() OVER (PARTITION BY p.query_id ORDER BY round(relevance, 12) DESC, p.semantic_id) <= 10 AND round(relevance, 12) >= 0),
new{r} AS (SELECT h.* FROM hits{r} h WHERE true {seen}),
asked{r + 1} AS (
  SELECT a.graph_id, a.query_id, min(a.question) AS question, {b.sql_hash(text)} AS embedding
  FROM asked{r} a JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic_id) AS n FROM hits{r}) h ON h.query_id = a.query_id AND h.n <= 3
  JOIN facts f ON f.semantic_id = h.semantic_id WHERE a.query_id IN (SELECT query_id FROM new{r}) GROUP BY a.graph_id, a.query_id)"""


@query("multi_hop", with_bindings(
    "\nUNION ALL ".join(f"SELECT graph_id, query_id, semantic_id, {r} AS round FROM new{r}" for r in (1, 2, 3)),
    _TAG_HITS, "asked1 AS (SELECT graph_id, query_id, question, embedding FROM queries)", _hop(1), _hop(2), _hop(3),
))
def multi_hop(spark, d) -> DataFrame:
    """Three rounds of iterated retrieval; facts found with the round that found them."""
    found, _ = retrieve.multi_hop(
        b.queries(spark, d), b.query_tags(spark, d), b.tags(spark, d), b.facts(spark, d), tag_value=TAG_RULE
    )
    return found.select("graph_id", "query_id", "semantic_id", "round")


# --- baselines without retrieval ---

_ORDER = """drawn AS (
  SELECT q.graph_id, q.query_id, n, ('0x' || substr(md5('0|' || query_id || '|start'), 1, 12))::BIGINT % n AS start,
         [4294967311, 4294967357, 4294967371, 4294967377, 4294967387, 4294967389, 4294967459, 4294967477]
           [('0x' || substr(md5('0|' || query_id || '|stride'), 1, 12))::BIGINT % 8 + 1] % n AS stride
  FROM queries q JOIN (SELECT graph_id, count(*) AS n FROM facts GROUP BY graph_id) USING (graph_id)),
placed AS (SELECT graph_id, semantic_id, row_number() OVER (PARTITION BY graph_id ORDER BY semantic_id) - 1 AS pos FROM facts)"""


@query("random_context", with_bindings("""
SELECT d.graph_id, d.query_id, (d.j + 1)::INTEGER AS rank, p.semantic_id
FROM (SELECT *, unnest(range(least(10, n))) AS j FROM drawn) d
JOIN placed p ON p.graph_id = d.graph_id AND p.pos = (d.start + (d.j * d.stride) % d.n) % d.n""", _ORDER))
def random_context(spark, d) -> DataFrame:
    return evaluate.random_context(b.queries(spark, d), b.facts(spark, d), k=10)


_DRAWS = """draws AS (
  SELECT q.graph_id, q.query_id, unnest(list_reduce(
    list_prepend([]::BIGINT[], [[j] FOR j IN range(greatest(n - 10, 0), n)]),
    lambda taken, x: list_append(taken, CASE
      WHEN list_contains(taken, ('0x' || substr(md5('0|' || query_id || '|draw|' || x[1]), 1, 12))::BIGINT % (x[1] + 1)) THEN x[1]
      ELSE ('0x' || substr(md5('0|' || query_id || '|draw|' || x[1]), 1, 12))::BIGINT % (x[1] + 1) END))) AS pos
  FROM queries q JOIN (SELECT graph_id, count(*) AS n FROM facts GROUP BY graph_id) USING (graph_id))"""


@query("random_context_uniform", with_bindings("""
SELECT d.graph_id, d.query_id, p.semantic_id,
       row_number() OVER (PARTITION BY d.graph_id, d.query_id ORDER BY md5('0|' || d.query_id || '|rank|' || d.pos))::INTEGER AS rank
FROM draws d JOIN placed p ON p.graph_id = d.graph_id AND p.pos = d.pos""", _ORDER, _DRAWS))
def random_context_uniform(spark, d) -> DataFrame:
    return evaluate.uniform_context(b.queries(spark, d), b.facts(spark, d), k=10)


_PACK = """pack_sizes AS (SELECT graph_id, count(*) AS n FROM docs GROUP BY graph_id),
pack_order AS (
  SELECT q.graph_id, q.query_id, n, ('0x' || substr(md5('0|' || query_id || '|start'), 1, 12))::BIGINT % n AS start,
         [4294967311, 4294967357, 4294967371, 4294967377, 4294967387, 4294967389, 4294967459, 4294967477]
           [('0x' || substr(md5('0|' || query_id || '|stride'), 1, 12))::BIGINT % 8 + 1] % n AS stride
  FROM goal_queries q JOIN pack_sizes USING (graph_id)),
pack_places AS (SELECT graph_id, semantic_id, length(text) // 4 AS n_tokens, row_number() OVER (PARTITION BY graph_id ORDER BY semantic_id) - 1 AS pos FROM docs),
pack_walk AS (
  SELECT o.query_id, o.graph_id, o.j, p.semantic_id, p.n_tokens FROM (SELECT *, unnest(range(n)) AS j FROM pack_order) o
  JOIN pack_places p ON p.graph_id = o.graph_id AND p.pos = (o.start + (o.j * o.stride) % o.n) % o.n),
fold(query_id, graph_id, j, total, picks, passage_id, complete) AS (
  SELECT query_id, graph_id, -1::BIGINT, 0::BIGINT, 0, NULL::BIGINT, false FROM pack_order
  UNION ALL
  SELECT f.query_id, f.graph_id, w.j, f.total + CASE WHEN f.total + w.n_tokens <= 20000 THEN w.n_tokens ELSE 0 END,
         f.picks + (f.total + w.n_tokens <= 20000)::INTEGER, CASE WHEN f.total + w.n_tokens <= 20000 THEN w.semantic_id END,
         f.total + CASE WHEN f.total + w.n_tokens <= 20000 THEN w.n_tokens ELSE 0 END > 19800
  FROM fold f JOIN pack_walk w ON w.query_id = f.query_id AND w.j = f.j + 1 WHERE NOT f.complete)"""


@query("context_packing", with_bindings(
    "SELECT graph_id, query_id, (picks - 1)::INTEGER AS pick, passage_id FROM fold WHERE passage_id IS NOT NULL", _PACK
).replace("WITH ", "WITH RECURSIVE ", 1))
def context_packing(spark, d) -> DataFrame:
    """Every benchmark item packs the documents of its language into a budget of 20,000 tokens."""
    passages = b.table(spark, d, "documents").select(
        F.col("lang").alias("graph_id"), F.col("doc_id").alias("passage_id"), F.floor(F.col("n_chars") / 4).cast("bigint").alias("n_tokens")
    )
    asked = b.goal_queries(spark, d).select("graph_id", "query_id", F.lit(20000).cast("bigint").alias("budget"))
    return evaluate.pack_context(asked, passages)
