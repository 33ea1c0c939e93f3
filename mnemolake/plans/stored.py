"""Registered queries that go through a store: insert, read back, retrieve, consolidate, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.vector import hash_embedding
from mnemolake.operators import build, consolidate
from mnemolake.operators.retrieve import direct_facts, graph_clock, retrieve_tags
from mnemolake.plans import bindings as b
from mnemolake.plans.building import _GREEDY, _PAIRS
from mnemolake.plans.bindings import with_bindings
from mnemolake.plans.registry import query
from mnemolake.session import run_folder
from mnemolake.sources.tables import MemoryStore

_FACTS = """stored AS (
  SELECT lang AS graph_id, doc_id, text, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS semantic_id FROM documents)"""


def _store(spark, d, *, procedures: bool = False) -> MemoryStore:
    """Every document inserted as a fact and an episode; with ``procedures``, as a procedure under its source too."""
    store = MemoryStore(spark, f"{run_folder(spark)}/store")
    zero = F.lit(0)
    rows = b.table(spark, d, "documents").select(
        F.col("lang").alias("graph_id"), F.col("doc_id").alias("insert_id"), "text", "source", F.col("source").alias("session_id"),
        zero.alias("trajectory_num"), zero.alias("turn_num"), hash_embedding(F.col("text"), b.DIM).alias("embedding"),
    )
    facts = rows.withColumn("fact_pos", zero).withColumn("tags", F.array("source"))
    steps = rows.withColumn("observation", F.col("source")).withColumn("action", F.lit(""))
    goals = rows.withColumn("proc_pos", zero).withColumn("subgoal", F.col("source")).withColumn("subgoal_embedding", hash_embedding(F.col("source"), b.DIM))
    out = build.insert_batch(
        steps, facts, goals if procedures else goals.limit(0), store.begin_batch(0), embed=lambda tag: hash_embedding(tag, b.DIM)
    )
    store.save_insert(out)
    return store


@query("stored_tag_retrieve", f"""
WITH {_FACTS}
SELECT graph_id, source AS query_tag, row_number() OVER (PARTITION BY graph_id ORDER BY min(semantic_id)) - 1 AS tag_id FROM stored GROUP BY graph_id, source""")
def stored_tag_retrieve(spark, d) -> DataFrame:
    """Each tag of the inserted documents asked for by its own wording, in the graph as stored: the best hit."""
    store = _store(spark, d)
    asked = b.table(spark, d, "documents").select(F.col("lang").alias("graph_id"), F.col("source").alias("query_tag")).distinct()
    asked = asked.select("graph_id", F.lit(0).alias("query_id"), "query_tag", hash_embedding(F.col("query_tag"), b.DIM).alias("embedding"))
    return retrieve_tags(asked, store.load("tag")).where("rank = 1").select("graph_id", "query_tag", "tag_id")


@query("stored_retrieve", f"""
WITH {_FACTS} SELECT s.graph_id, s.doc_id AS query_id, min(o.semantic_id) AS semantic_id
FROM stored s JOIN stored o ON o.graph_id = s.graph_id AND o.text = s.text WHERE s.doc_id % 20 = 0 GROUP BY s.graph_id, s.doc_id""")
def stored_retrieve(spark, d) -> DataFrame:
    """Every twentieth document looked for among all stored facts of its graph: the closest one."""
    store = _store(spark, d)
    asked = b.table(spark, d, "documents").where("doc_id % 20 = 0").select(
        F.col("lang").alias("graph_id"), F.col("doc_id").alias("query_id"), hash_embedding(F.col("text"), b.DIM).alias("embedding")
    )
    return direct_facts(asked, store.load("semantic"), k=1).select("graph_id", "query_id", "semantic_id")


@query("stored_procedures", f"""
WITH {_FACTS}, goals AS (
  SELECT graph_id, source, row_number() OVER (PARTITION BY graph_id ORDER BY min(semantic_id)) - 1 AS subgoal_id FROM stored GROUP BY graph_id, source)
SELECT s.graph_id, semantic_id AS procedural_id, s.source AS subgoal, g.subgoal_id, doc_id AS insert_id, 1::BIGINT AS n_episodes
FROM stored s JOIN goals g ON g.graph_id = s.graph_id AND g.source = s.source""")
def stored_procedures(spark, d) -> DataFrame:
    """Stored procedures with their subgoal and the episodes their one link opens into."""
    store = _store(spark, d, procedures=True)
    procedures = store.load("procedural")
    members = store.load("episodic").select("graph_id", "insert_id", "trajectory_num", F.lit("episodic").alias("dst_type"), F.col("episodic_id").alias("dst_id"))
    links = store.load("edges").where("kind = 'from_session'")
    opened = build.expand_links(links, members, procedures.select("graph_id", F.col("procedural_id").alias("src_id"), "trajectory_num"))
    n = opened.groupBy("graph_id", F.col("src_id").alias("procedural_id")).agg(F.count(F.lit(1)).alias("n_episodes"))
    return procedures.join(n, ["graph_id", "procedural_id"]).select("graph_id", "procedural_id", "subgoal", "subgoal_id", "insert_id", "n_episodes")


def _consolidated_store(spark, d) -> MemoryStore:
    store = MemoryStore(spark, f"{run_folder(spark)}/store")
    facts = b.facts(spark, d)
    store.append("semantic", facts)
    cited = facts.select("graph_id", "semantic_id", F.explode("episodic_ids").alias("episodic_id"))
    store.append("edges", cited.select(*build.edge("semantic", "semantic_id", "evidenced_by", "episodic", "episodic_id")))
    stored = consolidate.evidence_lists(store.load("semantic"), store.load("edges"))
    store.save_consolidation(consolidate.consolidate(stored, graph_clock(stored), threshold=0.2, min_credibility=2))
    return store


_GREEDY_SQL = with_bindings("{}", _PAIRS, _GREEDY).replace("WITH ", "WITH RECURSIVE ", 1)


@query("stored_consolidate", _GREEDY_SQL.replace("{}", """
SELECT graph_id, semantic_id, is_active AND semantic_id NOT IN (SELECT id_a FROM merges) AND semantic_id NOT IN (SELECT id_b FROM merges)
       AND semantic_id NOT IN (SELECT semantic_id FROM weak) AS is_active, text FROM facts
UNION ALL
SELECT f.graph_id, g.first + row_number() OVER (PARTITION BY f.graph_id ORDER BY m.id_a) - 1, true, f.text || ' ' || h.text
FROM merges m JOIN facts f ON f.semantic_id = m.id_a JOIN facts h ON h.semantic_id = m.id_b
JOIN (SELECT graph_id, max(semantic_id) + 1 AS first FROM facts GROUP BY graph_id) g ON g.graph_id = f.graph_id"""))
def stored_consolidate(spark, d) -> DataFrame:
    """All facts of the store, merged ones too, after a consolidation run was written back."""
    return _consolidated_store(spark, d).load("semantic").select("graph_id", "semantic_id", "is_active", "text")


@query("stored_evidence", _GREEDY_SQL.replace("{}", """
SELECT graph_id, semantic_id AS src_id, 'evidenced_by' AS kind, episode AS dst_id FROM facts
UNION SELECT n.graph_id, n.semantic_id, 'derived_from', unnest([n.id_a, n.id_b]) FROM numbered n
UNION SELECT n.graph_id, n.semantic_id, 'evidenced_by', f.episode FROM numbered n JOIN facts f ON f.semantic_id IN (n.id_a, n.id_b)
UNION SELECT n.graph_id, n.semantic_id, 'tagged', t.tag_id FROM numbered n JOIN fact_tags t ON t.semantic_id IN (n.id_a, n.id_b)""").replace(
    "SELECT graph_id, semantic_id AS src_id", """, numbered AS (
  SELECT f.graph_id, g.first + row_number() OVER (PARTITION BY f.graph_id ORDER BY m.id_a) - 1 AS semantic_id, m.id_a, m.id_b
  FROM merges m JOIN facts f ON f.semantic_id = m.id_a
  JOIN (SELECT graph_id, max(semantic_id) + 1 AS first FROM facts GROUP BY graph_id) g ON g.graph_id = f.graph_id)
SELECT graph_id, semantic_id AS src_id""", 1))
def stored_evidence(spark, d) -> DataFrame:
    """All edges of the store after a consolidation run was written back."""
    return _consolidated_store(spark, d).load("edges").select("graph_id", "src_id", "kind", "dst_id")


@query("stored_old_version", with_bindings("SELECT graph_id, semantic_id, is_active, text FROM facts"))
def stored_old_version(spark, d) -> DataFrame:
    """All facts as they stood before the consolidation, read from the store after it."""
    store = _consolidated_store(spark, d)
    return store.load("semantic", version=store.version() - 1).select("graph_id", "semantic_id", "is_active", "text")
