"""Registered inspection queries: search, pages, detail, degrees, sessions, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import text as tx
from mnemolake.operators import build, inspect, retrieve
from mnemolake.plans import bindings as b
from mnemolake.plans.bindings import with_bindings
from mnemolake.plans.registry import query
from mnemolake.sources import records


@query("search_nodes", with_bindings("""
WITH hits AS (SELECT graph_id, semantic_id, time, text FROM docs WHERE contains(replace(lower(text), 'ß', 'ss'), 'on the') AND is_active)
SELECT graph_id, semantic_id, total, rank::INTEGER AS rank FROM (
  SELECT *, count(*) OVER (PARTITION BY graph_id) AS total, row_number() OVER (PARTITION BY graph_id ORDER BY time DESC, semantic_id) AS rank FROM hits)
WHERE rank <= 50"""))
def search_nodes(spark, d) -> DataFrame:
    rows = inspect.search(b.docs(spark, d), "semantic", "  On The ", limit=50, only_active=True)
    return rows.select("graph_id", "semantic_id", "total", "rank")


@query("search_episodes", with_bindings("""
WITH hits AS (SELECT graph_id, episodic_id, time FROM episodes WHERE contains(lower(observation || chr(10) || action), 'the'))
SELECT graph_id, episodic_id, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY time::BIGINT DESC, episodic_id LIMIT 20"""))
def search_episodes(spark, d) -> DataFrame:
    return inspect.search(b.episodes(spark, d), "episodic", "the", limit=20).select("graph_id", "episodic_id", "total")


@query("browse_page", with_bindings("""
SELECT * FROM (SELECT graph_id, semantic_id, text, row_number() OVER (PARTITION BY graph_id ORDER BY semantic_id) - 1 AS place, count(*) OVER (PARTITION BY graph_id) AS total FROM docs)
WHERE place >= 20 AND place < 70"""))
def browse_page(spark, d) -> DataFrame:
    """The same page of every graph."""
    return inspect.browse(b.docs(spark, d), "semantic", offset=20, limit=50).select("graph_id", "semantic_id", "text", "place", "total")


def _edges(spark, d) -> DataFrame:
    facts = b.facts(spark, d)
    tagged = build.fact_tag_rows(facts).select(*build.edge("semantic", "semantic_id", "tagged", "tag", "tag_id"))
    episodes = facts.select("graph_id", "semantic_id", F.explode("episodic_ids").alias("episodic_id"))
    evidence = episodes.select(*build.edge("semantic", "semantic_id", "evidenced_by", "episodic", "episodic_id"))
    return tagged.unionByName(evidence).unionByName(build.sibling_links(facts))


@query("node_detail", with_bindings("""
WITH near AS (
  SELECT graph_id, semantic_id, 'tagged' AS kind, 'tag' AS type, tag_id AS id FROM fact_tags
  UNION ALL SELECT graph_id, semantic_id, 'evidenced_by', 'episodic', episode FROM facts
  UNION ALL SELECT a.graph_id, a.semantic_id, 'related', 'semantic', o.semantic_id FROM facts a
    JOIN facts o ON o.graph_id = a.graph_id AND o.insert_id = a.insert_id AND o.semantic_id <> a.semantic_id)
SELECT n.graph_id, n.semantic_id, kind, type, id FROM near n JOIN facts f ON f.graph_id = n.graph_id AND f.semantic_id = n.semantic_id WHERE NOT f.is_active"""))
def node_detail(spark, d) -> DataFrame:
    """Neighbours of all inactive facts, siblings opened."""
    facts = b.facts(spark, d)
    wanted = facts.where("not is_active").select("graph_id", "semantic_id")
    members = facts.select("graph_id", "insert_id", F.lit("semantic").alias("dst_type"), F.col("semantic_id").alias("dst_id"))
    edges = build.expand_links(_edges(spark, d), members, wanted.withColumnRenamed("semantic_id", "src_id"))
    edges = edges.where(F.col("src_type") == "semantic")
    rows = inspect.node_detail(facts, "semantic", edges, wanted)
    return rows.where("direction = 'out'").select("graph_id", "semantic_id", "kind", "type", "id")


@query("node_degrees", with_bindings("""
SELECT graph_id, semantic_id, 2::BIGINT AS n_tags, 1::BIGINT AS n_episodics, count(*) OVER (PARTITION BY graph_id, insert_id) - 1 AS n_siblings FROM facts"""))
def node_degrees(spark, d) -> DataFrame:
    rows = inspect.degrees(b.facts(spark, d), "semantic", _edges(spark, d))
    return rows.select("graph_id", "semantic_id", "n_tags", "n_episodics", "n_siblings")


@query("tag_degrees", with_bindings("SELECT graph_id, tag_id, tag, count(*) AS n_semantics FROM fact_tags GROUP BY ALL"))
def tag_degrees(spark, d) -> DataFrame:
    return inspect.degrees(b.tags(spark, d), "tag", _edges(spark, d)).select("graph_id", "tag_id", "tag", "n_semantics")


@query("subgoal_degrees", "SELECT lang AS graph_id, substr(source, 4)::BIGINT AS subgoal_id, count(*) AS n_procedurals, true AS activated FROM documents GROUP BY ALL")
def subgoal_degrees(spark, d) -> DataFrame:
    rows = b.procedures(spark, d, vectors=False)
    edges = rows.select(*build.edge("procedural", "procedural_id", "grouped_by", "subgoal", "subgoal_id"))
    goals = rows.select("graph_id", "subgoal_id").distinct()
    return inspect.degrees(goals, "subgoal", edges).select("graph_id", "subgoal_id", "n_procedurals", "activated")


@query("set_active", with_bindings("""
SELECT d.graph_id, d.semantic_id, coalesce(l.quality = 1, d.is_active) AS is_active FROM docs d LEFT JOIN labels l ON l.doc_id = d.semantic_id"""))
def set_active(spark, d) -> DataFrame:
    """Quality labels switch facts on or off."""
    docs = b.docs(spark, d)
    patch = b.table(spark, d, "labels").select(F.col("doc_id").alias("semantic_id"), (F.col("quality") == 1).alias("is_active"))
    patch = patch.join(docs.select("graph_id", "semantic_id"), "semantic_id")
    return inspect.set_active(docs, patch).select("graph_id", "semantic_id", "is_active")


@query("recall_log", with_bindings("SELECT recall_id, endpoint, mode, session_id FROM audit WHERE session_id = 'u8' ORDER BY recall_id DESC LIMIT 20"))
def recall_log(spark, d) -> DataFrame:
    return inspect.recent_recalls(b.audit(spark, d), session_id="u8", limit=20).select("recall_id", "endpoint", "mode", "session_id")


@query("graph_stats", with_bindings("""
WITH n AS (SELECT graph_id, 'semantic' AS t, count(*) AS c FROM facts GROUP BY graph_id UNION ALL SELECT graph_id, 'tag', count(*) FROM tags GROUP BY graph_id
           UNION ALL SELECT graph_id, 'procedural', count(*) FROM procedures GROUP BY graph_id UNION ALL SELECT graph_id, 'episodic', count(*) FROM episodes GROUP BY graph_id)
SELECT graph_id, coalesce(sum(c) FILTER (t = 'episodic'), 0)::BIGINT AS episodic, coalesce(sum(c) FILTER (t = 'semantic'), 0)::BIGINT AS semantic,
       coalesce(sum(c) FILTER (t = 'tag'), 0)::BIGINT AS tag, 0::BIGINT AS subgoal, coalesce(sum(c) FILTER (t = 'procedural'), 0)::BIGINT AS procedural
FROM n GROUP BY graph_id"""))
def graph_stats(spark, d) -> DataFrame:
    tables = {"semantic": b.facts(spark, d), "tag": b.tags(spark, d), "procedural": b.procedures(spark, d, vectors=False), "episodic": b.episodes(spark, d)}
    rows = inspect.graph_stats(tables)
    return rows.select("graph_id", *[F.col(c).cast("bigint").alias(c) for c in ("episodic", "semantic", "tag", "subgoal", "procedural")])


def _session_tables(spark, d) -> dict[str, DataFrame]:
    """One graph: conversation turns, facts and recalls, sharing session names by number."""
    one = lambda df: df.withColumn("graph_id", F.lit("one"))
    rename = lambda df: one(df).withColumn("session_id", F.concat(F.lit("s"), F.substring("session_id", 2, 20)))
    return {
        "episodic": rename(b.episodes(spark, d)), "semantic": rename(b.facts(spark, d)),
        "recall_audit": rename(b.audit(spark, d)),
    }


_SESSIONS = """session_rows AS (
  SELECT 's' || substr(session_id, 2) AS session_id, 'insert' AS kind, 'episodic' AS node_type, episodic_id AS node_id, time::BIGINT AS time,
         CASE WHEN observation <> '' THEN observation ELSE action END AS body FROM episodes
  UNION ALL SELECT session_id, 'insert', 'semantic', semantic_id, time, text FROM facts
  UNION ALL SELECT 's' || substr(session_id, 2), 'recall', NULL, recall_id, graph_time, NULL FROM audit)"""


@query("distinct_sessions", with_bindings("SELECT DISTINCT 'one' AS graph_id, session_id FROM session_rows", _SESSIONS))
def distinct_sessions(spark, d) -> DataFrame:
    return inspect.sessions(_session_tables(spark, d))


@query("session_timeline", with_bindings("""
WITH cut AS (SELECT *, replace(trim(body, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), chr(10), ' ') AS flat FROM session_rows)
SELECT session_id, kind, node_type, node_id, time, CASE WHEN length(flat) <= 100 THEN flat ELSE left(flat, 99) || '…' END AS label FROM cut""", _SESSIONS))
def session_timeline(spark, d) -> DataFrame:
    return inspect.session_timeline(_session_tables(spark, d)).select("session_id", "kind", "node_type", "node_id", "time", "label")


@query("timeline_counts", with_bindings("SELECT session_id, kind, node_type, count(*) AS n FROM session_rows GROUP BY ALL", _SESSIONS))
def timeline_counts(spark, d) -> DataFrame:
    return inspect.timeline_counts(inspect.session_timeline(_session_tables(spark, d))).select("session_id", "kind", "node_type", "n")


_POOL = """pool AS (
  SELECT graph_id, 'semantic' AS node_type, semantic_id AS node_id, time, 1 AS place FROM facts
  UNION ALL SELECT graph_id, 'tag', tag_id, time, 3 FROM tags WHERE importance >= 2),
sizes AS (SELECT graph_id, node_type, place, count(*) AS size, 120 // count(*) OVER (PARTITION BY graph_id) AS share FROM pool GROUP BY graph_id, node_type, place),
based AS (SELECT *, least(share, size) AS base, sum(size) OVER (PARTITION BY graph_id) AS total,
                 120 - sum(least(share, size)) OVER (PARTITION BY graph_id) AS spare FROM sizes),
quotas AS (
  SELECT graph_id, node_type, CASE WHEN total <= 120 THEN size ELSE base + greatest(0, least(size - base, spare - coalesce(
           sum(size - base) OVER (PARTITION BY graph_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END AS quota FROM based),
shown AS (
  SELECT p.graph_id, p.node_type, p.node_id FROM (
    SELECT *, row_number() OVER (PARTITION BY graph_id, node_type ORDER BY time DESC, node_id) AS rank FROM pool) p
  JOIN quotas q ON q.graph_id = p.graph_id AND q.node_type = p.node_type WHERE rank <= quota)"""


def _topology(spark, d) -> tuple[DataFrame, DataFrame]:
    tables = {"semantic": b.facts(spark, d), "tag": b.tags(spark, d)}
    return inspect.topology(tables, _edges(spark, d), limit=120, min_importance=2)


@query("topology_budget", with_bindings("""
SELECT graph_id, node_type, node_id, CASE node_type WHEN 'semantic' THEN 'sem-' ELSE 'tag-' END || node_id AS uid FROM shown""", _POOL))
def topology_budget(spark, d) -> DataFrame:
    return _topology(spark, d)[0].select("graph_id", "node_type", "node_id", "uid")


@query("topology_edges", with_bindings("""
SELECT t.graph_id, 'sem-' || t.semantic_id AS source, 'tag-' || t.tag_id AS target, 'tagged' AS kind FROM fact_tags t
JOIN shown s ON s.graph_id = t.graph_id AND s.node_type = 'semantic' AND s.node_id = t.semantic_id
JOIN shown g ON g.graph_id = t.graph_id AND g.node_type = 'tag' AND g.node_id = t.tag_id
UNION ALL
SELECT a.graph_id, 'sem-' || a.semantic_id, 'sem-' || o.semantic_id, 'related' FROM facts a
JOIN facts o ON o.graph_id = a.graph_id AND o.insert_id = a.insert_id AND o.semantic_id > a.semantic_id
JOIN shown s ON s.graph_id = a.graph_id AND s.node_type = 'semantic' AND s.node_id = a.semantic_id
JOIN shown g ON g.graph_id = a.graph_id AND g.node_type = 'semantic' AND g.node_id = o.semantic_id""", _POOL))
def topology_edges(spark, d) -> DataFrame:
    return _topology(spark, d)[1].select("graph_id", "source", "target", "kind")


@query("newest_nodes", with_bindings("""
SELECT graph_id, semantic_id, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY time DESC, semantic_id) AS rank FROM docs) WHERE rank <= 25"""))
def newest_nodes(spark, d) -> DataFrame:
    return inspect.newest_first(b.docs(spark, d), "semantic", 25).select("graph_id", "semantic_id", "rank")


@query("resume_undone", "SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_undone(spark, d) -> DataFrame:
    """Documents whose id is not among the finished ones."""
    items = b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang")
    return records.not_done(items, b.table(spark, d, "labels").select(F.col("doc_id").alias("id")))


@query("session_lines", """
SELECT conv_id, turn, doc FROM (SELECT conv_id, turn, text AS doc FROM conversations WHERE role <> 'system')""")
def session_lines(spark, d) -> DataFrame:
    """Session log lines parsed back; other entries and broken lines fall away."""
    rows = b.table(spark, d, "conversations")
    entry = F.to_json(F.struct(
        F.when(F.col("role") == "system", "meta").otherwise("message").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")
    ))
    broken = rows.select("conv_id", "turn", F.lit("{not json").alias("value"))
    lines = rows.select("conv_id", "turn", entry.alias("value")).unionByName(broken)
    return records.parse_session_lines(lines).select("conv_id", "turn", F.col("content").alias("doc"))


@query("labels_and_uids", "SELECT doc_id, 'epis-' || doc_id AS uid, 'a__tagged__' || source AS edge, CASE WHEN length(text) <= 60 THEN text ELSE left(text, 59) || '…' END AS short FROM (SELECT doc_id, source, replace(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), chr(10), ' ') AS text FROM documents)")
def labels_and_uids(spark, d) -> DataFrame:
    rows = b.table(spark, d, "documents")
    return rows.select(
        "doc_id", tx.node_uid(F.lit("episodic"), F.col("doc_id")).alias("uid"), tx.edge_uid(F.lit("a"), F.lit("tagged"), F.col("source")).alias("edge"),
        tx.short_label(F.col("text"), 60).alias("short"),
    )


@query("graph_clock", with_bindings("SELECT graph_id, max(time) + 1 AS now FROM docs GROUP BY graph_id"))
def graph_clock(spark, d) -> DataFrame:
    return retrieve.graph_clock(b.docs(spark, d))
