"""Registered graph-construction and consolidation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import parse, templates
from mnemolake.functions import text as tx
from mnemolake.functions.vector import hash_embedding
from mnemolake.operators import build, consolidate, ingest
from mnemolake.operators.pivot_join import PivotJoin
from mnemolake.operators.retrieve import graph_clock
from mnemolake.plans import bindings as b
from mnemolake.plans.bindings import with_bindings
from mnemolake.plans.registry import query
from mnemolake.sources import records

# --- ids, links, tags ---


@query("dense_ids", "SELECT lang AS graph_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS semantic_id FROM documents WHERE length(text) > 0")
def dense_ids(spark, d) -> DataFrame:
    rows = b.table(spark, d, "documents").select(F.col("lang").alias("graph_id"), "doc_id", "text")
    return build.assign_ids(build.without_blank(rows), ["doc_id"], "semantic_id").select("graph_id", "doc_id", "semantic_id")


@query("tag_upsert", """
WITH mentions AS (SELECT lang AS graph_id, doc_id, unnest([source, lang]) AS tag, unnest([0, 1]) AS pos FROM documents),
first AS (SELECT graph_id, tag, min(doc_id * 10 + pos) AS place, min(doc_id) AS time FROM mentions GROUP BY graph_id, tag)
SELECT graph_id, tag, row_number() OVER (PARTITION BY graph_id ORDER BY place) - 1 AS tag_id, time FROM first""")
def tag_upsert(spark, d) -> DataFrame:
    new, _ = build.upsert_tags(b.docs(spark, d))
    return new.select("graph_id", "tag", "tag_id", "time")


@query("tag_edges", """
WITH mentions AS (SELECT lang AS graph_id, doc_id, unnest([source, lang]) AS tag, unnest([0, 1]) AS pos FROM documents),
first AS (SELECT graph_id, tag, min(doc_id * 10 + pos) AS place FROM mentions GROUP BY graph_id, tag),
ids AS (SELECT graph_id, tag, row_number() OVER (PARTITION BY graph_id ORDER BY place) - 1 AS tag_id FROM first)
SELECT m.graph_id, m.doc_id AS src_id, i.tag_id AS dst_id FROM mentions m JOIN ids i ON i.graph_id = m.graph_id AND i.tag = m.tag""")
def tag_edges(spark, d) -> DataFrame:
    _, edges = build.upsert_tags(b.docs(spark, d))
    return edges.select("graph_id", "src_id", "dst_id")


@query("tag_upsert_stored", """
WITH mentions AS (SELECT lang AS graph_id, doc_id, unnest([source, lang]) AS tag, unnest([0, 1]) AS pos FROM documents),
first AS (SELECT graph_id, tag, min(doc_id * 10 + pos) AS place FROM mentions WHERE tag <> graph_id GROUP BY graph_id, tag)
SELECT graph_id, tag, row_number() OVER (PARTITION BY graph_id ORDER BY place) + 5 AS tag_id FROM first""")
def tag_upsert_stored(spark, d) -> DataFrame:
    """Upsert against a stored tag (the language, id 5): only new ones get ids, after the stored one."""
    docs = b.docs(spark, d)
    stored = docs.select("graph_id", F.lit(5).cast("bigint").alias("tag_id"), F.col("graph_id").alias("tag")).distinct()
    new, _ = build.upsert_tags(docs, stored)
    return new.select("graph_id", "tag", "tag_id")


# arrival-order scan: state is the list of leaders so far
@query("similar_tag_create", with_bindings("SELECT graph_id, tag_key, leader_key FROM scan WHERE tag_key IS NOT NULL", """near AS (
  SELECT c.semantic_id AS b, list(a.semantic_id ORDER BY round(list_cosine_similarity(a.embedding, c.embedding), 12) DESC, a.semantic_id) AS earlier
  FROM facts a JOIN facts c ON c.graph_id = a.graph_id AND c.semantic_id > a.semantic_id
  WHERE round(list_cosine_similarity(a.embedding, c.embedding), 12) >= 0.35 GROUP BY c.semantic_id),
turn AS (
  SELECT f.graph_id, f.semantic_id, coalesce(n.earlier, []) AS earlier, row_number() OVER (ORDER BY f.graph_id, f.semantic_id) AS t
  FROM facts f LEFT JOIN near n ON n.b = f.semantic_id),
scan(t, graph_id, tag_key, leader_key, leaders) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT t, graph_id, semantic_id, coalesce(led, semantic_id), CASE WHEN led IS NULL THEN list_append(leaders, semantic_id) ELSE leaders END
  FROM (SELECT n.t, n.graph_id, n.semantic_id, s.leaders, list_filter(n.earlier, lambda o: list_contains(s.leaders, o))[1] AS led
        FROM scan s JOIN turn n ON n.t = s.t + 1))""").replace("WITH ", "WITH RECURSIVE ", 1))
def similar_tag_create(spark, d) -> DataFrame:
    """Facts as arriving tags: each follows the nearest earlier leader at 0.35 or leads itself."""
    rows = b.facts(spark, d).select("graph_id", F.col("semantic_id").alias("tag_key"), "embedding")
    return build.match_or_create_tags(rows, same=0.35)


@query("sibling_counts", "SELECT lang AS graph_id, doc_id AS semantic_id, count(*) OVER (PARTITION BY lang, doc_id // 4) - 1 AS n_siblings FROM documents")
def sibling_counts(spark, d) -> DataFrame:
    return build.sibling_counts(b.docs(spark, d)).select("graph_id", "semantic_id", "n_siblings")


@query("sibling_edges", "SELECT lang AS graph_id, doc_id AS src_id, 'related' AS kind, 'insert' AS dst_type, doc_id // 4 AS dst_id FROM documents")
def sibling_edges(spark, d) -> DataFrame:
    return build.sibling_links(b.docs(spark, d)).select("graph_id", "src_id", "kind", "dst_type", "dst_id")


@query("siblings_of_flagged", """
WITH asked AS (SELECT lang, doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT a.lang AS graph_id, a.doc_id AS src_id, o.doc_id AS dst_id FROM asked a
JOIN documents o ON o.lang = a.lang AND o.doc_id // 4 = a.doc_id // 4 AND o.doc_id <> a.doc_id""")
def siblings_of_flagged(spark, d) -> DataFrame:
    """Sibling links opened for the facts being read."""
    docs = b.docs(spark, d)
    wanted = docs.where("not is_active").select("graph_id", F.col("semantic_id").alias("src_id"))
    members = docs.select("graph_id", "insert_id", F.lit("semantic").alias("dst_type"), F.col("semantic_id").alias("dst_id"))
    return build.expand_links(build.sibling_links(docs), members, wanted).select("graph_id", "src_id", "dst_id")


def _chat(spark, d) -> tuple[DataFrame, DataFrame]:
    """Episodes of all conversations, and a fact per turn that points at the turn after it."""
    turns = b.turns(spark, d)
    episodes = turns.select(
        F.lit("chat").alias("graph_id"), F.col("conv_id").alias("insert_id"), F.lit(0).cast("bigint").alias("trajectory_num"),
        F.col("turn").alias("turn_num"), (F.col("conv_id") * 1000000000 + F.col("turn")).alias("episodic_id"),
    )
    facts = turns.select(
        F.lit("chat").alias("graph_id"), F.col("conv_id").alias("insert_id"), (F.col("conv_id") * 1000000000 + F.col("turn")).alias("semantic_id"),
        F.lit(0).cast("bigint").alias("trajectory_num"), (F.col("turn") + 1).alias("turn_num"),
    )
    return episodes, facts


@query("evidence_links", """
SELECT c.conv_id * 1000000000 + c.turn AS src_id, CASE WHEN n.turn IS NULL THEN 'insert' ELSE 'episodic' END AS dst_type,
       CASE WHEN n.turn IS NULL THEN c.conv_id ELSE n.conv_id * 1000000000 + n.turn END AS dst_id
FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1""")
def evidence_links(spark, d) -> DataFrame:
    """Each turn's fact rests on the turn after it; the last one on the whole conversation."""
    episodes, facts = _chat(spark, d)
    return build.evidence_links(facts, episodes).select("src_id", "dst_type", "dst_id")


@query("cited_by", """
SELECT n.conv_id * 1000000000 + n.turn AS episodic_id, c.conv_id * 1000000000 + c.turn AS semantic_id
FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1""")
def cited_by(spark, d) -> DataFrame:
    episodes, facts = _chat(spark, d)
    return build.cited_by(build.evidence_links(facts, episodes), episodes).select("episodic_id", "semantic_id")


@query("procedure_links", """
SELECT DISTINCT conv_id AS src_id, 'insert' AS dst_type, conv_id AS dst_id, count(*) OVER (PARTITION BY conv_id) AS n_episodes FROM conversations""")
def procedure_links(spark, d) -> DataFrame:
    """One link per procedure, and how many episodes it opens into."""
    episodes, _ = _chat(spark, d)
    procedures = episodes.select("graph_id", "insert_id", "trajectory_num", F.col("insert_id").alias("procedural_id")).distinct()
    links = build.procedure_links(procedures, episodes)
    members = episodes.select("graph_id", "insert_id", "trajectory_num", F.lit("episodic").alias("dst_type"), F.col("episodic_id").alias("dst_id"))
    opened = build.expand_links(links, members, procedures.select("graph_id", F.col("procedural_id").alias("src_id"), "trajectory_num"))
    n = opened.groupBy("graph_id", "src_id").agg(F.count(F.lit(1)).alias("n_episodes"))
    return links.join(n, ["graph_id", "src_id"]).select("src_id", "dst_type", "dst_id", "n_episodes")


@query("subgoal_upsert", """
WITH seen AS (SELECT lang AS graph_id, source AS subgoal, min(doc_id) AS first, max(doc_id) AS time FROM documents GROUP BY ALL)
SELECT graph_id, subgoal, row_number() OVER (PARTITION BY graph_id ORDER BY first) - 1 AS subgoal_id, time FROM seen""")
def subgoal_upsert(spark, d) -> DataFrame:
    procedures = b.procedures(spark, d, vectors=False).withColumn("subgoal_embedding", hash_embedding(F.col("subgoal"), b.DIM))
    rows, _ = build.upsert_subgoals(procedures)
    return rows.select("graph_id", "subgoal", "subgoal_id", "time")


@query("resolve_subgoals", """
SELECT lang AS graph_id, doc_id AS procedural_id,
       CASE doc_id % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'text' WHEN 2 THEN 'create' ELSE 'similar' END AS resolved_by,
       CASE WHEN doc_id % 4 <> 2 THEN substr(source, 4)::BIGINT END AS subgoal_id
FROM documents""")
def resolve_subgoals(spark, d) -> DataFrame:
    """Procedures naming their subgoal by id, by text, by a wording nothing is close to, or by another one with the same vector."""
    kind = F.col("procedural_id") % 4
    rows = b.procedures(spark, d, vectors=False)
    label = F.when(kind >= 2, F.concat(F.lit("about "), "subgoal")).otherwise(F.col("subgoal"))
    asked = rows.select(
        "graph_id", "procedural_id", label.alias("subgoal"), F.when(kind == 0, F.col("subgoal_id")).alias("stated_subgoal_id"),
        hash_embedding(F.when(kind == 3, F.col("subgoal")).otherwise(label), b.DIM).alias("subgoal_embedding"),
    )
    return build.resolve_subgoals(asked, b.subgoals(spark, d)).select("graph_id", "procedural_id", "resolved_by", "subgoal_id")


# --- edges ---


@query("rebuild_edges", """
SELECT graph_id, semantic_id AS src_id, tag_id::BIGINT AS dst_id FROM (
  SELECT 'g' || (label // 4) AS graph_id, vec_id AS semantic_id, unnest([label, label + 1000]) AS tag_id FROM embeddings)
WHERE tag_id < 1000""")
def rebuild_edges(spark, d) -> DataFrame:
    """Edges from stored id-list text; each list also names a tag that does not exist."""
    facts = b.facts(spark, d)
    label = F.get("tag_ids", F.lit(0))
    stored = facts.select("graph_id", "semantic_id", tx.encode_list(F.array(label, label + 1000, label)).alias("ids"))
    edges = build.edges_from_lists(stored, "semantic", "semantic_id", tx.decode_ids(F.col("ids")), "tagged", "tag", b.tags(spark, d), "tag_id")
    return edges.select("graph_id", "src_id", "dst_id")


@query("edge_repair", with_bindings("""
SELECT graph_id, semantic_id AS src_id, tag_id AS dst_id FROM fact_tags WHERE tag_id < 100
UNION SELECT graph_id, semantic_id, tag_id FROM fact_tags WHERE tag_id >= 90"""))
def edge_repair(spark, d) -> DataFrame:
    """Label tags kept on facts, axis tags kept on tags; the union of both directions."""
    rows = build.fact_tag_rows(b.facts(spark, d))
    forward = rows.where("tag_id < 100").select(*build.edge("semantic", "semantic_id", "tagged", "tag", "tag_id"))
    back = rows.where("tag_id >= 90").select(*build.edge("tag", "tag_id", "tagged", "semantic", "semantic_id"))
    return build.repair_edges(forward, back).select("graph_id", "src_id", "dst_id")


@query("degree_importance", with_bindings("""
SELECT graph_id, tag_id, greatest(3, count(*)) AS importance FROM fact_tags GROUP BY graph_id, tag_id"""))
def degree_importance(spark, d) -> DataFrame:
    edges = build.fact_tag_rows(b.facts(spark, d)).select(*build.edge("semantic", "semantic_id", "tagged", "tag", "tag_id"))
    tags = b.tags(spark, d).withColumn("importance", F.lit(3).cast("bigint"))
    return build.degree_importance(tags, "tag_id", edges, "tagged").select("graph_id", "tag_id", "importance")


@query("lineage", """
WITH RECURSIVE up(semantic_id, ancestor_id, depth) AS (
  SELECT vec_id, vec_id // 3, 1 FROM embeddings WHERE vec_id > 0
  UNION ALL SELECT u.semantic_id, u.ancestor_id // 3, u.depth + 1 FROM up u WHERE u.ancestor_id > 0)
SELECT semantic_id, ancestor_id, min(depth)::INTEGER AS depth FROM up GROUP BY ALL""")
def lineage(spark, d) -> DataFrame:
    """Each vector derived from the one at a third of its number."""
    edges = b.table(spark, d, "embeddings").where("vec_id > 0").select(
        F.lit("g").alias("graph_id"), F.col("vec_id").alias("src_id"), F.lit("derived_from").alias("kind"), F.floor(F.col("vec_id") / 3).alias("dst_id")
    )
    return build.lineage(edges).select("semantic_id", "ancestor_id", "depth")


@query("corpus_build", """
WITH good AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS n FROM documents WHERE n_chars % 11 <> 0)
SELECT lang AS graph_id, doc_id, n * 2 AS first_id, n * 2 + 1 AS last_id, 2::BIGINT AS n_facts FROM good""")
def corpus_build(spark, d) -> DataFrame:
    """Documents to prompts, joined with answers, parsed to facts with ids; documents without an answer yield nothing."""
    docs = b.table(spark, d, "documents")
    passages = ingest.corpus_passages(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text"))
    prompts = passages.select("id", templates.prompt_key(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))).alias("prompt_hash"))
    answered = docs.where("n_chars % 11 <> 0").select("doc_id", "source", "lang")
    responses = answered.join(prompts.withColumnRenamed("id", "doc_id"), "doc_id").groupBy("prompt_hash").agg(
        F.first(F.concat(F.lit("### Facts\n**Statement:** From "), F.col("source"), F.lit("\n**Tags:** a, b\n**Statement:** In "), F.col("lang"), F.lit("\n**Tags:** c"))).alias("response")
    )
    joined = templates.answer(prompts, responses).join(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("graph_id")), "id")
    facts = parse.facts(joined.where(F.col("response").isNotNull()).select("graph_id", F.col("id").alias("doc_id"), "response"))
    numbered = build.assign_ids(build.without_blank(facts), ["doc_id", "fact_pos"], "semantic_id")
    return records.fact_ranges(numbered, "doc_id").select("graph_id", "doc_id", "first_id", "last_id", "n_facts")


# --- consolidation ---

_PAIRS = """pairs AS (
  SELECT DISTINCT a.graph_id, a.semantic_id AS id_a, c.semantic_id AS id_b, list_cosine_similarity(x.embedding, y.embedding) AS score,
         x.episode = y.episode AS barred
  FROM fact_tags a JOIN fact_tags c ON c.graph_id = a.graph_id AND c.tag_id = a.tag_id AND c.semantic_id > a.semantic_id
  JOIN facts x ON x.semantic_id = a.semantic_id JOIN facts y ON y.semantic_id = c.semantic_id
  WHERE x.is_active AND y.is_active)"""
_MERGE_AT = 0.2


@query("consolidation_pairs", with_bindings("SELECT graph_id, id_a, id_b, round(score, 6) AS score, barred FROM pairs WHERE round(score, 12) >= 0.2", _PAIRS))
def consolidation_pairs(spark, d) -> DataFrame:
    """All pairs at the threshold."""
    facts = b.facts(spark, d)
    active = facts.where("is_active")
    rows = consolidate.share_evidence(consolidate.all_pairs(active, active, threshold=_MERGE_AT), facts)
    return rows.select("graph_id", "id_a", "id_b", F.round("score", 6).alias("score"), "barred")


@query("consolidation_pairs_pivots", with_bindings("SELECT graph_id, id_a, id_b, round(score, 6) AS score FROM pairs WHERE round(score, 12) >= 0.2", _PAIRS))
def consolidation_pairs_pivots(spark, d) -> DataFrame:
    """All pairs at the threshold, tags searched through pivots."""
    active = b.facts(spark, d).where("is_active")
    rows = consolidate.all_pairs(active, active, threshold=_MERGE_AT, search=PivotJoin(active, few=64).nearest)
    return rows.select("graph_id", "id_a", "id_b", F.round("score", 6).alias("score"))


@query("consolidation_best_32", with_bindings("""
SELECT graph_id, id_a, id_b, round(score, 6) AS score, barred, place::INTEGER AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY round(score, 12) DESC, id_b) AS place FROM pairs WHERE round(score, 12) >= 0.2)
WHERE place <= 32""", _PAIRS))
def consolidation_best_32(spark, d) -> DataFrame:
    """The 32 best partners of each fact, the list one fold works on."""
    facts = b.facts(spark, d)
    lists = consolidate.candidate_lists(facts.where("is_active"), facts.where("is_active"), threshold=_MERGE_AT)
    rows = consolidate.share_evidence(lists, facts)
    return rows.select("graph_id", "id_a", "id_b", F.round("score", 6).alias("score"), "barred", "place")


@query("consolidation_scope", with_bindings("""
SELECT f.graph_id, semantic_id, time >= greatest(0, now - 100) AND time < now AS scope
FROM facts f JOIN (SELECT graph_id, max(time) + 1 AS now FROM facts GROUP BY graph_id) c ON c.graph_id = f.graph_id"""))
def consolidation_scope(spark, d) -> DataFrame:
    facts = b.facts(spark, d)
    return facts.join(graph_clock(facts), "graph_id").select("graph_id", "semantic_id", consolidate.in_scope(100).alias("scope"))


@query("soft_deactivate", with_bindings("""
SELECT graph_id, semantic_id, CASE WHEN is_active THEN credibility - 3 ELSE credibility END AS credibility,
       is_active AND (CASE WHEN is_active THEN credibility - 3 ELSE credibility END) < 2 AS dropped FROM facts"""))
def soft_deactivate(spark, d) -> DataFrame:
    facts = b.facts(spark, d)
    rows = consolidate.decay_credibility(facts.join(graph_clock(facts), "graph_id"), 3)
    return rows.select("graph_id", "semantic_id", "credibility", consolidate.soft_deactivated(2).alias("dropped"))


def _consolidated(spark, d) -> dict[str, DataFrame]:
    facts = b.facts(spark, d)
    return consolidate.consolidate(facts, graph_clock(facts), threshold=_MERGE_AT, min_credibility=2)


# scan in id order: state is the set of facts gone so far
_GREEDY = """weak AS (SELECT semantic_id FROM facts WHERE is_active AND credibility < 2),
options AS (
  SELECT graph_id, id_a, list({'b': id_b, 'barred': barred} ORDER BY round(score, 12) DESC, id_b) AS others FROM pairs
  WHERE round(score, 12) >= 0.2 AND id_a NOT IN (SELECT semantic_id FROM weak) GROUP BY graph_id, id_a),
turn AS (SELECT *, row_number() OVER (ORDER BY graph_id, id_a) AS t FROM options),
scan(t, gone, a, b) AS (
  SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT t, CASE WHEN pick.b IS NOT NULL AND NOT pick.barred THEN list_concat(gone, [id_a, pick.b]) ELSE gone END,
         CASE WHEN pick.b IS NOT NULL AND NOT pick.barred THEN id_a END, CASE WHEN NOT pick.barred THEN pick.b END
  FROM (SELECT n.t, s.gone, n.id_a,
               CASE WHEN list_contains(s.gone, n.id_a) THEN NULL
                    ELSE list_filter(n.others, lambda o: NOT list_contains(s.gone, o.b))[1] END AS pick
        FROM scan s JOIN turn n ON n.t = s.t + 1)),
merges AS (SELECT a AS id_a, b AS id_b FROM scan WHERE a IS NOT NULL)"""


def _recursive(select: str) -> str:
    return with_bindings(select, _PAIRS, _GREEDY).replace("WITH ", "WITH RECURSIVE ", 1)


@query("consolidate_greedy", _recursive("SELECT f.graph_id, m.id_a, m.id_b FROM merges m JOIN facts f ON f.semantic_id = m.id_a"))
def consolidate_greedy(spark, d) -> DataFrame:
    """Merges of one run over all facts."""
    return _consolidated(spark, d)["merges"].select("graph_id", "id_a", "id_b")


@query("consolidate_merged", _recursive("""
SELECT f.graph_id, g.first + row_number() OVER (PARTITION BY f.graph_id ORDER BY m.id_a) - 1 AS semantic_id, f.text || ' ' || h.text AS text,
       array_to_string(list_sort(list_distinct(list_concat(f.tags, h.tags))), '|') AS tags, m.id_a, m.id_b
FROM merges m JOIN facts f ON f.semantic_id = m.id_a JOIN facts h ON h.semantic_id = m.id_b
JOIN (SELECT graph_id, max(semantic_id) + 1 AS first FROM facts GROUP BY graph_id) g ON g.graph_id = f.graph_id"""))
def consolidate_merged(spark, d) -> DataFrame:
    """Facts created by the merges."""
    rows = _consolidated(spark, d)["merged"]
    return rows.select("graph_id", "semantic_id", "text", F.array_join("tags", "|").alias("tags"), "id_a", "id_b")


@query("consolidate_stats", _recursive("""
SELECT f.graph_id, count(*) AS scanned, count(*) FILTER (NOT is_active OR semantic_id IN (SELECT id_b FROM merges)) AS skipped_inactive,
       count(*) FILTER (is_active AND semantic_id IN (SELECT semantic_id FROM weak) AND semantic_id NOT IN (SELECT id_b FROM merges)) AS soft_deactivated,
       count(*) FILTER (semantic_id IN (SELECT id_a FROM merges)) AS merged_pairs, count(*) FILTER (semantic_id IN (SELECT id_a FROM merges)) AS new_facts
FROM facts f GROUP BY f.graph_id"""))
def consolidate_stats(spark, d) -> DataFrame:
    return _consolidated(spark, d)["stats"]


@query("consolidate_active", _recursive("""
SELECT graph_id, semantic_id, is_active AND semantic_id NOT IN (SELECT id_a FROM merges) AND semantic_id NOT IN (SELECT id_b FROM merges)
       AND semantic_id NOT IN (SELECT semantic_id FROM weak) AS is_active FROM facts"""))
def consolidate_active(spark, d) -> DataFrame:
    """Which facts are active after the run."""
    return _consolidated(spark, d)["facts"].select("graph_id", "semantic_id", "is_active")
