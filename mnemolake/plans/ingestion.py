"""Registered ingestion, rendering and answer-parsing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import parse, templates
from mnemolake.functions import text as tx
from mnemolake.functions.vector import hash_embedding
from mnemolake.operators import ingest
from mnemolake.plans import bindings as b
from mnemolake.plans.bindings import with_bindings
from mnemolake.plans.registry import query

# --- sessions and dialogues ---

_STEPS = """spoken AS (
  SELECT *, coalesce(sum((role = 'assistant')::INT) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block
  FROM turns WHERE role IN ('user', 'assistant') AND text <> ''),
blocks AS (
  SELECT session_id, block, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user') AS observation,
         max(text) FILTER (role = 'assistant') AS action FROM spoken GROUP BY session_id, block),
steps AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY block) - 1 AS step, observation, action
  FROM blocks WHERE observation IS NOT NULL AND action IS NOT NULL),
dialogue_blocks AS (
  SELECT session_id, block, max(text) FILTER (role = 'user') AS said,
         arg_max(text, turn) FILTER (role = 'assistant') AS answered FROM (
    SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY turn) AS block FROM turns WHERE role IN ('user', 'assistant'))
  GROUP BY session_id, block),
dialogue_steps AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY block) - 1 AS step,
         'User Say: ' || coalesce(said, '...') AS observation, 'Agent Say: ' || coalesce(answered, '...') AS action
  FROM (SELECT *, max(block) OVER (PARTITION BY session_id) AS last FROM dialogue_blocks)
  WHERE block < last OR answered IS NOT NULL)"""


@query("messages_to_steps", with_bindings("SELECT * FROM steps", _STEPS))
def messages_to_steps(spark, d) -> DataFrame:
    return ingest.messages_to_steps(b.lines(spark, d))


@query("dialogue_to_steps", with_bindings("SELECT * FROM dialogue_steps", _STEPS))
def dialogue_to_steps(spark, d) -> DataFrame:
    return ingest.dialogue_to_steps(b.turns(spark, d))


@query("min_steps", with_bindings("""
SELECT * FROM steps WHERE session_id IN (SELECT session_id FROM steps GROUP BY session_id HAVING count(*) >= 2)""", _STEPS))
def min_steps(spark, d) -> DataFrame:
    return ingest.long_enough(ingest.messages_to_steps(b.lines(spark, d)))


@query("infer_goal", with_bindings("""
SELECT session_id, coalesce(first(CASE WHEN length(text) <= 200 THEN text ELSE left(text, 199) || '…' END ORDER BY turn)
                            FILTER (role = 'user' AND text <> ''), 'Agent session') AS goal
FROM turns GROUP BY session_id"""))
def infer_goal(spark, d) -> DataFrame:
    return ingest.infer_goal(b.lines(spark, d), limit=ingest.GOAL_CHARS)


@query("dated_turns", """
SELECT doc_id::VARCHAR AS question_id, 0 AS session_no, unnest([0, 1]) AS turn, 'day ' || n_chars AS date,
       unnest(['user say: ' || source, 'assistant say: ' || text]) AS line FROM documents""")
def dated_turns(spark, d) -> DataFrame:
    """Each document as the answer in a dated two-turn session."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))
    items = b.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("question_id"), F.array(F.array(turn("user", "source"), turn("assistant", "text"))).alias("haystack_sessions"),
        F.array(F.concat(F.lit("day "), F.col("n_chars").cast("string"))).alias("haystack_dates"),
    )
    return ingest.dated_turns(items)


@query("message_flattening", with_bindings("""
SELECT session_id, turn AS ord, role,
       CASE role WHEN 'system' THEN NULL WHEN 'assistant' THEN 'action' ELSE 'observation' END AS part,
       CASE role WHEN 'system' THEN NULL
            WHEN 'assistant' THEN text || chr(10) || '[note(turn=' || turn || ', text=' ||
                 CASE WHEN length(text) <= 80 THEN text ELSE left(text, 79) || '…' END || ')]'
            ELSE '[search result] ' || CASE WHEN length(text) <= 500 THEN text ELSE left(text, 499) || '…' END END AS line
FROM turns"""))
def message_flattening(spark, d) -> DataFrame:
    """Turns rewritten as block messages: assistants call a tool, users become its results."""
    turns = b.turns(spark, d)
    agent = F.col("role") == "assistant"
    text_block = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("map<string,string>").alias("arguments"))
    call = F.struct(
        F.lit("toolCall").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("note").alias("name"),
        F.create_map(F.lit("turn"), F.col("turn").cast("string"), F.lit("text"), F.col("text")).alias("arguments"),
    )
    raw = turns.select(
        "session_id", F.col("turn").alias("ord"), "role",
        F.to_json(F.when(agent, F.array(text_block, call)).otherwise(F.array(text_block))).alias("content"),
        F.lit("search").alias("toolName"), F.lit(False).alias("isError"), F.lit(None).cast("string").alias("command"),
        F.lit(None).cast("string").alias("output"), F.lit(None).cast("int").alias("exitCode"),
    )
    raw = raw.withColumn("role", F.when(F.col("role") == "user", "toolResult").otherwise(F.col("role")))
    rows = ingest.flatten_messages(raw, argument_chars=ingest.ARGUMENT_CHARS, result_chars=ingest.RESULT_CHARS, command_chars=ingest.COMMAND_CHARS)
    return rows.select("session_id", "ord", F.when(F.col("role") == "toolResult", "user").otherwise(F.col("role")).alias("role"), "part", "line")


# --- trajectories ---


@query("structured_defaults", with_bindings("SELECT session_id, turn, CASE WHEN turn % 2 = 1 THEN turn::VARCHAR ELSE '7' END AS time FROM turns"))
def structured_defaults(spark, d) -> DataFrame:
    """Every other turn comes without a time."""
    steps = b.turns(spark, d).withColumn("time", F.when(F.col("turn") % 2 == 1, F.col("turn").cast("string")).otherwise(F.when(F.col("turn") % 4 == 0, "")))
    return ingest.structured_defaults(steps, F.lit(7)).select("session_id", "turn", "time")


@query("observation_shift", with_bindings("""
SELECT session_id, turn, coalesce(lag(text) OVER (PARTITION BY session_id ORDER BY turn), text) AS observation FROM turns"""))
def observation_shift(spark, d) -> DataFrame:
    rows = b.turns(spark, d).select("session_id", "turn", F.col("text").alias("observation"))
    return ingest.observation_shift(rows, ["session_id"], "turn")


@query("segment_trajectory", """
WITH cuts AS (
  SELECT user_id, event_id, lag(event_type) OVER w AS before, (lag(event_type) OVER w IS NOT NULL AND lag(event_type) OVER w <> event_type)::INT AS cut
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
numbered AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY event_id) AS trajectory_num FROM cuts)
SELECT user_id, event_id, trajectory_num::BIGINT AS trajectory_num,
       row_number() OVER (PARTITION BY user_id, trajectory_num ORDER BY event_id) - 1 AS turn_num, before IS NULL AS opens FROM numbered""")
def segment_trajectory(spark, d) -> DataFrame:
    """Users as sessions; a step's subgoal is its event type."""
    steps = b.table(spark, d, "events").select("user_id", "event_id", hash_embedding(F.col("event_type"), 32).alias("subgoal_embedding"))
    rows = ingest.segment_trajectories(steps, ["user_id"], "event_id")
    return rows.select("user_id", "event_id", "trajectory_num", "turn_num", (F.col("similarity_subgoal") == -1).alias("opens"))


@query("render_trajectory", with_bindings("""
SELECT session_id, string_agg('Step ' || step || ':' || chr(10) || '-State: ' || observation || chr(10) || '-Action: ' || action || chr(10)
                              || '-Reward: ' || length(action) || chr(10), '' ORDER BY step) AS text
FROM steps GROUP BY session_id""", _STEPS))
def render_trajectory(spark, d) -> DataFrame:
    steps = ingest.messages_to_steps(b.lines(spark, d)).select(
        "session_id", F.col("step").alias("turn_num"), F.col("observation").alias("state"), "action", F.length("action").cast("string").alias("reward")
    )
    return ingest.render_trajectories(steps, ["session_id"])


@query("render_transcript", with_bindings("""
SELECT session_id, 'Goal: ' || min(session_id) || chr(10)
       || string_agg('[' || step || '] observation: ' || observation || chr(10) || '[' || step || '] action: ' || action, chr(10) ORDER BY step) AS text
FROM steps GROUP BY session_id""", _STEPS))
def render_transcript(spark, d) -> DataFrame:
    steps = ingest.messages_to_steps(b.lines(spark, d))
    goals = steps.select("session_id", F.col("session_id").alias("goal")).distinct()
    return ingest.render_transcripts(steps, goals, ["session_id"])


@query("normalize_flat_episodes", """
SELECT doc_id, 0 AS trajectory_num, (n - 1)::INTEGER AS turn_num, parts[n] AS observation
FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))""")
def normalize_flat_episodes(spark, d) -> DataFrame:
    """Documents as flat lists of text steps, nested into one trajectory and opened again."""
    inserts = b.table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("episodic"))
    rows = ingest.explode_trajectories(ingest.nest_flat_episodes(inserts))
    return rows.select("doc_id", "trajectory_num", "turn_num", "step.observation")


@query("insert_validation", """
SELECT doc_id, CASE WHEN n_chars % 3 = 2 THEN 'unknown mode' WHEN n_chars % 3 = 1 THEN NULL WHEN n_chars % 2 = 1 THEN 'goal missing'
                    WHEN n_chars % 5 = 0 THEN 'steps missing' END AS error FROM documents""")
def insert_validation(spark, d) -> DataFrame:
    """Documents as insert requests: mode, goal and steps by text length."""
    n = F.col("n_chars")
    mode = F.when(n % 3 == 0, "trajectory").when(n % 3 == 1, "structured").otherwise("other")
    goal = F.when(n % 2 == 0, F.col("source")).otherwise("")
    steps = F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.split("text", "\n"))
    return b.table(spark, d, "documents").select("doc_id", ingest.invalid_insert(mode, goal, steps).alias("error"))


@query("trajectory_validation", """
SELECT doc_id, CASE WHEN len(parts) <> 5 THEN 'steps:size:' || len(parts) WHEN list_contains(parts, '') THEN 'steps:null' END AS error
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)""")
def trajectory_validation(spark, d) -> DataFrame:
    """Documents checked as benchmark records of five steps, a blank line being a missing action."""
    parts = F.split("text", "\n")
    rows = b.table(spark, d, "documents").select(
        "doc_id", F.transform(parts, lambda p: F.struct(p.alias("observation"), F.nullif(p, F.lit("")).alias("action"))).alias("steps"), parts.alias("semantic_facts"),
        F.transform(parts, lambda p: F.struct(p.alias("question"), p.alias("gold"))).alias("queries"),
    )
    return rows.select("doc_id", ingest.invalid_trajectory(5, 5).alias("error"))


# --- documents ---

_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


@query("hash_embedding", f"""
SELECT doc_id, list_sum(list_transform(range(64), lambda k: v[k + 1] * (k + 1)))::DOUBLE AS weighted, v[1] AS first_value, v[64] AS last_value
FROM (SELECT doc_id, {b.sql_hash('text')} AS v FROM documents)""")
def hash_embedding_query(spark, d) -> DataFrame:
    rows = b.table(spark, d, "documents").select("doc_id", hash_embedding(F.col("text"), 64).alias("v"))
    weighted = F.aggregate(F.transform("v", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return rows.select("doc_id", weighted.alias("weighted"), F.get("v", F.lit(0)).cast("double").alias("first_value"), F.get("v", F.lit(63)).cast("double").alias("last_value"))


@query("embedding_cache", """
SELECT sha256(text) AS text_hash, count(*) AS n_docs FROM documents GROUP BY 1""")
def embedding_cache(spark, d) -> DataFrame:
    """Documents embedded once per distinct text, those of one language taken from a stored cache."""
    rows = b.table(spark, d, "documents")
    _, cache = ingest.embed_texts(rows.where("lang = 'de'"), "text")
    joined, _ = ingest.embed_texts(rows, "text", cache=cache)
    return joined.where(F.col("embedding").isNotNull()).groupBy(ingest.text_key(F.col("text")).alias("text_hash")).agg(F.count(F.lit(1)).alias("n_docs"))


@query("chunk_text", f"""
SELECT doc_id, chunk::INTEGER AS chunk, chunk_text FROM (
  SELECT doc_id, chunk, trim(substr(text, (chunk * 192 + 1)::INTEGER, 256), {_TRIM}) AS chunk_text FROM (
    SELECT doc_id, text, unnest(range(greatest(1, ceil((length(text) - 256) / 192.0)::INTEGER + 1))) AS chunk FROM documents WHERE length(text) > 0))
WHERE chunk_text <> ''""")
def chunk_text(spark, d) -> DataFrame:
    return ingest.chunk_text(b.table(spark, d, "documents").select("doc_id", "text"))


@query("trace_to_text", f"""
SELECT doc_id, 'observation: ' || trim(text, {_TRIM}) || chr(10) || 'state: ' || lang || chr(10) || 'reward: ' || n_chars || chr(10) || 'subgoal: ' || source AS trace FROM documents""")
def trace_to_text(spark, d) -> DataFrame:
    rows = b.table(spark, d, "documents").select(
        "doc_id", F.col("text").alias("observation"), F.lit("  ").alias("action"), F.col("lang").alias("state"), F.col("n_chars").alias("reward"), F.col("source").alias("subgoal")
    )
    return rows.select("doc_id", ingest.trace_text().alias("trace"))


@query("corpus_passages", f"SELECT doc_id AS id, 'Title: ' || source || chr(10) || 'Text: ' || trim(text, {_TRIM}) AS text FROM documents")
def corpus_passages(spark, d) -> DataFrame:
    return ingest.corpus_passages(b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text"))


@query("corpus_sentences", """
SELECT doc_id AS id, 0 AS passage, (n - 1)::INTEGER AS sentence, parts[n] AS text
FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))""")
def corpus_sentences(spark, d) -> DataFrame:
    """Lines as the sentences of a document's one passage."""
    passage = F.array(F.struct(F.col("source").alias("title"), F.split("text", "\n").alias("sents")))
    return ingest.corpus_passages(b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), passage.alias("context")), "sentence")


@query("whole_context", """
SELECT doc_id AS id, chr(10) || 'Caption:' || source || chr(10) || 'Content:' || chr(10) || replace(text, chr(10), '')
       || chr(10) || 'Caption:' || lang || chr(10) || 'Content:' || chr(10) || source AS text FROM documents""")
def whole_context(spark, d) -> DataFrame:
    """A document's lines and its source as the context passages of one question."""
    passage = lambda title, sents: F.struct(F.col(title).alias("title"), sents.alias("sents"))
    context = F.array(passage("source", F.split("text", "\n")), passage("lang", F.array("source")))
    return ingest.render_contexts(b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), context.alias("context")))


@query("objective_entry", """
SELECT doc_id, 'OBJECTIVE: ' || source || string_agg(chr(10) || 'OBSERVATION_' || n || ': ' || coalesce(o[n], 'N/A') || chr(10) || 'ACTION_' || n || ': ' || coalesce(a[n], 'N/A'), '' ORDER BY n) AS entry
FROM (SELECT doc_id, source, o, a, unnest(range(1, greatest(len(o), 2) + 1)) AS n FROM (SELECT doc_id, source, string_split(text, chr(10)) AS o, [lang, source] AS a FROM documents))
GROUP BY doc_id, source""")
def objective_entry(spark, d) -> DataFrame:
    """A document's lines as observations, its language and source as the actions."""
    entry = ingest.objective_entry(F.col("source"), F.split("text", "\n"), F.array("lang", "source"))
    return b.table(spark, d, "documents").select("doc_id", entry.alias("entry"))


@query("context_window", """
WITH listed AS (SELECT doc_id, string_split(text, chr(10)) AS parts, n_chars % 7 AS element FROM documents),
numbered AS (SELECT doc_id, element, list_transform(parts, lambda p, i: '[' || (i * 2) || '] ' || p) AS parts FROM listed),
placed AS (
  SELECT doc_id, parts, coalesce(
    nullif(list_position(list_transform(parts, lambda p: contains(p, '[' || element || ']')), true), 0),
    nullif(list_position(list_transform(parts, lambda p: regexp_matches(p, '\\b' || element || '\\b')), true), 0)) AS hit
  FROM numbered)
SELECT doc_id, coalesce(array_to_string(parts[greatest(1, hit - 5):hit + 5], chr(10)), '') AS context FROM placed""")
def context_window(spark, d) -> DataFrame:
    """Documents as numbered screens; the acted-on element comes from the text length."""
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda p, i: F.concat(F.lit("["), ((i + 1) * 2).cast("string"), F.lit("] "), p)), "\n")
    rows = b.table(spark, d, "documents").select("doc_id", numbered.alias("screen"), F.concat(F.lit("click ["), (F.col("n_chars") % 7).cast("string"), F.lit("]")).alias("action"))
    return rows.select("doc_id", ingest.context_window(F.col("screen"), F.col("action")).alias("context"))


# --- text-model answers ---


def _responses(spark, d, *parts) -> DataFrame:
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return b.table(spark, d, "documents").select("doc_id", "n_chars", text.alias("response"))


_FLAT = "replace(replace(text, chr(10), ' '), chr(13), ' ')"


@query("parse_facts", f"""
SELECT doc_id, pos AS fact_pos, trim(body, {_TRIM}) AS text, tags FROM (
  SELECT doc_id, unnest([0, 1]) AS pos, unnest([{_FLAT}, 'From ' || source]) AS body,
         unnest([CASE WHEN lang = source THEN lang ELSE lang || '|' || source END, source]) AS tags FROM documents)""")
def parse_facts(spark, d) -> DataFrame:
    flat = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    rows = _responses(
        spark, d, "Thoughts first.\n### Facts\n1. **Statement:** ", flat, "\n   **Tags:** [\"", F.col("lang"), "\", '", F.col("source"), "', ", F.col("lang"), "]\n",
        "2. **Statement:** From ", F.col("source"), " \n **Tags:** `", F.col("source"), "`,", F.col("source"), ":",
    ).drop("n_chars")
    return parse.facts(rows).select("doc_id", "fact_pos", "text", F.array_join("tags", "|").alias("tags"))


@query("parse_summaries", """
SELECT doc_id, unnest([0, 1, 2]) AS fact_pos, unnest(['About ' || source, 'In ' || lang, 'Length ' || n_chars]) AS text FROM documents""")
def parse_summaries(spark, d) -> DataFrame:
    rows = b.table(spark, d, "documents").select(
        "doc_id",
        F.concat(F.lit("1. **Summary:** About "), F.col("source"), F.lit("\n2. **Summary:** In "), F.col("lang")).alias("observation_response"),
        F.concat(F.lit("1. **Summary:** Length "), F.col("n_chars").cast("string"), F.lit(" \n")).alias("action_response"),
    )
    return parse.summaries(rows).select("doc_id", "fact_pos", "text")


@query("parse_sections", f"""
SELECT doc_id, trim(text, {_TRIM}) AS subgoal, '<a reward>' AS reward, n_chars / 10.0::DOUBLE AS score, source AS goal, 'Lesson in ' || lang AS insight,
       CASE WHEN n_chars < 1000 THEN 'episodic_memory' ELSE 'procedural_memory' END AS mode FROM documents""")
def parse_sections(spark, d) -> DataFrame:
    """Headed answers built around each document: subgoal, missing reward, score, goal, insight, mode."""
    rows = b.table(spark, d, "documents")
    answer = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    mode = F.when(F.col("n_chars") < 1000, "episodic_memory").otherwise("procedural_memory")
    goal, insight = parse.procedure(answer("### Goal\n", F.col("source"), "\n### Experiential Insight\nLesson in ", F.col("lang"), "\n"))
    return rows.select(
        "doc_id",
        parse.section_or_default(answer("### Subgoal\n", F.col("text")), "Subgoal").alias("subgoal"),
        parse.section_or_default(F.col("source"), "Reward").alias("reward"),
        parse.score(answer("### Score\n", (F.col("n_chars") / 10).cast("string"), " ")).alias("score"),
        goal.alias("goal"), insight.alias("insight"),
        parse.mode(answer("### Memory Type\n", mode, "\nbecause it fits")).alias("mode"),
    )


@query("parse_plan", """
SELECT doc_id, 'Read ' || source AS next_subgoal, CASE WHEN n_chars % 3 = 2 THEN '' ELSE lang || '|' || source END AS tags FROM documents""")
def parse_plan(spark, d) -> DataFrame:
    """Tags as JSON, as a quoted literal, and unreadable, by text length."""
    kind = F.col("n_chars") % 3
    as_json = F.concat(F.lit('["'), F.col("lang"), F.lit('", "'), F.col("source"), F.lit('"]'))
    as_literal = F.concat(F.lit("['"), F.col("lang"), F.lit("', '"), F.col("source"), F.lit("']"))
    tags = F.when(kind == 0, as_json).when(kind == 1, as_literal).otherwise("none at all")
    rows = _responses(spark, d, "**Tags:** ", tags, "\n### Next Subgoal\nRead ", F.col("source"), "\n")
    subgoal, names = parse.plan(F.col("response"))
    return rows.select("doc_id", subgoal.alias("next_subgoal"), F.array_join(names, "|").alias("tags"))


@query("parse_merge_decision", f"""
SELECT doc_id, CASE n_chars % 4 WHEN 1 THEN 'invalid relationship' WHEN 2 THEN 'missing keys' WHEN 3 THEN 'no JSON object' END AS error,
       CASE WHEN n_chars % 4 = 0 THEN trim(text, {_TRIM}) END AS merged_statement, CASE WHEN n_chars % 4 = 0 THEN true END AS deactivate_earlier,
       CASE WHEN n_chars % 4 = 0 THEN false END AS deactivate_later FROM documents""")
def parse_merge_decision(spark, d) -> DataFrame:
    """Decisions around each document: good, wrong label, missing keys, no object, by text length."""
    kind = F.col("n_chars") % 4
    label = F.when(kind == 1, "MAYBE").otherwise("UPDATE_SAME_FACT")
    full = F.to_json(F.struct(F.col("text").alias("merged_statement"), label.alias("relationship"), F.lit(True).alias("deactivate_earlier"), F.lit("False").alias("deactivate_later"), F.lit("same").alias("simple_reasoning")))
    short = F.to_json(F.struct(F.col("text").alias("merged_statement"), label.alias("relationship")))
    body = F.when(kind == 2, short).when(kind == 3, F.lit("sorry")).otherwise(full)
    rows = _responses(spark, d, "Here it is: ", body, " done.")
    return parse.merge_decision(rows).select("doc_id", "error", "merged_statement", "deactivate_earlier", "deactivate_later")


@query("parse_control", """
SELECT doc_id, n_chars % 3 = 0 AS enough, CASE n_chars % 3 WHEN 0 THEN '' WHEN 1 THEN doc_id || ',' || (doc_id + 2) ELSE doc_id || ',' || (doc_id + 1) || ',' || (doc_id + 2) END AS ids,
       CASE WHEN n_chars % 10 <= 5 THEN (n_chars % 10)::INTEGER ELSE -1 END AS judged FROM documents""")
def parse_control(spark, d) -> DataFrame:
    """Controller and judge answers: enough, chosen ids out of three known ones, score."""
    doc, kind = F.col("doc_id"), F.col("n_chars") % 3
    body = F.concat(
        F.lit('So: {"enough": '), F.when(kind == 0, "true").otherwise("false"), F.lit(', "top_node_ids": ['), doc.cast("string"), F.lit(', "'), (doc + 2).cast("string"),
        F.lit('", '), doc.cast("string"), F.lit(", "), (doc + 9).cast("string"), F.lit("]}"),
    )
    answer = F.when(kind == 2, F.lit("no idea")).otherwise(body)
    rows = b.table(spark, d, "documents").withColumn("_a", answer).withColumn("_known", F.array(doc, doc + 1, doc + 2))
    enough, ids = parse.retrieval_control(F.col("_a"), F.col("_known"))
    score = parse.judge_score(F.concat(F.lit("Score, "), (F.col("n_chars") % 10).cast("string"), F.lit(" of those")))
    return rows.select("doc_id", enough.alias("enough"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"), score.alias("judged"))


@query("reasoning_info", f"""
SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN trim(text, {_TRIM}) ELSE 'plain ' || text END AS info FROM documents""")
def reasoning_info(spark, d) -> DataFrame:
    text = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("Step 1\n###  Relevant Information \n"), F.col("text"))).otherwise(F.concat(F.lit("plain "), F.col("text")))
    return b.table(spark, d, "documents").select("doc_id", parse.reasoning_info(text).alias("info"))


@query("cited_ids", "SELECT doc_id, doc_id || ',' || n_chars AS ids FROM documents")
def cited_ids(spark, d) -> DataFrame:
    rows = _responses(spark, d, "Fact 0 (Sem Node ", F.col("doc_id").cast("string"), "): x\nfact (semnode", F.col("n_chars").cast("string"), ")")
    return rows.select("doc_id", F.array_join(F.transform(tx.cited_ids(F.col("response")), lambda x: x.cast("string")), ",").alias("ids"))


# --- prompts ---


@query("prompt_rendering", """
SELECT doc_id, 'Facts: {braces} ' || text || chr(10) || 'Date: ' || n_chars || chr(10) || 'Question: ' || source AS content FROM documents""")
def prompt_rendering(spark, d) -> DataFrame:
    """The fact-answering prompt filled from each document; braces in values stay as they are."""
    requests = b.table(spark, d, "documents").select(
        F.lit("g").alias("graph_id"), F.lit("reasoning_semantic").alias("name"), "doc_id",
        F.create_map(
            F.lit("semantic_memory"), F.concat(F.lit("{braces} "), F.col("text")), F.lit("time"), F.col("n_chars").cast("string"), F.lit("observation"), F.col("source")
        ).alias("variables"),
    )
    rows = templates.resolve_templates(templates.builtin_templates(spark), requests)
    messages = templates.render_messages(F.col("system"), F.col("user"), F.col("variables"))
    return rows.select("doc_id", F.get(messages, F.lit(1))["content"].alias("content"))


@query("template_layers", """
SELECT lang AS graph_id, 'get_mode' AS name, CASE WHEN lang = (SELECT min(lang) FROM documents) THEN 'graph' ELSE 'service' END AS layer FROM documents GROUP BY lang""")
def template_layers(spark, d) -> DataFrame:
    """Languages as graphs: one has its own template, all share a service-wide one; a broken entry is ignored."""
    langs = b.table(spark, d, "documents").select(F.col("lang").alias("graph_id")).distinct()
    name = F.lit("get_mode").alias("name")
    own = langs.agg(F.min("graph_id").alias("graph_id")).select(F.lit("graph").alias("layer"), "graph_id", name, F.lit("own").alias("system"), F.lit("{observation}").alias("user"))
    broken = langs.select(F.lit("call").alias("layer"), "graph_id", name, F.lit("half").alias("system"), F.lit(None).cast("string").alias("user"))
    shared = own.withColumn("layer", F.lit("service")).withColumn("graph_id", F.lit(None).cast("string"))
    rows = templates.builtin_templates(spark).unionByName(own).unionByName(broken).unionByName(shared)
    return templates.resolve_templates(rows, langs.select("graph_id", name)).select("graph_id", "name", "layer")
