"""Table schemas of the memory model, as DDL. Every table is keyed by ``graph_id``."""

from __future__ import annotations

EPISODIC = (
    "graph_id STRING, episodic_id BIGINT, observation STRING, action STRING, time STRING, "
    "session_id STRING, subgoal STRING, state STRING, reward STRING, insert_id BIGINT, trajectory_num BIGINT"
)
SEMANTIC = (
    "graph_id STRING, semantic_id BIGINT, text STRING, embedding ARRAY<FLOAT>, tags ARRAY<STRING>, tag_ids ARRAY<BIGINT>, "
    "time BIGINT, is_active BOOLEAN, credibility INT, date STRING, session_id STRING, insert_id BIGINT"
)
TAG = (
    "graph_id STRING, tag_id BIGINT, tag STRING, embedding ARRAY<FLOAT>, time BIGINT, importance INT"
)
SUBGOAL = (
    "graph_id STRING, subgoal_id BIGINT, subgoal STRING, embedding ARRAY<FLOAT>, time BIGINT, importance INT"
)
PROCEDURAL = (
    "graph_id STRING, procedural_id BIGINT, text STRING, embedding ARRAY<FLOAT>, time BIGINT, "
    "return_value DOUBLE, session_id STRING, subgoal STRING, subgoal_id BIGINT, insert_id BIGINT, trajectory_num BIGINT"
)
EDGES = (
    "graph_id STRING, src_type STRING, src_id BIGINT, kind STRING, dst_type STRING, dst_id BIGINT"
)
RECALL_AUDIT = (
    "graph_id STRING, recall_id BIGINT, endpoint STRING, ts TIMESTAMP, graph_time BIGINT, "
    "observation STRING, goal STRING, subgoal STRING, state STRING, task_type STRING, mode STRING, "
    "next_subgoal STRING, query_tags ARRAY<STRING>, selected_semantic_ids ARRAY<BIGINT>, "
    "selected_procedural_ids ARRAY<BIGINT>, n_messages INT, session_id STRING"
)
GRAPHS = ("graph_id STRING, created_at TIMESTAMP")
PROMPT_TEMPLATES = ("layer STRING, graph_id STRING, name STRING, system STRING, user STRING")
USAGE = (
    "ts DOUBLE, trajectory_id STRING, query_id STRING, system STRING, scope STRING, phase STRING, "
    "model STRING, input_tokens BIGINT, output_tokens BIGINT, wall_ms DOUBLE, "
    "extra STRUCT<judge_score: INT, dim: INT>"
)
PRICES = ("model STRING, input DOUBLE, output DOUBLE")
EMBEDDING_CACHE = ("text_hash STRING, model STRING, embedding ARRAY<FLOAT>, norm DOUBLE")
RESPONSES = ("prompt_hash STRING, response STRING")
MESSAGE = (
    "role STRING, content STRING, toolName STRING, isError BOOLEAN, command STRING, output STRING, "
    "exitCode INT, stopReason STRING"
)

TABLES = {
    "episodic": EPISODIC,
    "semantic": SEMANTIC,
    "tag": TAG,
    "subgoal": SUBGOAL,
    "procedural": PROCEDURAL,
    "edges": EDGES,
    "recall_audit": RECALL_AUDIT,
}
NODE_TABLES = ("episodic", "semantic", "tag", "subgoal", "procedural")
ID_COLUMN = {name: f"{name}_id" for name in NODE_TABLES} | {"recall_audit": "recall_id"}

# Fixed values of the memory model.
EDGE_KINDS = ("tagged", "evidenced_by", "related", "derived_from", "grouped_by", "from_session")
MODES = ("episodic_memory", "semantic_memory", "procedural_memory")
DEFAULT_CREDIBILITY = 10
DEFAULT_IMPORTANCE = 1
