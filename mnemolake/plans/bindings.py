"""The supplied tables seen as memory tables, once as DataFrames and once as SQL for checking.

facts        embeddings: graph = label // 4, tags = label and strongest axis, session = ten in a row
tags         distinct tags of the facts with their hash vector; importance = number of facts
queries      benchmark items asked of one graph each, with two tags
docs         documents as facts: graph = language, session and tag = source, inactive when toxic
procedures   documents as procedures: subgoal = source
lines        conversations as session messages
audit        view and click events as recalls
usage        events as usage records
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions.vector import hash_embedding
from mnemolake.operators.ingest import flatten_messages

DIM = 64
LANGS = ("en", "de", "es", "fr")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def facts(spark: SparkSession, folder: str) -> DataFrame:
    label, vector = F.col("label"), F.col("embedding")
    axis = F.array_position(vector, F.array_max(vector))
    return table(spark, folder, "embeddings").select(
        _text("g", F.floor(label / 4)).alias("graph_id"),
        F.col("vec_id").alias("semantic_id"),
        _text("Fact ", F.col("vec_id"), " of label ", label).alias("text"),
        "embedding",
        F.array(_text("label-", label), _text("axis-", axis)).alias("tags"),
        F.array(label.cast("bigint"), axis + 100).alias("tag_ids"),
        F.col("vec_id").alias("time"),
        (F.get(vector, F.lit(0)).cast("double") >= F.lit(-0.15)).alias("is_active"),
        (F.lit(10) - label).alias("credibility"),
        _text("s", F.floor(F.col("vec_id") / 10)).alias("session_id"),
        F.floor(F.col("vec_id") / 5).alias("insert_id"),
        F.array(F.floor(F.col("vec_id") / 2)).alias("episodic_ids"),
    )


def tags(spark: SparkSession, folder: str) -> DataFrame:
    rows = facts(spark, folder).select(
        "graph_id", "semantic_id", F.explode(F.arrays_zip("tags", "tag_ids")).alias("_t")
    )
    return (
        rows.groupBy("graph_id", F.col("_t.tag_ids").alias("tag_id"), F.col("_t.tags").alias("tag"))
        .agg(F.min("semantic_id").alias("time"), F.count(F.lit(1)).alias("importance"))
        .withColumn("embedding", hash_embedding(F.col("tag"), DIM))
    )


def queries(spark: SparkSession, folder: str) -> DataFrame:
    item = F.col("item_id")
    return table(spark, folder, "benchmark").select(
        _text("g", item % 3).alias("graph_id"),
        item.alias("query_id"),
        F.col("text").alias("question"),
        hash_embedding(F.col("text"), DIM).alias("embedding"),
        F.array(_text("label-", item % 10), _text("axis-", item % 64 + 1)).alias("query_tags"),
    )


def query_tags(spark: SparkSession, folder: str) -> DataFrame:
    rows = queries(spark, folder).select("graph_id", "query_id", F.explode("query_tags").alias("query_tag"))
    return rows.withColumn("embedding", hash_embedding(F.col("query_tag"), DIM))


def docs(spark: SparkSession, folder: str) -> DataFrame:
    flags = table(spark, folder, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return (
        table(spark, folder, "documents").join(flags, "doc_id", "left").select(
            F.col("lang").alias("graph_id"),
            F.col("doc_id").alias("semantic_id"),
            "text",
            F.array("source", "lang").alias("tags"),
            F.col("doc_id").alias("time"),
            (F.coalesce("toxic", F.lit(0)) == 0).alias("is_active"),
            F.lit(10).alias("credibility"),
            F.col("source").alias("session_id"),
            F.floor(F.col("doc_id") / 4).alias("insert_id"),
        )
    )


def procedures(spark: SparkSession, folder: str, vectors: bool = True) -> DataFrame:
    rows = table(spark, folder, "documents").select(
        F.col("lang").alias("graph_id"),
        F.col("doc_id").alias("procedural_id"),
        "text",
        F.col("source").alias("subgoal"),
        F.substring("source", 4, 10).cast("bigint").alias("subgoal_id"),
        F.col("doc_id").alias("time"),
        (F.col("n_chars") / 1000.0).alias("return_value"),
        F.col("source").alias("session_id"),
    )
    return rows.withColumn("embedding", hash_embedding(F.col("text"), DIM)) if vectors else rows


def subgoals(spark: SparkSession, folder: str) -> DataFrame:
    rows = procedures(spark, folder, vectors=False).groupBy("graph_id", "subgoal_id", "subgoal").agg(
        F.max("time").alias("time"), F.count(F.lit(1)).alias("importance")
    )
    return rows.withColumn("embedding", hash_embedding(F.col("subgoal"), DIM))


def goal_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items asking the procedures of one language for a source."""
    item = F.col("item_id")
    return table(spark, folder, "benchmark").select(
        F.element_at(F.array(*[F.lit(x) for x in LANGS]), (item % 4 + 1).cast("int")).alias("graph_id"),
        item.alias("query_id"),
        F.col("text").alias("question"),
        hash_embedding(_text("src", item % 20), DIM).alias("embedding"),
    )


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        _text("c", F.col("conv_id")).alias("session_id"), "conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text"
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    none = {"toolName": "string", "isError": "boolean", "command": "string", "output": "string", "exitCode": "int"}
    raw = turns(spark, folder).select(
        "session_id", F.col("turn").alias("ord"), "role", F.col("text").alias("content"),
        *[F.lit(None).cast(t).alias(c) for c, t in none.items()],
    )
    return flatten_messages(raw)


def episodes(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation turn as one episode of its session."""
    user = F.col("role") == "user"
    return turns(spark, folder).select(
        F.lit("chat").alias("graph_id"),
        (F.col("conv_id") * 1000000000 + F.col("turn")).alias("episodic_id"),
        F.when(user, F.col("text")).otherwise("").alias("observation"),
        F.when(user, F.lit("")).otherwise(F.col("text")).alias("action"),
        F.col("turn").cast("string").alias("time"),
        "session_id",
        F.col("role").alias("subgoal"),
    )


def audit(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, folder, "events").where(kind.isin("view", "click")).select(
        F.lit("app").alias("graph_id"),
        F.col("event_id").alias("recall_id"),
        F.when(kind == "view", "retrieve").otherwise("reason").alias("endpoint"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("graph_time"),
        F.col("props").alias("observation"),
        F.when(F.col("value") < 20, "semantic_memory").when(F.col("value") < 60, "episodic_memory").otherwise("procedural_memory").alias("mode"),
        F.floor("value").cast("bigint").alias("n_messages"),
        _text("u", F.col("user_id")).alias("session_id"),
    )


def usage(spark: SparkSession, folder: str) -> DataFrame:
    event, kind = F.col("event_id"), F.col("event_type")
    system = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("user_id") % 3 + 1).cast("int"))
    scope = (
        F.when(kind == "error", "EVAL").when(kind == "signup", "INTERNAL_EMBED").when(kind == "purchase", "INTERNAL").otherwise("EXPOSED")
    )
    score = F.get_json_object("props", "$.k").cast("int") % 7 - 1
    return table(spark, folder, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("trajectory_id"),
        _text(system, "@R=", event % 5 + 1).alias("system"),
        scope.alias("scope"),
        F.when(kind == "error", "judge_score").otherwise("call").alias("phase"),
        _text("model-", event % 4).alias("model"),
        F.floor(F.col("value") * 100).cast("bigint").alias("input_tokens"),
        F.floor(F.col("value") * 10).cast("bigint").alias("output_tokens"),
        F.struct(F.when(kind == "error", score).alias("judge_score"), F.lit(None).cast("int").alias("dim")).alias("extra"),
    )


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """Price list over the models seen; the last model is left to the default price."""
    seen = usage(spark, folder).select("model").distinct().where(F.col("model") != "model-3")
    rank = F.substring("model", 7, 5).cast("double")
    return seen.select("model", (rank + 1.0).alias("input"), (rank * 2.0 + 3.0).alias("output"))


def _sql_hash(text: str, dim: int = DIM) -> str:
    byte = f"('0x' || substr(sha256({text}), 2 * (i % 32) + 1, 2))::INTEGER"
    return f"list_transform(range({dim}), lambda i: (({byte} - 128) / 128.0)::DOUBLE)"


sql_hash = _sql_hash
_AXIS = "list_position(embedding, list_max(embedding))"

# The same bindings for the check engine.
SQL = f"""
facts AS (
  SELECT 'g' || (label // 4) AS graph_id, vec_id AS semantic_id, label,
         'Fact ' || vec_id || ' of label ' || label AS text, embedding::DOUBLE[] AS embedding,
         ['label-' || label, 'axis-' || {_AXIS}] AS tags, [label::BIGINT, 100 + {_AXIS}] AS tag_ids,
         vec_id AS time, embedding[1]::DOUBLE >= -0.15::DOUBLE AS is_active, 10 - label AS credibility,
         's' || (vec_id // 10) AS session_id, vec_id // 5 AS insert_id, vec_id // 2 AS episode
  FROM embeddings),
fact_tags AS (SELECT graph_id, semantic_id, unnest(tags) AS tag, unnest(tag_ids) AS tag_id FROM facts),
tags AS (
  SELECT graph_id, tag_id, tag, min(semantic_id) AS time, count(*) AS importance, {_sql_hash('tag')} AS embedding
  FROM fact_tags GROUP BY graph_id, tag_id, tag),
queries AS (
  SELECT 'g' || (item_id % 3) AS graph_id, item_id AS query_id, text AS question, {_sql_hash('text')} AS embedding,
         ['label-' || (item_id % 10), 'axis-' || (item_id % 64 + 1)] AS query_tags
  FROM benchmark),
query_tags AS (
  SELECT graph_id, query_id, query_tag, {_sql_hash('query_tag')} AS embedding
  FROM (SELECT graph_id, query_id, unnest(query_tags) AS query_tag FROM queries)),
docs AS (
  SELECT d.lang AS graph_id, d.doc_id AS semantic_id, d.text, d.source, d.lang, d.doc_id AS time,
         coalesce(l.toxic, 0) = 0 AS is_active, 10 AS credibility, d.source AS session_id, d.doc_id // 4 AS insert_id
  FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
procedures AS (
  SELECT lang AS graph_id, doc_id AS procedural_id, text, source AS subgoal, substr(source, 4)::BIGINT AS subgoal_id,
         doc_id AS time, n_chars / 1000.0::DOUBLE AS return_value, source AS session_id, {_sql_hash('text')} AS embedding
  FROM documents),
subgoals AS (
  SELECT graph_id, subgoal_id, subgoal, max(time) AS time, count(*) AS importance, {_sql_hash('subgoal')} AS embedding
  FROM procedures GROUP BY graph_id, subgoal_id, subgoal),
goal_queries AS (
  SELECT ['en', 'de', 'es', 'fr'][item_id % 4 + 1] AS graph_id, item_id AS query_id,
         {_sql_hash("'src' || (item_id % 20)")} AS embedding
  FROM benchmark),
turns AS (SELECT 'c' || conv_id AS session_id, conv_id, turn, role, text FROM conversations),
episodes AS (
  SELECT 'chat' AS graph_id, conv_id * 1000000000 + turn AS episodic_id,
         CASE WHEN role = 'user' THEN text ELSE '' END AS observation,
         CASE WHEN role = 'user' THEN '' ELSE text END AS action, turn::VARCHAR AS time, session_id, role AS subgoal
  FROM turns),
audit AS (
  SELECT 'app' AS graph_id, event_id AS recall_id,
         CASE WHEN event_type = 'view' THEN 'retrieve' ELSE 'reason' END AS endpoint, ts, event_id AS graph_time,
         props AS observation,
         CASE WHEN value < 20 THEN 'semantic_memory' WHEN value < 60 THEN 'episodic_memory' ELSE 'procedural_memory' END AS mode,
         floor(value)::BIGINT AS n_messages, 'u' || user_id AS session_id
  FROM events WHERE event_type IN ('view', 'click')),
usage AS (
  SELECT ts, user_id::VARCHAR AS trajectory_id, ['A', 'B', 'C'][user_id % 3 + 1] AS letter, event_id % 5 + 1 AS rounds,
         CASE event_type WHEN 'error' THEN 'EVAL' WHEN 'signup' THEN 'INTERNAL_EMBED' WHEN 'purchase' THEN 'INTERNAL'
              ELSE 'EXPOSED' END AS scope,
         'model-' || (event_id % 4) AS model, floor(value * 100)::BIGINT AS input_tokens,
         floor(value * 10)::BIGINT AS output_tokens,
         (json_extract_string(props, '$.k')::INTEGER % 7) - 1 AS judge_score
  FROM events),
priced AS (
  SELECT *, input_tokens / 1e6 * CASE WHEN model = 'model-3' THEN 1.0 ELSE substr(model, 7)::DOUBLE + 1 END
          + output_tokens / 1e6 * CASE WHEN model = 'model-3' THEN 3.0 ELSE substr(model, 7)::DOUBLE * 2 + 3 END AS usd
  FROM usage)
"""


def with_bindings(select: str, *more: str) -> str:
    """Check SQL over the bindings; ``more`` are further named subqueries."""
    own = select.strip().removeprefix("WITH ")
    join = ",\n" if own != select.strip() else "\n"
    return "WITH " + ",\n".join([SQL.strip(), *more]) + join + own
