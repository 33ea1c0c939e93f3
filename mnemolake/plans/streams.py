"""Registered streaming queries: the supplied tables are read as streams until all is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.operators import build
from mnemolake.plans import bindings as b
from mnemolake.plans.bindings import with_bindings
from mnemolake.plans.ingestion import _STEPS
from mnemolake.plans.registry import query
from mnemolake.session import run_folder
from mnemolake.sources.tables import MemoryStore
from mnemolake.streaming import jobs


#: How late an event may come: the whole span of the supplied month.
LATE = "31 days"


class StreamReader:
    """Stands in for a session where a binding reads a table, returning a stream instead."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.read = self

    def parquet(self, path: str) -> DataFrame:
        shape = self.spark.read.parquet(path).schema
        # a pattern, so that one file is taken as well as a folder of files
        return self.spark.readStream.schema(shape).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything available into Parquet files and read them back."""
    folder = run_folder(stream.sparkSession)
    running = (
        stream.writeStream.outputMode(mode).format("parquet").trigger(availableNow=True)
        .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
    )
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_steps", with_bindings("SELECT session_id, step, observation, action FROM steps", _STEPS))
def stream_steps(spark, d) -> DataFrame:
    """Conversation turns as a message stream; equals the batch result."""
    return drain(jobs.stream_steps(b.lines(StreamReader(spark), d)))


@query("stream_audit_window", with_bindings("""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, endpoint, mode, count(*) AS n_recalls, sum(n_messages)::BIGINT AS n_messages FROM audit GROUP BY ALL"""))
def stream_audit_window(spark, d) -> DataFrame:
    """Daily recall counts, days that are still open included."""
    windows = jobs.audit_windows(b.audit(StreamReader(spark), d), late=LATE)
    rows = jobs.latest_windows(windows, ["window_start", "endpoint", "mode"], run_folder(spark))
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query("stream_usage_window", with_bindings("""
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, letter, rounds::INTEGER AS rounds, scope, sum(input_tokens)::BIGINT AS tokens_in,
       sum(output_tokens)::BIGINT AS tokens_out, round(sum(usd), 6) AS usd FROM priced GROUP BY ALL"""))
def stream_usage_window(spark, d) -> DataFrame:
    """Daily tokens and dollars per system and scope, days that are still open included."""
    windows = jobs.usage_windows(b.usage(StreamReader(spark), d), b.prices(spark, d), late=LATE)
    rows = jobs.latest_windows(windows, ["window_start", "letter", "rounds", "scope"], run_folder(spark))
    return rows.withColumn("usd", F.round("usd", 6)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def _inserted(spark, d) -> MemoryStore:
    """Documents arriving as a stream, inserted batch by batch into a fresh store."""
    folder = run_folder(spark)
    store = MemoryStore(spark, f"{folder}/store")

    def insert(batch: DataFrame, batch_id: int) -> None:
        zero = F.lit(0)
        rows = batch.select(
            F.col("lang").alias("graph_id"), F.col("doc_id").alias("insert_id"), "text", "source", F.col("source").alias("session_id"),
            zero.alias("trajectory_num"), zero.alias("turn_num"),
        )
        facts = rows.withColumn("fact_pos", zero).withColumn("tags", F.array("source"))
        steps = rows.withColumn("observation", F.col("source")).withColumn("action", F.lit(""))
        none = F.array().cast("array<float>")
        procedures = (
            rows.limit(0).withColumn("proc_pos", zero).withColumn("subgoal", F.lit(""))
            .withColumn("embedding", none).withColumn("subgoal_embedding", none)
        )
        store.save_insert(build.insert_batch(steps, facts, procedures, store.begin_batch(batch_id)))

    source = StreamReader(spark).parquet(f"{d}/documents.parquet")
    jobs.stream_inserts(source, insert, f"{folder}/state").awaitTermination()
    return store


_STORED = """stored AS (
  SELECT lang AS graph_id, doc_id, text, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS semantic_id FROM documents),
stored_tags AS (
  SELECT graph_id, source AS tag, row_number() OVER (PARTITION BY graph_id ORDER BY min(semantic_id)) - 1 AS tag_id, min(semantic_id) AS time FROM stored GROUP BY graph_id, source)"""


@query("stream_insert", f"""
WITH {_STORED} SELECT graph_id, semantic_id, sha256(text) AS text_hash, tag, t.tag_id, semantic_id AS time,
  3::BIGINT AS n_edges FROM stored s JOIN stored_tags t USING (graph_id) WHERE t.tag = s.source""")
def stream_insert(spark, d) -> DataFrame:
    """Ids, tags, clock and edges of every fact of a streamed insert."""
    store = _inserted(spark, d)
    n = store.load("edges").where("src_type = 'semantic'").groupBy("graph_id", F.col("src_id").alias("semantic_id")).agg(F.count(F.lit(1)).alias("n_edges"))
    return store.load("semantic").join(n, ["graph_id", "semantic_id"]).select(
        "graph_id", "semantic_id", F.sha2("text", 256).alias("text_hash"), F.get("tags", F.lit(0)).alias("tag"), F.get("tag_ids", F.lit(0)).alias("tag_id"), "time", "n_edges"
    )
