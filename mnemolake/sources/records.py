"""Readers and writers for interaction records: sessions, usage, prices, questions, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake import schema
from mnemolake.functions.vector import hash_embedding
from mnemolake.operators.ordered import number_rows

QA_ITEM = (
    "_id string, id string, question string, answer string, context array<array<string>>, "
    "supporting_facts array<array<string>>, "
    "paragraphs array<struct<idx: int, title: string, paragraph_text: string, is_supporting: boolean>>, "
    "question_decomposition array<struct<paragraph_support_idx: int>>"
)
DIALOGUE_ITEM = (
    "question_id string, question string, question_date string, haystack_dates array<string>, "
    "haystack_sessions array<array<struct<role: string, content: string>>>"
)
CORPUS_ITEM = "title string, text string"
BENCH_TRAJECTORY = (
    "trajectory_id string, goal string, steps array<struct<observation: string, action: string>>, "
    "queries array<struct<query_id: string, question: string, gold: string>>, semantic_facts array<string>"
)
OBJECTIVE_ENTRY = "objective string, entry_text string, embedding array<float>"


def parse_session_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Message entries of session logs; blank and broken lines are skipped, other columns carried."""
    entry = F.from_json(F.col(line), f"type string, message struct<{_fields(schema.MESSAGE)}>")
    carried = [c for c in lines.columns if c != line]
    return (
        lines.withColumn("_e", entry)
        .where((F.col("_e.type") == "message") & F.col("_e.message").isNotNull())
        .select(*carried, "_e.message.*")
    )


def _fields(ddl: str) -> str:
    return ", ".join(f"{p.split(' ', 1)[0]}: {p.split(' ', 1)[1]}" for p in ddl.split(", "))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session log files, one JSON entry a line; the file name is the session."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.jsonl)?$", 1)
    # offset of the split plus the row's number in its task: grows along each file
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.text(path).select(
        "value", name.alias("session_id"), (F.col("_metadata.file_block_start") + row).alias("ord")
    )
    return parse_session_lines(lines)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.USAGE).json(path)


def append_usage(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Price list as JSON lines (model, input, output in dollars per million tokens)."""
    return spark.read.schema(schema.PRICES).json(path)


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCH_TRAJECTORY).json(path)


def read_array_file(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON array files, one row per record with its ``position`` in the file."""
    rows = spark.read.schema(ddl).json(path, multiLine=True).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_order")
    )
    return number_rows(rows, ["_file"], ["_order"], "position").drop("_file", "_order")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question files; ``[title, …]`` pairs become structs."""
    rows = read_array_file(spark, path, QA_ITEM)
    context = F.transform(
        "context", lambda p: F.struct(F.get(p, F.lit(0)).alias("title"), F.from_json(F.get(p, F.lit(1)), "array<string>").alias("sents"))
    )
    support = F.transform(
        "supporting_facts", lambda p: F.struct(F.get(p, F.lit(0)).alias("title"), F.get(p, F.lit(1)).try_cast("int").alias("idx"))
    )
    return rows.withColumn("id", F.coalesce("id", "_id")).withColumn("context", context).withColumn("supporting_facts", support).drop("_id")


def sliced(items: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Records from ``start`` through ``end`` inclusive, by position."""
    rows = items.where(F.col("position") >= start)
    return rows if end is None else rows.where(F.col("position") <= end)


def read_objectives(spark: SparkSession, path: str, refresh: bool = False, dim: int = 32) -> DataFrame:
    """Objective-keyed trajectory store; incomplete rows are dropped, vectors optionally recomputed."""
    rows = spark.read.schema(OBJECTIVE_ENTRY).json(path).dropna(subset=["objective", "entry_text", "embedding"])
    return rows.withColumn("embedding", hash_embedding(F.col("objective"), dim)) if refresh else rows


def read_recorded_trajectories(spark: SparkSession, path: str, step: str = "observation string, action string") -> DataFrame:
    """A file per task id holding ``trajectory``: one row per step."""
    task = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    rows = spark.read.schema(f"trajectory array<struct<{_fields(step)}>>").json(path, multiLine=True)
    return rows.select(task.alias("task_id"), F.posexplode("trajectory").alias("step", "_s")).select("task_id", "step", "_s.*")


def write_results(rows: DataFrame, path: str, form: str = "json") -> None:
    """Predictions, metrics, hypotheses or retrieval logs."""
    rows.write.mode("append").format(form).save(path)


def fact_ranges(facts: DataFrame, source: str) -> DataFrame:
    """First and last fact id each corpus row produced."""
    return facts.groupBy("graph_id", source).agg(
        F.min("semantic_id").alias("first_id"), F.max("semantic_id").alias("last_id"), F.count(F.lit(1)).alias("n_facts")
    )


def not_done(items: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Items whose id is not in the output yet."""
    return items.join(done.select(key), key, "left_anti")
