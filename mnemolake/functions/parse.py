"""Reading text-model answers. Prompts and answers are tables; these are the columns in between."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import text as tx

# Answer headings and what stands in when a heading is missing.
SECTION_DEFAULTS = {
    "Subgoal": "<a subgoal>",
    "Reward": "<a reward>",
    "State": "<a state>",
    "Goal": "<a goal>",
    "Next Subgoal": "<the next subgoal>",
    "Memory Type": "semantic_memory",
}
FACT_PATTERN = r"(?d)\*\*Statement:\*\*\s*(.*?)\s*\n\s*\*\*Tags:\*\*\s*(.*?)\s*(?:\n|\z)"
SUMMARY_PATTERN = r"(?s)\*\*Summary:\*\* (.*?)(?=\n\d+\.|\z)"
RELATIONS = ("UPDATE_SAME_FACT", "SAME_TOPIC_MERGE_WELL", "WEAK_RELATED_STITCH_RISK")
DECISION_FIELDS = ("merged_statement", "relationship", "deactivate_earlier", "deactivate_later", "simple_reasoning")
REASONING_HEADINGS = ("Information", r"Relevant\s*Information", "Evidence")


def section(response: Column, heading: str, until: str | None = None) -> Column:
    """Trimmed text under ``### heading`` (to the end, or up to the next named heading), else null."""
    tail = rf"\n### {until}" if until else ""
    pattern = rf"(?s)### {heading}\n(.*){tail}"
    return F.when(F.regexp_like(response, F.lit(pattern)), tx.strip(F.regexp_extract(response, pattern, 1)))


def section_or_default(response: Column, heading: str, until: str | None = None) -> Column:
    return F.coalesce(section(response, heading, until), F.lit(SECTION_DEFAULTS[heading]))


def score(response: Column) -> Column:
    """Number under ``### Score``; 0.0 when missing or not a number."""
    return F.coalesce(section(response, "Score").try_cast("double"), F.lit(0.0))


def procedure(response: Column) -> tuple[Column, Column]:
    """(goal, insight) of a procedural answer."""
    return (
        section_or_default(response, "Goal", until="Experiential Insight"),
        section(response, "Experiential Insight"),
    )


def mode(response: Column) -> Column:
    """First line under ``### Memory Type``."""
    found = F.regexp_extract(response, r"(?d)### Memory Type\n(.*)", 1)
    return F.when(F.regexp_like(response, F.lit(r"### Memory Type\n")), tx.strip(found)).otherwise(SECTION_DEFAULTS["Memory Type"])


def facts(responses: DataFrame, response: str = "response") -> DataFrame:
    """One row per ``**Statement:** / **Tags:**`` pair under ``### Facts``; other columns carried."""
    body = section(F.col(response), "Facts")
    statements = F.regexp_extract_all(F.col("_body"), F.lit(FACT_PATTERN), F.lit(1))
    tags = F.regexp_extract_all(F.col("_body"), F.lit(FACT_PATTERN), F.lit(2))
    carried = [c for c in responses.columns if c != response]
    return (
        responses.withColumn("_body", body)
        .select(*carried, F.posexplode(F.arrays_zip(statements.alias("s"), tags.alias("t"))).alias("fact_pos", "_f"))
        .select(*carried, "fact_pos", F.col("_f.s").alias("text"), tx.clean_tags(F.col("_f.t")).alias("tags"))
    )


def summaries(responses: DataFrame, columns: Sequence[str] = ("observation_response", "action_response")) -> DataFrame:
    """``**Summary:**`` items of the observation answer, then of the action answer; no tags."""
    carried = [c for c in responses.columns if c not in columns]
    lists = [
        F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(SUMMARY_PATTERN), F.lit(1)), tx.strip) for c in columns
    ]
    return responses.select(*carried, F.posexplode(F.concat(*lists)).alias("fact_pos", "text")).withColumn(
        "tags", F.array().cast("array<string>")
    )


def plan(response: Column) -> tuple[Column, Column]:
    """(next subgoal, query tags): tags as a JSON list, else as a quoted list literal, else none."""
    raw = tx.strip(F.regexp_extract(response, r"(?d)\*\*Tags:\*\*\s*(.*)\n", 1))
    literal = F.regexp_replace(raw, r"(?<=[\[,\s])'|'(?=\s*[,\]])", '"')
    tags = F.coalesce(
        F.from_json(raw, "array<string>"), F.from_json(literal, "array<string>"), F.array().cast("array<string>")
    )
    return section_or_default(response, "Next Subgoal"), tags


def json_object(response: Column) -> Column:
    """Fenced JSON object, else the outermost braces."""
    fenced = F.nullif(F.regexp_extract(response, r"(?is)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    outer = F.nullif(F.regexp_extract(response, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(fenced, outer)


def _flag(value: Column) -> Column:
    text = F.lower(tx.strip(value))
    return F.when(text == "true", True).when(text == "false", False)


def merge_decision(responses: DataFrame, response: str = "response") -> DataFrame:
    """Merge decisions with ``error`` (null when accepted): first broken rule names the reason."""
    parsed = F.from_json(json_object(F.col(response)), "map<string,string>")
    rows = responses.withColumn("_d", parsed)
    value = {name: F.col("_d")[name] for name in DECISION_FIELDS}
    statement = tx.strip(value["merged_statement"])
    missing = ~F.forall(F.array(*[F.lit(n) for n in DECISION_FIELDS]), lambda n: F.map_contains_key(F.col("_d"), n))
    error = (
        F.when(F.col("_d").isNull(), "no JSON object")
        .when(missing, "missing keys")
        .when(~F.coalesce(value["relationship"].isin(*RELATIONS), F.lit(False)), "invalid relationship")
        .when(F.coalesce(statement, F.lit("")) == "", "empty statement")
        .when(_flag(value["deactivate_earlier"]).isNull() | _flag(value["deactivate_later"]).isNull(), "not a boolean")
    )
    good = F.col("error").isNull()
    return (
        rows.withColumn("error", error)
        .withColumn("merged_statement", F.when(good, statement))
        .withColumn("relationship", F.when(good, value["relationship"]))
        .withColumn("deactivate_earlier", F.when(good, _flag(value["deactivate_earlier"])))
        .withColumn("deactivate_later", F.when(good, _flag(value["deactivate_later"])))
        .withColumn("simple_reasoning", F.when(good, value["simple_reasoning"]))
        .drop("_d", response)
    )


def retrieval_control(response: Column, available: Column, limit: int = 3) -> tuple[Column, Column]:
    """(enough, chosen ids): known ids only, first mention kept, at most ``limit``; none when enough."""
    parsed = F.from_json(
        F.nullif(F.regexp_extract(response, r"(?s)(\{.*\})", 1), F.lit("")), "struct<enough:boolean,top_node_ids:array<string>>"
    )
    ids = F.transform(parsed["top_node_ids"], lambda x: x.try_cast("bigint"))
    known = F.array_distinct(F.filter(ids, lambda x: F.array_contains(available, x)))
    enough = F.coalesce(parsed["enough"], F.lit(False))
    fallback = F.slice(F.array_sort(F.array_distinct(available)), 1, limit)
    empty = F.array().cast("array<bigint>")
    chosen = F.when(enough, empty).when(parsed["top_node_ids"].isNull(), fallback).otherwise(F.slice(known, 1, limit))
    return enough, chosen


def judge_score(response: Column) -> Column:
    """First integer from 0 to 5 in the answer, -1 without one."""
    words = F.split(tx.strip(F.replace(F.coalesce(response, F.lit("")), F.lit(","), F.lit(" "))), r"\s+")
    numbers = F.transform(F.filter(words, lambda w: F.regexp_like(w, F.lit(r"^[+-]?\d+$"))), lambda w: w.try_cast("int"))
    return F.coalesce(F.get(F.filter(numbers, lambda n: (n >= 0) & (n <= 5)), F.lit(0)), F.lit(-1))


def reasoning_info(response: Column) -> Column:
    """Text under the first heading that names the information, else the whole answer."""
    found = []
    for heading in REASONING_HEADINGS:
        pattern = rf"(?is)###\s*{heading}\s*\n(.*)"
        found.append(F.when(F.regexp_like(response, F.lit(pattern)), tx.strip(F.regexp_extract(response, pattern, 1))))
    return F.coalesce(*found, response)
