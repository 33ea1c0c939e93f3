"""Prompt templates as table rows: layered resolution and slot filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Layers from weakest to strongest.
LAYERS = ("builtin", "service", "graph", "call")

# Names and slots follow the memory model; the wording is this library's own.
_STEP = "Goal: {goal}\nState before: {state}\nAction taken: {action}\nObservation after: {observation}"
BUILTIN = {
    "get_subgoal": (
        "You name the immediate subgoal of an agent step. Answer under the heading ### Subgoal.",
        "Goal: {goal}\nState: {state}\nObservation: {observation}\nAction: {action}",
    ),
    "get_reward": ("You judge how far a step advanced the goal. Answer under the heading ### Reward.", _STEP),
    "get_state": ("You summarise the state after a step. Answer under the heading ### State.", _STEP),
    "get_semantic": (
        "List the lasting facts in the text under ### Facts, each as **Statement:** and **Tags:** lines.",
        "{observation}",
    ),
    "get_procedural": (
        "State the goal of the trajectory under ### Goal and the lesson under ### Experiential Insight.",
        "Trajectory: {trajectory}",
    ),
    "get_return": (
        "Rate the lesson for the subgoal from 0 to 10 under ### Score.",
        "Subgoal: {subgoal}\nLesson: {procedural_memory}",
    ),
    "get_plan": (
        "Plan the next step: give **Tags:** as a JSON list, then ### Next Subgoal.",
        "Goal: {goal}\nSubgoal: {subgoal}\nState: {state}\nObservation: {observation}",
    ),
    "get_new_semantic": (
        "Decide how two facts combine. Answer with one JSON object holding merged_statement, relationship, "
        "deactivate_earlier, deactivate_later and simple_reasoning.",
        "Earlier: {memory_earlier}\nLater: {memory_later}",
    ),
    "get_new_subgoal": ("Write one goal that covers both.", "Earlier: {goal_1}\nLater: {goal_2}"),
    "get_mode": (
        "Choose the memory type that answers best, under ### Memory Type.",
        "Task: {task_type}\nObservation: {observation}",
    ),
    "reasoning_episodic": (
        "Answer from past conversations.",
        "Information:\n{information}\nDate: {time}\nQuestion: {question}",
    ),
    "reasoning_semantic": (
        "Answer from known facts.",
        "Facts: {semantic_memory}\nDate: {time}\nQuestion: {observation}",
    ),
    "reasoning_procedural": ("Answer from past experience.", "Question: {observation}\nExperience: {procedural_memory}"),
}

SLOT = r"\{([a-z_][a-z0-9_]*)\}"


def builtin_templates(spark: SparkSession) -> DataFrame:
    rows = [("builtin", None, name, system, user) for name, (system, user) in BUILTIN.items()]
    return spark.createDataFrame(rows, "layer string, graph_id string, name string, system string, user string")


def resolve_templates(templates: DataFrame, requests: DataFrame) -> DataFrame:
    """Strongest complete template per (graph_id, name) request; an unknown name fails the job."""
    strength = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    usable = templates.where(F.col("system").isNotNull() & F.col("user").isNotNull()).withColumn("_strength", strength)
    asked = requests.select("graph_id", "name").distinct()
    own = asked.join(usable.where(F.col("graph_id").isNotNull()), ["graph_id", "name"])
    shared = asked.join(usable.where(F.col("graph_id").isNull()).drop("graph_id"), "name")
    best = Window.partitionBy("graph_id", "name").orderBy(F.desc("_strength"))
    rows = own.unionByName(shared).withColumn("_rank", F.row_number().over(best)).where("_rank = 1")
    resolved = requests.join(rows.select("graph_id", "name", "layer", "system", "user"), ["graph_id", "name"], "left")
    unknown = F.assert_true(F.col("system").isNotNull(), F.concat(F.lit("Unknown prompt: "), F.col("name")))
    return resolved.where(unknown.isNull())


def fill(template: Column, variables: Column) -> Column:
    """Replace every ``{slot}`` in one pass from a MAP<STRING,STRING>; a missing variable is an error.

    Values are inserted verbatim: braces inside them are not slots.
    """
    names = F.regexp_extract_all(template, F.lit(SLOT), F.lit(1))
    gaps = F.split(template, SLOT)

    def piece(name: Column, i: Column) -> Column:
        value = F.when(F.map_contains_key(variables, name), F.coalesce(F.element_at(variables, name), F.lit(""))).otherwise(
            F.raise_error(F.concat(F.lit("Missing variable '"), name, F.lit("'")))
        )
        return F.concat(F.get(gaps, i), value)

    filled = F.array_join(F.transform(names, piece), "")
    return F.concat(filled, F.get(gaps, F.size(names)))


def render_messages(system: Column, user: Column, variables: Column) -> Column:
    """ARRAY<STRUCT<role, content>> ready for a text model."""
    return F.array(
        F.struct(F.lit("system").alias("role"), fill(system, variables).alias("content")),
        F.struct(F.lit("user").alias("role"), fill(user, variables).alias("content")),
    )


def prompt_key(messages: Column) -> Column:
    """Key of a rendered prompt in the response table."""
    return F.sha2(F.to_json(messages), 256)


def answer(prompts: DataFrame, responses: DataFrame, key: str = "prompt_hash") -> DataFrame:
    """Join rendered prompts with the response table; rows without an answer keep null."""
    return prompts.join(responses.select(key, "response"), key, "left")
