"""From nested or raw interaction records to rows: steps, trajectories, chunks, rendered texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import text as tx
from mnemolake.functions.vector import cosine, hash_embedding, norm
from mnemolake.operators.ordered import groups_are_small, number_rows, previous_row, running_sum

# Display limits, dialogue placeholders, subgoal cut, chunking.
ARGUMENT_CHARS = 80
RESULT_CHARS = 500
COMMAND_CHARS = 120
GOAL_CHARS = 200
DEFAULT_GOAL = "Agent session"
MIN_STEPS = 2
USER_PREFIX = "User Say: "
AGENT_PREFIX = "Agent Say: "
NOTHING_SAID = "..."
SAME_SUBGOAL = 0.75
CHUNK_CHARS = 256
CHUNK_OVERLAP = 64
TRACE_FIELDS = ("observation", "action", "state", "reward", "subgoal")
CONTEXT_LINES = 5

BLOCKS = "array<struct<type:string,text:string,name:string,arguments:map<string,string>>>"


# --- session messages -------------------------------------------------------------------------


def message_blocks(content: Column) -> Column:
    """Content given as JSON text: block list, or one text block for a plain string."""
    parsed = F.from_json(content, BLOCKS)
    plain = F.array(
        F.struct(
            F.lit("text").alias("type"),
            content.alias("text"),
            F.lit(None).cast("string").alias("name"),
            F.lit(None).cast("map<string,string>").alias("arguments"),
        )
    )
    return F.when(content.isNull(), F.array().cast(BLOCKS)).otherwise(
        F.when(content.startswith("[") & parsed.isNotNull(), parsed).otherwise(plain)
    )


def blocks_text(blocks: Column) -> Column:
    """Texts of the text blocks, one per line."""
    texts = F.filter(blocks, lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != ""))
    return F.array_join(F.transform(texts, lambda b: b["text"]), "\n")


def _limited(text: Column, limit: int | None) -> Column:
    return text if limit is None else tx.truncate(text, limit)


def tool_calls(blocks: Column, limit: int | None = None) -> Column:
    """``[name(key=value, …)]`` per tool call, values whole unless a limit is given."""
    calls = F.filter(
        blocks, lambda b: (b["type"] == "toolCall") & (F.coalesce(b["name"], F.lit("")) != "")
    )

    def one(call: Column) -> Column:
        arguments = F.transform(
            F.map_entries(F.coalesce(call["arguments"], F.create_map().cast("map<string,string>"))),
            lambda e: F.concat(e["key"], F.lit("="), _limited(e["value"], limit)),
        )
        return F.concat(F.lit("["), call["name"], F.lit("("), F.array_join(arguments, ", "), F.lit(")]"))

    return F.array_join(F.transform(calls, one), " ")


def flatten_messages(
    messages: DataFrame, *, argument_chars: int | None = None, result_chars: int | None = None, command_chars: int | None = None
) -> DataFrame:
    """Add ``part`` (observation, action or null) and its ``line`` to raw session messages.

    Texts stay whole; the limits (``ARGUMENT_CHARS``, ``RESULT_CHARS``, ``COMMAND_CHARS``) are for display.
    """
    blocks = message_blocks(F.col("content"))
    text = blocks_text(F.col("_blocks"))
    blank = F.lit("")
    action = F.concat_ws("\n", F.nullif(text, blank), F.nullif(tool_calls(F.col("_blocks"), argument_chars), blank))
    label = F.when(F.coalesce("isError", F.lit(False)), F.concat(F.lit("[ERROR from "), F.col("toolName"), F.lit("]"))).otherwise(
        F.concat(F.lit("["), F.col("toolName"), F.lit(" result]"))
    )
    result = F.concat_ws(" ", label, F.nullif(_limited(text, result_chars), blank))
    prefix = F.when(F.coalesce("exitCode", F.lit(0)) != 0, F.concat(F.lit("[bash exit="), F.col("exitCode").cast("string"), F.lit("]"))).otherwise("[bash]")
    command = F.coalesce(F.nullif(_limited(F.col("command"), command_chars), blank), F.lit("bash"))
    shell = F.concat_ws(
        "\n", F.concat(prefix, F.lit(" "), command), F.nullif(_limited(F.col("output"), result_chars), blank)
    )
    role = F.col("role")
    line = F.when(role == "user", text).when(role == "assistant", action).when(role == "toolResult", result).when(role == "bashExecution", shell)
    part = F.when(role == "assistant", "action").when(role.isin("user", "toolResult", "bashExecution"), "observation")
    return (
        messages.withColumn("_blocks", blocks)
        .withColumn("line", line)
        .withColumn("part", F.when(F.col("line") != "", part))
        .drop("_blocks")
    )


def messages_to_steps(lines: DataFrame, key: Sequence[str] = ("session_id",), order: str = "ord") -> DataFrame:
    """Pair observations with the assistant turn that answers them.

    ``lines`` has ``part`` and ``line``. Everything said between two non-empty assistant turns is one
    observation; a turn with nothing pending opens no step; an unanswered tail is dropped.
    """
    key = list(key)
    spoken = lines.where(F.col("part").isNotNull()).select(*key, order, "part", "line")
    closing = (F.col("part") == "action").cast("bigint")
    # an assistant turn belongs to the block it closes
    small = groups_are_small(spoken, key)
    blocks = running_sum(spoken, key, [order], closing, "_turn", small=small).withColumn("_turn", F.col("_turn") - closing)
    seen = F.when(F.col("part") == "observation", F.col("line"))
    steps = (
        blocks.groupBy(*key, "_turn")
        .agg(
            tx.ordered_join(F.col(order), seen, "\n").alias("observation"),
            F.max(F.when(F.col("part") == "action", F.col("line"))).alias("action"),
            F.count(seen).alias("_n"),
        )
        .where((F.col("_n") > 0) & F.col("action").isNotNull())
    )
    return number_rows(steps, key, ["_turn"], "step", small=small).select(*key, "step", "observation", "action")


def infer_goal(
    lines: DataFrame, key: Sequence[str] = ("session_id",), order: str = "ord", limit: int | None = None
) -> DataFrame:
    """First non-empty user text of each session, whole or cut to ``limit`` characters for display; a generic one if there is none."""
    said = F.when((F.col("role") == "user") & (F.col("line") != ""), F.col("line"))
    first = F.min(F.when(said.isNotNull(), F.struct(F.col(order), said.alias("line"))))
    return lines.groupBy(*key).agg(
        F.coalesce(_limited(first["line"], limit), F.lit(DEFAULT_GOAL)).alias("goal")
    )


def long_enough(steps: DataFrame, key: Sequence[str] = ("session_id",), minimum: int = MIN_STEPS) -> DataFrame:
    """Steps of sessions with at least ``minimum`` steps."""
    keep = steps.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    return steps.join(keep.drop("_n"), list(key), "left_semi")


# --- dialogues --------------------------------------------------------------------------------


def dialogue_to_steps(turns: DataFrame, key: Sequence[str] = ("session_id",), order: str = "turn") -> DataFrame:
    """Each user turn is an observation; the last assistant turn before the next one is its action.

    A missing answer or a missing opening user turn reads ``...``; a trailing user turn stays open.
    Other roles are skipped.
    """
    key = list(key)
    turns = turns.where(F.col("role").isin("user", "assistant"))
    opens = (F.col("role") != "assistant").cast("bigint")
    small = groups_are_small(turns, key)
    blocks = running_sum(turns.select(*key, order, "role", "text"), key, [order], opens, "_turn", small=small)
    is_agent = F.col("role") == "assistant"
    per_turn = blocks.groupBy(*key, "_turn").agg(
        F.max(F.when(~is_agent, F.col("text"))).alias("_user"),
        F.max(F.when(is_agent, F.struct(order, "text"))).alias("_agent"),
    )
    last = per_turn.groupBy(*key).agg(F.max("_turn").alias("_last"))
    silence = F.lit(NOTHING_SAID)
    steps = (
        per_turn.join(last, key)
        .where((F.col("_turn") < F.col("_last")) | F.col("_agent").isNotNull())
        .withColumn("observation", F.concat(F.lit(USER_PREFIX), F.coalesce("_user", silence)))
        .withColumn("action", F.concat(F.lit(AGENT_PREFIX), F.coalesce(F.col("_agent.text"), silence)))
    )
    return number_rows(steps, key, ["_turn"], "step", small=small).select(*key, "step", "observation", "action")


def dated_turns(items: DataFrame) -> DataFrame:
    """Dialogue items to dated lines: one row per turn of every haystack session."""
    sessions = items.select("question_id", F.posexplode(F.arrays_zip("haystack_sessions", "haystack_dates")).alias("session_no", "_s"))
    turns = sessions.select(
        "question_id", "session_no", F.col("_s.haystack_dates").alias("date"),
        F.posexplode("_s.haystack_sessions").alias("turn", "_t"),
    )
    return turns.select(
        "question_id", "session_no", "turn", "date",
        F.concat(F.col("_t.role"), F.lit(" say: "), F.col("_t.content")).alias("line"),
    )


# --- trajectories -----------------------------------------------------------------------------


def explode_trajectories(inserts: DataFrame) -> DataFrame:
    """``episodic ARRAY<ARRAY<STRUCT>>`` to one row per step with its trajectory and turn number."""
    outer = inserts.select(*[c for c in inserts.columns if c != "episodic"], F.posexplode("episodic").alias("trajectory_num", "_t"))
    return outer.select(*[c for c in outer.columns if c != "_t"], F.posexplode("_t").alias("turn_num", "step"))


def nest_flat_episodes(inserts: DataFrame) -> DataFrame:
    """A flat step list is one trajectory; facts and procedures then point at trajectory 0.

    Text-only steps become ``{observation: text}``. Nested input passes unchanged.
    """
    kind = dict(inserts.dtypes)["episodic"]
    if kind.startswith("array<array<"):
        return inserts
    steps = F.col("episodic")
    if kind == "array<string>":
        steps = F.transform(
            steps, lambda s: F.struct(s.alias("observation"), F.lit("").alias("action"))
        )
    out = inserts.withColumn("episodic", F.when(F.size("episodic") > 0, F.array(steps)))
    for name in ("semantic", "procedural"):
        if name in inserts.columns and inserts.schema[name].dataType.typeName() == "array":
            zeroed = F.transform(F.col(name), lambda x: x.withField("trajectory_num", F.lit(0)))
            out = out.withColumn(name, F.when(F.size("episodic") > 0, zeroed).otherwise(F.col(name)))
    return out


def structured_defaults(steps: DataFrame, graph_time: Column) -> DataFrame:
    """Step time falls back to the graph's logical time."""
    return steps.withColumn("time", F.coalesce(F.nullif(F.col("time"), F.lit("")), graph_time.cast("string")))


def observation_shift(steps: DataFrame, key: Sequence[str], order: str = "turn_num") -> DataFrame:
    """The observation recorded with a step is the one before it (the first step keeps its own)."""
    shifted = previous_row(steps, list(key), [order], ["observation"], "_previous")
    return shifted.withColumn(
        "observation", F.when(F.col("_previous").isNull(), F.col("observation")).otherwise(F.col("_previous.observation"))
    ).drop("_previous")


def segment_trajectories(steps: DataFrame, key: Sequence[str], order: str = "step", same: float = SAME_SUBGOAL) -> DataFrame:
    """Cut a session where a step's subgoal vector differs from the one before.

    Adds ``similarity_subgoal`` (-1 on a trajectory's first step, which never cuts),
    ``trajectory_num`` and ``turn_num``.
    """
    key = list(key)
    small = groups_are_small(steps, key)
    rows = steps.withColumn("_norm", norm(F.col("subgoal_embedding")))
    rows = previous_row(rows, key, [order], ["subgoal_embedding", "_norm"], "_before", small=small)
    near = cosine(F.col("_before.subgoal_embedding"), F.col("subgoal_embedding"), F.col("_before._norm"), F.col("_norm"))
    rows = rows.withColumn("similarity_subgoal", F.when(F.col("_before").isNull(), F.lit(-1.0)).otherwise(near))
    cut = (F.col("_before").isNotNull() & (F.round("similarity_subgoal", 12) < same)).cast("bigint")
    rows = running_sum(rows, key, [order], cut, "trajectory_num", small=small).drop("_before", "_norm")
    return number_rows(rows, [*key, "trajectory_num"], [order], "turn_num", small=small or None)


def render_trajectories(steps: DataFrame, key: Sequence[str]) -> DataFrame:
    """``Step i:`` blocks of state, action and reward, one text per trajectory."""
    blank = F.lit("")
    line = F.concat(
        F.lit("Step "), F.col("turn_num").cast("string"),
        F.lit(":\n-State: "), F.coalesce("state", blank),
        F.lit("\n-Action: "), F.coalesce("action", blank),
        F.lit("\n-Reward: "), F.coalesce("reward", blank), F.lit("\n"),
    )
    return steps.groupBy(*key).agg(tx.ordered_join(F.col("turn_num"), line, "").alias("text"))


def render_transcripts(steps: DataFrame, goals: DataFrame, key: Sequence[str], order: str = "step") -> DataFrame:
    """Goal line followed by numbered observation and action lines."""
    n = F.col(order).cast("string")
    line = F.concat(
        F.lit("["), n, F.lit("] observation: "), F.col("observation"),
        F.lit("\n["), n, F.lit("] action: "), F.col("action"),
    )
    body = steps.groupBy(*key).agg(tx.ordered_join(F.col(order), line, "\n").alias("_body"))
    return goals.join(body, list(key), "left").select(
        *key, F.concat_ws("\n", F.concat(F.lit("Goal: "), F.col("goal")), F.col("_body")).alias("text")
    )


def render_contexts(items: DataFrame) -> DataFrame:
    """All context passages of a question as ``Caption/Content`` blocks."""
    block = F.transform(
        "context",
        lambda c: F.concat(F.lit("\nCaption:"), c["title"], F.lit("\nContent:\n"), F.array_join(c["sents"], "")),
    )
    return items.select("id", F.array_join(block, "").alias("text"))


def invalid_insert(mode: Column, goal: Column, steps: Column) -> Column:
    """Why an insert request is refused, or null."""
    return (
        F.when(~F.coalesce(mode, F.lit("")).isin("trajectory", "structured"), "unknown mode")
        .when((mode == "trajectory") & (F.coalesce(goal, F.lit("")) == ""), "goal missing")
        .when((mode == "trajectory") & (F.coalesce(F.size(steps), F.lit(0)) <= 0), "steps missing")
    )


def invalid_trajectory(n_steps: int, n_queries: int) -> Column:
    """First broken rule of a benchmark trajectory record as ``field:size:found`` or ``field:null``; null if none."""

    def size_rule(name: str, wanted: int) -> Column:
        found = F.coalesce(F.size(name), F.lit(0))
        found = F.when(F.col(name).isNull(), 0).otherwise(found)
        return F.when(found != wanted, F.concat(F.lit(f"{name}:size:"), found.cast("string")))

    def null_rule(name: str, fields: Sequence[str]) -> Column:
        return F.when(F.exists(name, lambda r: F.greatest(*[r[f].isNull() for f in fields])), f"{name}:null")

    sizes = {"steps": n_steps, "semantic_facts": n_steps, "queries": n_queries}
    whole = {"steps": ("observation", "action"), "queries": ("question", "gold")}
    return F.coalesce(*[size_rule(*r) for r in sizes.items()], *[null_rule(*r) for r in whole.items()])


# --- documents and traces ---------------------------------------------------------------------


def trace_text(fields: Sequence[str] = TRACE_FIELDS) -> Column:
    """``field: value`` lines in fixed order, blanks left out."""
    lines = [
        F.concat(F.lit(f"{f}: "), F.nullif(tx.strip(F.col(f).cast("string")), F.lit(""))) for f in fields
    ]
    return F.concat_ws("\n", *lines)


def chunk_text(documents: DataFrame, id_column: str = "doc_id", size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Fixed-size character chunks with overlap over whole texts; blank chunks dropped."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    stride = size - overlap
    # one left-to-right pass: look ahead a whole chunk, move on by the stride
    every = F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{stride}}}"), F.lit(1))
    # the first chunk that reaches the end of the text is the last one
    count = F.greatest(F.lit(1), F.ceil((F.length("text") - size) / F.lit(stride)) + 1).cast("int")
    return (
        documents.where(F.length("text") > 0)
        .select(id_column, F.posexplode(F.slice(every, F.lit(1), count)).alias("chunk", "_text"))
        .select(id_column, "chunk", tx.strip(F.col("_text")).alias("chunk_text"))
        .where(F.col("chunk_text") != "")
    )


def corpus_passages(items: DataFrame, level: str = "paragraph") -> DataFrame:
    """Corpus rows as ``Title/Text`` paragraphs, or one row per context sentence."""
    if level == "paragraph":
        return items.select(
            "id",
            F.concat(F.lit("Title: "), tx.strip(F.col("title")), F.lit("\nText: "), tx.strip(F.col("text"))).alias("text"),
        )
    rows = items.select("id", F.posexplode("context").alias("_c", "_p"))
    return rows.select("id", F.col("_c").alias("passage"), F.posexplode("_p.sents").alias("sentence", "text"))


def objective_entry(objective: Column, observations: Column, actions: Column) -> Column:
    """OBJECTIVE line plus numbered observation/action pairs, the shorter list padded with N/A."""
    missing = F.lit("N/A")
    pairs = F.arrays_zip(observations.alias("o"), actions.alias("a"))
    lines = F.transform(
        pairs,
        lambda p, i: F.concat(
            F.lit("\nOBSERVATION_"), (i + 1).cast("string"), F.lit(": "), F.coalesce(p["o"], missing),
            F.lit("\nACTION_"), (i + 1).cast("string"), F.lit(": "), F.coalesce(p["a"], missing),
        ),
    )
    return F.concat(F.lit("OBJECTIVE: "), objective, F.array_join(lines, ""))


def context_window(text: Column, action: Column, around: int = CONTEXT_LINES) -> Column:
    """Lines around the first one holding the acted-on ``[id]`` (or the bare id), '' if none."""
    element = F.nullif(F.regexp_extract(action, r"\[(\d+)\]", 1), F.lit(""))
    lines = F.split(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"\n\z", ""), "\n")

    def first(test) -> Column:
        return F.nullif(F.array_position(F.transform(lines, test), True), F.lit(0))

    marked = F.concat(F.lit("["), element, F.lit("]"))
    bare = F.concat(F.lit(r"\b"), element, F.lit(r"\b"))
    at = F.coalesce(
        first(lambda line: F.contains(line, marked)),
        F.when(F.contains(text, element), first(lambda line: F.regexp_like(line, bare))),
    )
    start = F.greatest(F.lit(1), at - around)
    window = F.slice(lines, start, at + around - start + 1)
    return F.coalesce(F.array_join(window, "\n"), F.lit(""))


# --- vectors ----------------------------------------------------------------------------------


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


Embedder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def embed_texts(
    rows: DataFrame,
    text: str,
    *,
    model: str = "hash-32",
    cache: DataFrame | None = None,
    embedder: Embedder | None = None,
    refresh: bool = False,
    dim: int = 32,
) -> tuple[DataFrame, DataFrame]:
    """Vectors for a text column: (rows with ``embedding``, newly computed cache rows).

    Equal texts are computed once; texts in ``cache`` are not computed again unless ``refresh``.
    ``embedder`` maps batches of (text_hash, text) to (text_hash, embedding); the default is the
    hash vector, which stays in the JVM. Whole texts are keyed and handed over: an embedder with an input limit cuts
    them itself.
    """
    keyed = rows.withColumn("_hash", text_key(F.col(text)))
    wanted = keyed.where(F.col(text).isNotNull()).groupBy(F.col("_hash").alias("text_hash")).agg(
        F.first(F.col(text)).alias("text")
    )
    known = None if cache is None else cache.where(F.col("model") == model)
    if known is not None and not refresh:
        wanted = wanted.join(known.select("text_hash"), "text_hash", "left_anti")
    if embedder is None:
        fresh = wanted.select("text_hash", hash_embedding(F.col("text"), dim).alias("embedding"))
    else:
        fresh = wanted.mapInPandas(embedder, "text_hash string, embedding array<float>")
    fresh = fresh.select("text_hash", F.lit(model).alias("model"), "embedding", norm(F.col("embedding")).alias("norm"))
    vectors = fresh if known is None or refresh else fresh.unionByName(known)
    joined = keyed.join(
        vectors.select(F.col("text_hash").alias("_hash"), "embedding", "norm"), "_hash", "left"
    ).drop("_hash")
    return joined, fresh
