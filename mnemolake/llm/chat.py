"""Chat formatting of reply trees.

Messages name their parent. Pointers to ancestors are doubled by joining the table of pointers with itself, so a
tree of depth d takes log2(d) joins; each step adds up scores, so every leaf ends with the score of its whole
branch. Branches of a tree are ranked, and only the chosen ones are opened into paths, again by doubling. Each path
is one conversation: a formatted text and the spans of the assistant's words. Column expressions throughout.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside texts and roles every ``<``, any number of ``\\``
and ``|`` gets one ``\\`` more before the bar, so no control string can appear there and the change can be undone;
in roles ``\\`` and line feeds are written ``\\s`` and ``\\n`` first.

Defined results: a missing text or role is an empty one; messages without tree id form one tree; a parent that does
not exist makes its child a root; replies in a circle hang on no root and make no path; a repeated message id stays
once, the first in order of parent, role and text; a branch without scores scores 0; equal branches rank by leaf;
an empty table gives none. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import let, saved

# Fixed values of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def branches(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointer tables by level (tree, node, up: 2^level steps), and every leaf with depth and branch score.

    ``messages``: (tree, node, parent, score), nodes unique and not null, trees not null.
    """
    known = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = saved(
        messages.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("bigint").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total")),
        "pointers0",
    )
    size = state.count()
    leaves = state.join(state.select("tree", F.col("up").alias("node")).where("node is not null").distinct(), ["tree", "node"], "left_anti").select("tree", "node")
    levels: list[DataFrame] = []
    # a path has as many steps as there are messages at most: what still points on then runs in a circle
    while not state.where("up is not null").isEmpty() and 1 << len(levels) <= size:
        levels.append(state.where("up is not null").select("tree", "node", "up"))
        far = state.select("tree", F.col("node").alias("up"), F.col("up").alias("further"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        # messages that have reached their root take no further part
        stepped = state.where("up is not null").join(far, ["tree", "up"], "left")
        state = saved(
            state.where("up is null").unionByName(stepped.select("tree", "node", F.col("further").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"))),
            f"pointers{len(levels)}",
        )
    return levels, state.where("up is null").join(leaves, ["tree", "node"])


def paths(messages: DataFrame, *, keep: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, node) for each message of each chosen branch; ``keep`` best branches of a tree, or all."""
    levels, leaves = branches(messages)
    if keep == 1:  # combined where rows are read: no tree is gathered
        best = leaves.groupBy("tree").agg(F.min(F.struct((-F.col("total")).alias("low"), "node")).alias("best"))
        chosen = best.select("tree", F.col("best.node").alias("leaf"), F.lit(1).alias("rank"))
    else:
        ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node")))
        chosen = ranked.where(F.lit(True) if keep is None else F.col("rank") <= keep).select("tree", F.col("node").alias("leaf"), "rank")
    found = chosen.withColumn("node", F.col("leaf")).withColumn("back", F.lit(0).cast("bigint"))
    for k in reversed(range(len(levels))):
        more = found.join(levels[k], ["tree", "node"]).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        found = found.unionByName(more)
        if k % 3 == 0 and k:
            found = saved(found, f"paths{k}")
    return found


def formatted(messages: DataFrame, *, keep: int | None = 1) -> DataFrame:
    """(tree_id, rank, leaf_id, text, mask) from messages (tree_id, message_id, parent_id, role, text, score).

    ``mask``: (start, length) in code points of each assistant text inside ``text``, in order.
    """
    tree = F.when(messages["tree_id"].isNull(), F.lit("none")).otherwise(F.concat(F.lit("="), messages["tree_id"].cast("string")))
    named = messages.select(
        tree.alias("tree"), messages["tree_id"].alias("tree_id"), messages["message_id"].alias("node"), messages["parent_id"].alias("parent"),
        F.coalesce(messages["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(messages["text"].cast("string"), F.lit("")).alias("text"), messages["score"].cast("double").alias("score"),
    )
    one = named.where("node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score", "tree_id")).alias("m"))
    told = saved(one.select("tree", "node", "m.*"), "messages")
    turns = paths(told.select("tree", "node", "parent", "score"), keep=keep).join(told.select("tree", "node", "role", "text", "tree_id"), ["tree", "node"])
    gathered = turns.groupBy("tree", "leaf", "rank").agg(
        F.first("tree_id").alias("tree_id"),
        # a conversation is one text by contract, so its turns meet here and nowhere before
        F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "role", "text"))).alias("turns"),
    )
    pieces = F.transform("turns", lambda t: F.struct((t["role"] == ASSISTANT).alias("own"), F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")))
    sizes = lambda p: F.transform(p, lambda t: F.struct(t["own"].alias("own"), F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        span = F.array(F.struct((a["at"] + t["head"]).alias("start"), t["body"].cast("bigint").alias("length")))
        return F.struct((a["at"] + t["head"] + t["body"] + len(CLOSE) + 1).alias("at"), F.concat(a["spans"], F.when(t["own"], span).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>"))).alias("spans"))

    made = gathered.select(
        "tree_id", "rank", F.col("leaf").alias("leaf_id"),
        let(pieces, lambda p: F.struct(F.concat_ws("", F.transform(p, lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE + "\n")))).alias("text"), F.aggregate(sizes(p), start, step, lambda a: a["spans"]).alias("mask"))).alias("made"),
    )
    return made.select("tree_id", "rank", "leaf_id", "made.text", "made.mask")


def parsed(conversations: DataFrame) -> DataFrame:
    """Formatted conversations with ``turns`` (role, text) and ``loss`` (texts under the mask), both as before formatting."""
    body = F.filter(F.split("text", r"<\|im_end\|>\n", -1), lambda x: x != "")
    cut = lambda x: let(F.substring(x, F.lit(len(OPEN) + 1), F.length(x)), lambda y: let(F.instr(y, "\n"), lambda i: F.struct(unescape_role(F.substring(y, F.lit(1), i - 1)).alias("role"), unescape(F.substring(y, i + 1, F.length(y))).alias("text"))))
    loss = F.transform("mask", lambda m: unescape(F.substring(F.col("text"), (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return conversations.withColumn("turns", F.transform(body, cut)).withColumn("loss", loss)
