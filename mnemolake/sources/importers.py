"""Importers for exported graphs: one JSON document, a directory per type, or numbered files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.functions.vector import hash_embedding
from mnemolake.operators.ordered import number_rows
from mnemolake.schema import DEFAULT_CREDIBILITY, DEFAULT_IMPORTANCE

ANY_FLOATS = "array<float>"
EPISODIC_ITEM = (
    "episodic_id bigint, observation string, episodic_memory string, action string, time string, "
    "session_id string, subgoal string, state string, reward string"
)
SEMANTIC_ITEM = (
    f"semantic_id bigint, semantic_memory string, semantic_embedding {ANY_FLOATS}, tags array<string>, tag_ids array<bigint>, "
    "time bigint, is_active boolean, episodic_ids array<bigint>, episodic_id bigint, episodic_nodes array<bigint>, "
    "bro_semantic_ids array<bigint>, son_semantic_ids array<bigint>, session_id string, date string"
)
TAG_ITEM = (
    f"tag_id bigint, tag string, tag_embedding {ANY_FLOATS}, semantic_ids array<bigint>, semantic_nodes array<bigint>, "
    "time bigint, importance int"
)
SUBGOAL_ITEM = f"subgoal_id bigint, subgoal string, subgoal_embedding {ANY_FLOATS}, procedural_ids array<bigint>, time bigint"
PROCEDURAL_ITEM = (
    f"procedural_id bigint, procedural_memory string, procedural_embedding {ANY_FLOATS}, subgoal_embedding {ANY_FLOATS}, "
    "subgoal string, subgoal_id bigint, episodic_ids array<bigint>, episodic_id bigint, time bigint, `return` double"
)
ITEMS = {
    "episodic": EPISODIC_ITEM, "semantic": SEMANTIC_ITEM, "tag": TAG_ITEM, "subgoal": SUBGOAL_ITEM, "procedural": PROCEDURAL_ITEM,
}
FOLDERS = {
    "episodic": "episodic_memory", "semantic": "semantic_memory", "tag": "tag", "subgoal": "subgoal", "procedural": "procedural_memory",
}
_NO_IDS = "array<bigint>"


def _vector(stored: Column, text: Column, dim: int) -> Column:
    """Stored vector, or one computed from non-empty text."""
    return F.coalesce(stored, F.when(F.coalesce(text, F.lit("")) != "", hash_embedding(text, dim)))


def _ids(*columns: str) -> Column:
    return F.coalesce(*columns, F.array().cast(_NO_IDS))


def _text(*columns: str) -> Column:
    return F.coalesce(*columns, F.lit(""))


def shape_items(rows: DataFrame, kind: str, node_id: Column, dim: int) -> DataFrame:
    """Raw items of one kind as node columns, id lists kept for edge building."""
    zero = F.lit(0).cast("bigint")
    if kind == "episodic":
        return rows.select(
            "graph_id", node_id.alias("episodic_id"), _text("observation", "episodic_memory").alias("observation"), _text("action").alias("action"),
            _text("time").alias("time"), "session_id", _text("subgoal").alias("subgoal"), _text("state").alias("state"), _text("reward").alias("reward"),
        )
    if kind == "semantic":
        text = _text("semantic_memory")
        single = F.when(F.col("episodic_id").isNotNull(), F.array("episodic_id"))
        return rows.withColumn("_single", single).select(
            "graph_id", node_id.alias("semantic_id"), text.alias("text"), _vector(F.col("semantic_embedding"), text, dim).alias("embedding"),
            F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), _ids("tag_ids").alias("tag_ids"), F.coalesce("time", zero).alias("time"),
            F.coalesce("is_active", F.lit(True)).alias("is_active"), F.lit(DEFAULT_CREDIBILITY).alias("credibility"), _text("date").alias("date"), "session_id",
            _ids("episodic_ids", "episodic_nodes", "_single").alias("episodic_ids"), _ids("bro_semantic_ids").alias("sibling_ids"), _ids("son_semantic_ids").alias("source_ids"),
        )
    if kind == "tag":
        return rows.select(
            "graph_id", node_id.alias("tag_id"), _text("tag").alias("tag"), _vector(F.col("tag_embedding"), F.col("tag"), dim).alias("embedding"),
            F.coalesce("time", zero).alias("time"), F.coalesce("importance", F.lit(DEFAULT_IMPORTANCE)).alias("importance"), _ids("semantic_ids", "semantic_nodes").alias("semantic_ids"),
        )
    if kind == "subgoal":
        return rows.select(
            "graph_id", node_id.alias("subgoal_id"), _text("subgoal").alias("subgoal"), _vector(F.col("subgoal_embedding"), F.col("subgoal"), dim).alias("embedding"),
            F.coalesce("time", zero).alias("time"), F.lit(DEFAULT_IMPORTANCE).alias("importance"), _ids("procedural_ids").alias("procedural_ids"),
        )
    text = _text("procedural_memory")
    single = F.when(F.col("episodic_id").isNotNull(), F.array("episodic_id"))
    return rows.withColumn("_single", single).select(
        "graph_id", node_id.alias("procedural_id"), text.alias("text"),
        _vector(F.coalesce("procedural_embedding", "subgoal_embedding"), text, dim).alias("embedding"),
        F.coalesce("time", zero).alias("time"), F.coalesce("return", F.lit(0.0)).alias("return_value"), F.lit(None).cast("string").alias("session_id"),
        _text("subgoal").alias("subgoal"), "subgoal_id", _ids("episodic_ids", "_single").alias("episodic_ids"),
    )


def read_one_file_graph(spark: SparkSession, path: str, graph_id: str, dim: int = 32) -> dict[str, DataFrame]:
    """One JSON document with five node arrays; a subgoal's id is its place in the array."""
    ddl = ", ".join(f"{kind}_nodes array<struct<{_struct(item)}>>" for kind, item in ITEMS.items())
    document = spark.read.schema(ddl).json(path, multiLine=True)
    out = {}
    for kind in ITEMS:
        rows = document.select(F.lit(graph_id).alias("graph_id"), F.posexplode(f"{kind}_nodes").alias("_pos", "_n")).select("graph_id", "_pos", "_n.*")
        stated = F.col(f"{kind}_id")
        if kind == "subgoal":
            stated = F.col("_pos").cast("bigint")
        elif kind == "procedural":
            stated = F.coalesce(stated, F.lit(0).cast("bigint"))
        out[kind] = shape_items(rows, kind, stated, dim)
    return out


def _struct(item: str) -> str:
    return ", ".join(f"{part.split(' ', 1)[0]}: {part.split(' ', 1)[1]}" for part in item.split(", "))


def _read_items(spark: SparkSession, path: str, kind: str, graph_id: str) -> DataFrame:
    number = F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)\.json$", 1).cast("bigint")
    return spark.read.schema(ITEMS[kind]).json(f"{path}/{FOLDERS[kind]}/*.json", multiLine=True).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.coalesce(number, F.lit(0)).alias("_number"), F.lit(graph_id).alias("graph_id")
    )


def read_directory_graph(spark: SparkSession, path: str, graph_id: str, dim: int = 32, kinds: tuple[str, ...] = tuple(ITEMS)) -> dict[str, DataFrame]:
    """One folder per node type; a missing id is the file's position in name order."""
    out = {}
    for kind in kinds:
        rows = _read_items(spark, path, kind, graph_id)
        # name order, kept apart from the number in the name
        rows = rows.withColumn("_bucket", F.ascii(F.regexp_extract("_file", r"_([^_]*)\.json$", 1)))
        rows = number_rows(rows, ["graph_id"], ["_bucket", "_file"], "_pos", span=1)
        out[kind] = shape_items(rows, kind, F.coalesce(F.col(f"{kind}_id"), F.col("_pos")), dim)
    return out


def read_numbered_graph(
    spark: SparkSession, path: str, graph_id: str, dim: int = 32, keep_gaps: bool = False, kinds: tuple[str, ...] = ("episodic", "semantic", "subgoal", "procedural")
) -> dict[str, DataFrame]:
    """Numbered files: ids are positions in number order, or the numbers themselves (``keep_gaps``).

    With ``keep_gaps`` a fact without a time takes its id as time.
    """
    out = {}
    for kind in kinds:
        rows = number_rows(_read_items(spark, path, kind, graph_id), ["graph_id"], ["_number"], "_pos")
        node_id = F.col("_number") if keep_gaps else F.col("_pos")
        if keep_gaps and kind == "semantic":
            rows = rows.withColumn("time", F.coalesce("time", "_number"))
        out[kind] = shape_items(rows, kind, node_id, dim)
    return out


def rebuild_edges(nodes: dict[str, DataFrame]) -> DataFrame:
    """All edges of an imported graph from its id lists; ids without a node are dropped.

    Tag and subgoal lists may be kept on either end; the union of both directions counts.
    """
    from mnemolake.operators.build import edge, edges_from_lists, repair_edges

    parts = []
    semantic, episodic = nodes.get("semantic"), nodes.get("episodic")
    procedural, tag, subgoal = nodes.get("procedural"), nodes.get("tag"), nodes.get("subgoal")
    if semantic is not None:
        if episodic is not None:
            parts.append(edges_from_lists(semantic, "semantic", "semantic_id", F.col("episodic_ids"), "evidenced_by", "episodic", episodic, "episodic_id"))
        for column, kind in (("sibling_ids", "related"), ("source_ids", "derived_from")):
            targets = semantic.select("graph_id", F.col("semantic_id").alias("_other"))
            parts.append(edges_from_lists(semantic, "semantic", "semantic_id", F.col(column), kind, "semantic", targets, "_other"))
        if tag is not None:
            forward = edges_from_lists(semantic, "semantic", "semantic_id", F.col("tag_ids"), "tagged", "tag", tag, "tag_id")
            back = edges_from_lists(tag, "tag", "tag_id", F.col("semantic_ids"), "tagged", "semantic", semantic, "semantic_id")
            parts.append(repair_edges(forward, back))
    if procedural is not None:
        if episodic is not None:
            parts.append(edges_from_lists(procedural, "procedural", "procedural_id", F.col("episodic_ids"), "from_session", "episodic", episodic, "episodic_id"))
        if subgoal is not None:
            stated = procedural.where(F.col("subgoal_id").isNotNull()).join(subgoal.select("graph_id", "subgoal_id"), ["graph_id", "subgoal_id"], "left_semi")
            forward = stated.select(*edge("procedural", "procedural_id", "grouped_by", "subgoal", "subgoal_id"))
            back = edges_from_lists(subgoal, "subgoal", "subgoal_id", F.col("procedural_ids"), "grouped_by", "procedural", procedural, "procedural_id")
            parts.append(repair_edges(forward, back))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()
