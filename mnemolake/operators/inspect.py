"""Looking into graphs: search, pages, node detail, degrees, sessions, timelines, graph export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions import text as tx
from mnemolake.operators.ordered import number_rows
from mnemolake.schema import DEFAULT_CREDIBILITY, ID_COLUMN, NODE_TABLES

# Label lengths, export limit, order in which types get spare room.
NODE_LABEL = 60
SHORT_NODE_LABEL = 40
EVENT_LABEL = 100
NODE_LIMIT = 500
TYPE_PRIORITY = ("semantic", "procedural", "tag", "subgoal", "episodic")
EMPTY_STEP = "(empty)"


def node_text(node_type: str) -> Column:
    """Searchable text of a node."""
    if node_type == "episodic":
        return F.concat_ws("\n", F.coalesce("observation", F.lit("")), F.coalesce("action", F.lit("")))
    column = {"semantic": "text", "procedural": "text", "tag": "tag", "subgoal": "subgoal"}[node_type]
    return F.coalesce(F.col(column), F.lit(""))


def _checked(node_type: str) -> str:
    if node_type not in NODE_TABLES:
        raise ValueError(f"unknown node type: {node_type}")
    return ID_COLUMN[node_type]


def browse(nodes: DataFrame, node_type: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of each graph's nodes in insertion order, with their ``place`` and the graph's ``total``."""
    placed = number_rows(nodes, ["graph_id"], [_checked(node_type)], "place")
    totals = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("total"))
    return placed.where((F.col("place") >= offset) & (F.col("place") < offset + limit)).join(totals, "graph_id")


def search(nodes: DataFrame, node_type: str, needle: str, limit: int = 50, only_active: bool = False) -> DataFrame:
    """Nodes holding the needle, newest first per graph, with the total before the limit."""
    node_id = _checked(node_type)
    wanted = tx.fold_case(tx.strip(F.lit(needle)))
    hits = nodes.where(F.contains(tx.fold_case(node_text(node_type)), wanted))
    if only_active and node_type == "semantic":
        hits = hits.where("is_active")
    newest = Window.partitionBy("graph_id").orderBy(F.desc("_time"), node_id)
    page = hits.withColumn("_time", tx.safe_time(F.col("time"))).withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= max(0, limit))
    totals = hits.groupBy("graph_id").agg(F.count(F.lit(1)).alias("total"))
    return page.join(totals, "graph_id").drop("_time")


def node_detail(nodes: DataFrame, node_type: str, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted nodes, one row per one-hop neighbour (kind, direction, type, id); one without any if there is none.

    A hub's neighbours stay rows. ``edges`` must have its group links opened for the wanted nodes (see ``build.expand_links``).
    """
    node_id = _checked(node_type)
    key = ["graph_id", node_id]
    asked = wanted.select(*key).distinct()
    out = edges.where(F.col("src_type") == node_type).join(asked.withColumnRenamed(node_id, "src_id"), ["graph_id", "src_id"], "left_semi").select(
        "graph_id", F.col("src_id").alias(node_id), "kind", F.lit("out").alias("direction"), F.col("dst_type").alias("type"), F.col("dst_id").alias("id")
    )
    back = edges.where(F.col("dst_type") == node_type).join(asked.withColumnRenamed(node_id, "dst_id"), ["graph_id", "dst_id"], "left_semi").select(
        "graph_id", F.col("dst_id").alias(node_id), "kind", F.lit("in").alias("direction"), F.col("src_type").alias("type"), F.col("src_id").alias("id")
    )
    return nodes.join(asked, key, "left_semi").join(out.unionByName(back), key, "left")


def degrees(nodes: DataFrame, node_type: str, edges: DataFrame, insert_episodes: DataFrame | None = None) -> DataFrame:
    """Node projections with their degrees; a subgoal is activated once it has a procedure.

    Group links count as their members: siblings by the fact's ``insert_id``, whole-insert evidence by
    ``insert_episodes(graph_id, insert_id, n)``.
    """
    node_id = _checked(node_type)
    key = ["graph_id", node_id]
    side, names = {
        "semantic": ("src", {"tagged": "n_tags", "evidenced_by": "n_episodics", "related": "n_siblings"}),
        "tag": ("dst", {"tagged": "n_semantics"}),
        "subgoal": ("dst", {"grouped_by": "n_procedurals"}),
        "procedural": ("src", {"from_session": "n_episodics"}),
        "episodic": ("dst", {"evidenced_by": "n_semantics"}),
    }[node_type]
    mine = edges.where((F.col(f"{side}_type") == node_type) & F.col("kind").isin(*names))
    single = mine.where(F.col("dst_type") != "insert").select(
        "graph_id", F.col(f"{side}_id").alias(node_id), "kind", F.lit(1).cast("bigint").alias("_n")
    )
    if node_type == "semantic" and insert_episodes is not None:
        whole = mine.where((F.col("dst_type") == "insert") & (F.col("kind") == "evidenced_by"))
        sizes = insert_episodes.select("graph_id", F.col("insert_id").alias("dst_id"), F.col("n").cast("bigint").alias("_n"))
        single = single.unionByName(
            whole.join(sizes, ["graph_id", "dst_id"]).select("graph_id", F.col("src_id").alias(node_id), "kind", "_n")
        )
    counts = single.groupBy(*key).agg(
        *[F.sum(F.when(F.col("kind") == kind, F.col("_n")).otherwise(0)).alias(name) for kind, name in names.items()]
    )
    rows = nodes.join(counts, key, "left")
    for name in names.values():
        rows = rows.withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    if node_type == "semantic" and "insert_id" in nodes.columns:
        groups = nodes.where(F.col("insert_id").isNotNull()).groupBy("graph_id", "insert_id").agg((F.count(F.lit(1)) - 1).alias("_sib"))
        rows = rows.join(groups, ["graph_id", "insert_id"], "left").withColumn(
            "n_siblings", F.col("n_siblings") + F.coalesce("_sib", F.lit(0))
        ).drop("_sib")
    return rows.withColumn("activated", F.col("n_procedurals") > 0) if node_type == "subgoal" else rows


def set_active(facts: DataFrame, patch: DataFrame) -> DataFrame:
    """Activate or deactivate facts: ``patch(graph_id, semantic_id, is_active)``; an empty value is refused."""
    given = F.assert_true(F.col("is_active").isNotNull(), F.lit("nothing to change"))
    change = patch.where(given.isNull()).withColumnRenamed("is_active", "_active")
    return (
        facts.join(change, ["graph_id", "semantic_id"], "left")
        .withColumn("is_active", F.coalesce("_active", "is_active"))
        .drop("_active")
    )


def recent_recalls(audit: DataFrame, session_id: str | None = None, limit: int = 50) -> DataFrame:
    """Newest recalls per graph, of one session if named."""
    rows = audit if session_id is None else audit.where(F.col("session_id") == session_id)
    newest = Window.partitionBy("graph_id").orderBy(F.desc("recall_id"))
    return rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= max(0, limit))


def graph_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Node counts per graph, one column per type."""
    rows = None
    for name in NODE_TABLES:
        if name in tables:
            counts = tables[name].groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).withColumn("node_type", F.lit(name))
            rows = counts if rows is None else rows.unionByName(counts)
    return rows.groupBy("graph_id").pivot("node_type", list(NODE_TABLES)).agg(F.sum("n")).na.fill(0, list(NODE_TABLES))


def sessions(tables: dict[str, DataFrame]) -> DataFrame:
    """Distinct non-empty session ids per graph over nodes and recalls."""
    rows = None
    for name in ("episodic", "semantic", "procedural", "recall_audit"):
        if name in tables:
            ids = tables[name].where(F.coalesce("session_id", F.lit("")) != "").select("graph_id", "session_id").distinct()
            rows = ids if rows is None else rows.unionByName(ids)
    return rows.distinct()


def session_timeline(tables: dict[str, DataFrame], wanted: DataFrame | None = None) -> DataFrame:
    """Inserts and recalls of sessions as one event stream.

    Order within a session: ``time``, then inserts before recalls, then ``node_id``; sort on
    (session_id, time, kind, node_id). ``wanted(graph_id, session_id)`` limits the sessions.
    """
    label = lambda c: tx.short_label(c, EVENT_LABEL)
    blank = F.lit("")

    def rows(name: str, *columns: Column) -> DataFrame:
        df = tables[name].where(F.col("session_id").isNotNull())
        if wanted is not None:
            df = df.join(wanted, ["graph_id", "session_id"], "left_semi")
        return df.select("graph_id", "session_id", *columns)

    parts = []
    if "episodic" in tables:
        said = F.coalesce(F.nullif(F.col("observation"), blank), F.nullif(F.col("action"), blank), F.lit(EMPTY_STEP))
        text = F.concat_ws("\n", F.nullif(F.col("observation"), blank), F.nullif(F.col("action"), blank))
        parts.append(rows(
            "episodic", F.lit("insert").alias("kind"), F.lit("episodic").alias("node_type"), F.col("episodic_id").alias("node_id"),
            tx.safe_time(F.col("time")).alias("time"), label(said).alias("label"), text.alias("text"), F.nullif(F.col("subgoal"), blank).alias("subgoal"),
        ))
    if "semantic" in tables:
        parts.append(rows(
            "semantic", F.lit("insert").alias("kind"), F.lit("semantic").alias("node_type"), F.col("semantic_id").alias("node_id"),
            tx.safe_time(F.col("time")).alias("time"), label(F.col("text")).alias("label"), "text", "is_active",
            F.coalesce("credibility", F.lit(DEFAULT_CREDIBILITY)).alias("credibility"),
        ))
    if "procedural" in tables:
        parts.append(rows(
            "procedural", F.lit("insert").alias("kind"), F.lit("procedural").alias("node_type"), F.col("procedural_id").alias("node_id"),
            tx.safe_time(F.col("time")).alias("time"), label(F.col("text")).alias("label"), "text", "return_value",
        ))
    if "recall_audit" in tables:
        keep = [c for c in ("endpoint", "ts", "observation", "mode", "next_subgoal", "query_tags", "selected_semantic_ids", "selected_procedural_ids", "n_messages") if c in tables["recall_audit"].columns]
        parts.append(rows(
            "recall_audit", F.lit("recall").alias("kind"), F.col("recall_id").alias("node_id"), tx.safe_time(F.col("graph_time")).alias("time"), *[F.col(c) for c in keep],
        ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def timeline_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("graph_id", "session_id", "kind", "node_type").agg(F.count(F.lit(1)).alias("n"))


def newest_first(nodes: DataFrame, node_type: str, keep: int) -> DataFrame:
    """The ``keep`` newest nodes of each graph, ranked."""
    order = Window.partitionBy("graph_id").orderBy(F.desc(tx.safe_time(F.col("time"))), _checked(node_type))
    return nodes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def node_quotas(sizes: DataFrame, limit: int) -> DataFrame:
    """How many nodes of each type a graph may show: ``sizes(graph_id, node_type, size)``.

    Within the limit everything shows. Otherwise types share it equally and spare room goes to types
    in priority order.
    """
    place = F.array_position(F.array(*[F.lit(t) for t in TYPE_PRIORITY]), F.col("node_type"))
    graph = Window.partitionBy("graph_id")
    earlier = graph.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        sizes.where("size > 0")
        .withColumn("_place", place)
        .withColumn("_total", F.sum("size").over(graph))
        .withColumn("_share", F.floor(F.lit(limit) / F.count(F.lit(1)).over(graph)))
        .withColumn("_base", F.least("_share", "size"))
        .withColumn("_spare", F.lit(limit) - F.sum("_base").over(graph))
        .withColumn("_want", F.col("size") - F.col("_base"))
        .withColumn("_before", F.coalesce(F.sum("_want").over(earlier), F.lit(0)))
    )
    extra = F.greatest(F.lit(0), F.least(F.col("_want"), F.col("_spare") - F.col("_before")))
    quota = F.when(F.col("_total") <= limit, F.col("size")).otherwise(F.col("_base") + extra)
    return rows.select("graph_id", "node_type", "size", quota.cast("bigint").alias("quota"), (F.col("_total") > limit).alias("truncated"))


def _node_label(node_type: str) -> Column:
    blank = F.lit("")
    if node_type == "tag":
        return F.col("tag")
    if node_type == "subgoal":
        return tx.short_label(F.col("subgoal"), SHORT_NODE_LABEL)
    if node_type == "episodic":
        said = F.coalesce(F.nullif(F.col("observation"), blank), F.nullif(F.col("action"), blank), F.lit(EMPTY_STEP))
        return tx.short_label(said, SHORT_NODE_LABEL)
    return tx.short_label(F.col("text"), NODE_LABEL)


def topology(
    tables: dict[str, DataFrame],
    edges: DataFrame,
    *,
    limit: int = NODE_LIMIT,
    include_episodic: bool = False,
    include_inactive: bool = True,
    min_importance: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each graph within a node budget: (nodes, edges between shown nodes).

    Newest nodes first within a type. Siblings are joined among shown nodes only and appear once, lower id first.
    """
    shown = None
    sizes = None
    for name in TYPE_PRIORITY:
        if name not in tables or (name == "episodic" and not include_episodic):
            continue
        pool = tables[name]
        if name == "tag":
            pool = pool.where(F.col("importance") >= min_importance)
        if name == "semantic" and not include_inactive:
            pool = pool.where("is_active")
        size = pool.groupBy("graph_id").agg(F.count(F.lit(1)).alias("size")).withColumn("node_type", F.lit(name))
        sizes = size if sizes is None else sizes.unionByName(size)
        label = _node_label(name)
        group = F.col("insert_id") if name == "semantic" and "insert_id" in pool.columns else F.lit(None).cast("bigint")
        part = newest_first(pool.select("graph_id", F.col(ID_COLUMN[name]), "time", label.alias("label"), group.alias("insert_id")), name, limit).select(
            "graph_id", F.lit(name).alias("node_type"), F.col(ID_COLUMN[name]).alias("node_id"), "label", tx.safe_time(F.col("time")).alias("time"), "insert_id", "rank"
        )
        shown = part if shown is None else shown.unionByName(part)
    quotas = node_quotas(sizes, limit)
    nodes = shown.join(quotas, ["graph_id", "node_type"]).where(F.col("rank") <= F.col("quota"))
    nodes = nodes.withColumn("uid", tx.node_uid(F.col("node_type"), F.col("node_id")))
    ends = nodes.select("graph_id", "node_type", "node_id")
    links = (
        edges.where(F.col("dst_type") != "insert")
        .join(ends.withColumnsRenamed({"node_type": "src_type", "node_id": "src_id"}), ["graph_id", "src_type", "src_id"], "left_semi")
        .join(ends.withColumnsRenamed({"node_type": "dst_type", "node_id": "dst_id"}), ["graph_id", "dst_type", "dst_id"], "left_semi")
        .select("graph_id", "src_type", "src_id", "kind", "dst_type", "dst_id")
    )
    # siblings among the shown facts: at most the node limit per graph
    facts = nodes.where((F.col("node_type") == "semantic") & F.col("insert_id").isNotNull()).select("graph_id", "insert_id", "node_id")
    pairs = facts.join(facts.withColumnRenamed("node_id", "_other"), ["graph_id", "insert_id"]).where(F.col("node_id") < F.col("_other"))
    siblings = pairs.select(
        "graph_id", F.lit("semantic").alias("src_type"), F.col("node_id").alias("src_id"), F.lit("related").alias("kind"),
        F.lit("semantic").alias("dst_type"), F.col("_other").alias("dst_id"),
    )
    related = F.col("kind") == "related"
    low, high = F.least("src_id", "dst_id"), F.greatest("src_id", "dst_id")
    links = (
        links.unionByName(siblings)
        .withColumn("_low", F.when(related, low).otherwise(F.col("src_id"))).withColumn("_high", F.when(related, high).otherwise(F.col("dst_id")))
        .select("graph_id", "src_type", F.col("_low").alias("src_id"), "kind", "dst_type", F.col("_high").alias("dst_id"))
        .distinct()
    )
    source, target = tx.node_uid(F.col("src_type"), F.col("src_id")), tx.node_uid(F.col("dst_type"), F.col("dst_id"))
    links = links.withColumn("source", source).withColumn("target", target).withColumn("uid", tx.edge_uid(source, F.col("kind"), target))
    return nodes.drop("rank", "size", "quota", "insert_id"), links
