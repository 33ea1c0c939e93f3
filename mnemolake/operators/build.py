"""Graph construction: ids, links, tags, subgoals and edges for batches of inserts.

An insert batch is three row sets keyed by (graph_id, insert_id): ``steps`` (trajectory_num, turn_num,
observation, action, …), ``facts`` (fact_pos, text, tags, trajectory_num, turn_num) and ``procedures``
(proc_pos, subgoal, text, trajectory_num, return_value). Ids are dense per graph and continue after the
stored ones. Edges are sets: a (source, kind, target) triple is stored once.

Two links of the model are group-valued: a fact whose step is unknown is evidenced by *every* episode
of its insert, and all facts of one insert are siblings. They are stored as one edge to the insert
(``dst_type = 'insert'``) and opened with ``expand_links`` for the sources being read, so an insert of
any size never turns into all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import value as vf
from mnemolake.functions.vector import hash_embedding
from mnemolake.operators.ordered import number_rows
from mnemolake.operators.similarity import nearest
from mnemolake.schema import DEFAULT_CREDIBILITY, DEFAULT_IMPORTANCE
from mnemolake.session import checkpointed


def next_ids(nodes: DataFrame, id_column: str, clock: str | None = None) -> DataFrame:
    """First free id per graph, and with ``clock`` the tick after the last."""
    tick = [] if clock is None else [(F.max(clock) + 1).alias("_tick")]
    return nodes.groupBy("graph_id").agg((F.max(id_column) + 1).alias("_first"), *tick)


def assign_ids(rows: DataFrame, order: list[str], id_column: str, first: DataFrame | None = None, clock: str | None = None) -> DataFrame:
    """Dense ids per graph along ``order`` (leading column a non-negative integer).

    With ``clock``, rows take the ticks after their graph's last one too, in order of their new ids. ``first`` (``next_ids``) meets
    the rows while they are numbered: rows are not dealt out by graph for it.
    """
    numbered = number_rows(rows, ["graph_id"], order, id_column, known=first)
    after = lambda column: F.lit(0) if first is None else F.coalesce(F.col(column), F.lit(0))
    if clock is not None:
        numbered = numbered.withColumn(clock, after("_tick") + F.col(id_column))
    return numbered.withColumn(id_column, F.col(id_column) + after("_first")).drop("_first", "_tick")


def without_blank(rows: DataFrame, text: str = "text") -> DataFrame:
    """Empty memories get no id."""
    return rows.where(F.length(text) > 0)


def edge(src_type: str, src_id: str, kind: str, dst_type: str, dst_id: str) -> list[Column]:
    return [
        F.col("graph_id"),
        F.lit(src_type).alias("src_type"),
        F.col(src_id).cast("bigint").alias("src_id"),
        F.lit(kind).alias("kind"),
        F.lit(dst_type).alias("dst_type"),
        F.col(dst_id).cast("bigint").alias("dst_id"),
    ]


def fact_tag_rows(facts: DataFrame) -> DataFrame:
    """One row per (fact, tag id) of the stored id lists."""
    return facts.select("graph_id", "semantic_id", F.explode(F.array_distinct("tag_ids")).alias("tag_id"))


def evidence_links(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Fact to the episode of its (trajectory, turn); to the whole insert when there is none.

    Missing numbers count as 0. An insert without episodes gives no link.
    """
    at = ["graph_id", "insert_id", "trajectory_num", "turn_num"]
    zero = F.lit(0)
    wanted = facts.select(
        "graph_id", "insert_id", "semantic_id",
        F.coalesce("trajectory_num", zero).cast("bigint").alias("trajectory_num"),
        F.coalesce("turn_num", zero).cast("bigint").alias("turn_num"),
    )
    steps = episodes.select(
        "graph_id", "insert_id", F.col("trajectory_num").cast("bigint").alias("trajectory_num"),
        F.col("turn_num").cast("bigint").alias("turn_num"), "episodic_id",
    )
    matched = wanted.join(steps, at, "left")
    exact = matched.where(F.col("episodic_id").isNotNull()).select(*edge("semantic", "semantic_id", "evidenced_by", "episodic", "episodic_id"))
    whole = (
        matched.where(F.col("episodic_id").isNull())
        .join(steps.select("graph_id", "insert_id").distinct(), ["graph_id", "insert_id"], "left_semi")
        .select(*edge("semantic", "semantic_id", "evidenced_by", "insert", "insert_id"))
    )
    return exact.unionByName(whole)


def sibling_links(facts: DataFrame) -> DataFrame:
    """Every fact to its insert: facts of one insert are siblings of each other."""
    return facts.select(*edge("semantic", "semantic_id", "related", "insert", "insert_id"))


def sibling_counts(facts: DataFrame) -> DataFrame:
    """How many siblings each fact has, without forming the pairs."""
    sizes = facts.groupBy("graph_id", "insert_id").agg((F.count(F.lit(1)) - 1).alias("n_siblings"))
    return facts.select("graph_id", "insert_id", "semantic_id").join(sizes, ["graph_id", "insert_id"])


def expand_links(edges: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Open group links of the ``wanted(graph_id, src_id)`` sources into one edge per member.

    ``members(graph_id, insert_id, dst_type, dst_id)`` lists the nodes of each insert; with a
    ``trajectory_num`` column, a procedure (``wanted`` then names its own) opens its trajectory only.
    """
    mine = edges.join(wanted.select("graph_id", "src_id"), ["graph_id", "src_id"], "left_semi")
    plain = mine.where(F.col("dst_type") != "insert")
    target = F.when(F.col("kind") == "related", "semantic").otherwise("episodic")
    group = mine.where(F.col("dst_type") == "insert").select(
        "graph_id", "src_type", "src_id", "kind", target.alias("dst_type"), F.col("dst_id").alias("insert_id")
    )
    opened = group.join(members, ["graph_id", "insert_id", "dst_type"]).where(
        (F.col("kind") != "related") | (F.col("src_id") != F.col("dst_id"))
    )
    if "trajectory_num" in members.columns and "trajectory_num" in wanted.columns:
        own = wanted.select("graph_id", "src_id", F.coalesce("trajectory_num", F.lit(0)).cast("bigint").alias("_own"))
        opened = opened.join(own, ["graph_id", "src_id"]).where(
            (F.col("kind") != "from_session") | (F.coalesce("trajectory_num", F.lit(0)) == F.col("_own"))
        )
    return plain.unionByName(opened.select(*plain.columns))


def procedure_links(procedures: DataFrame, episodes: DataFrame) -> DataFrame:
    """Procedure to its trajectory's episodes: one edge to the insert, opened by ``expand_links``.

    A procedure without trajectory number belongs to trajectory 0. Trajectories without episodes give no link.
    """
    at = ["graph_id", "insert_id", "trajectory_num"]
    number = F.coalesce("trajectory_num", F.lit(0)).cast("bigint").alias("trajectory_num")
    steps = episodes.select("graph_id", "insert_id", number).distinct()
    return (
        procedures.select("graph_id", "insert_id", number, "procedural_id").join(steps, at, "left_semi")
        .select(*edge("procedural", "procedural_id", "from_session", "insert", "insert_id"))
    )


def tag_mentions(facts: DataFrame) -> DataFrame:
    """One row per tag of a fact, with its place in the list."""
    return facts.select(
        "graph_id", "semantic_id", F.col("time").alias("time"), F.posexplode("tags").alias("tag_pos", "tag")
    )


def upsert_tags(
    facts: DataFrame, stored: DataFrame | None = None, embed: Callable[[Column], Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Exact-text tag upsert: (new tags, fact-tag edges).

    New tags get ids in order of first mention, the time of the fact that brought them and the vector ``embed``
    makes of their text (the hash vector, as wide as the facts' vectors, unless given).
    """
    mentions = tag_mentions(facts)
    first = mentions.groupBy("graph_id", "tag").agg(
        F.min(F.struct("semantic_id", "tag_pos", "time")).alias("_first")
    )
    fresh = first if stored is None else first.join(stored.select("graph_id", "tag"), ["graph_id", "tag"], "left_anti")
    fresh = fresh.select("graph_id", "tag", "_first.semantic_id", "_first.tag_pos", "_first.time")
    ids = assign_ids(fresh, ["semantic_id", "tag_pos"], "tag_id", None if stored is None else next_ids(stored, "tag_id"))
    vector = (embed or hash_embedding)(F.col("tag"))
    new = ids.select("graph_id", "tag_id", "tag", vector.alias("embedding"), "time", F.lit(DEFAULT_IMPORTANCE).alias("importance"))
    known = new.select("graph_id", "tag_id", "tag")
    if stored is not None:
        known = known.unionByName(stored.select("graph_id", "tag_id", "tag"))
    edges = (
        mentions.select("graph_id", "semantic_id", "tag").distinct()
        .join(known, ["graph_id", "tag"])
        .select(*edge("semantic", "semantic_id", "tagged", "tag", "tag_id"))
    )
    return new, edges


def match_or_create_tags(
    candidates: DataFrame, stored: DataFrame | None = None, same: float = vf.TAG_EQUAL.threshold
) -> DataFrame:
    """Similar-tag upsert: each tag joins its nearest earlier tag at ``same`` or above, else it leads.

    ``candidates(graph_id, tag_key, embedding)``: tag_key (BIGINT) is the order of arrival and lies above
    all stored ids; stored tags always lead. Returns (graph_id, tag_key, leader_key), equal for a leader.

    A tag leads when no earlier leader is close, so leaders are found in rounds over the close pairs:
    a tag with an earlier close leader follows, one whose earlier close tags all follow leads. Copies of
    a vector can never lead after the first, so only first copies enter the rounds.
    """
    new = candidates.select("graph_id", "tag_key", "embedding", F.lit(False).alias("lead"))
    pool = new
    if stored is not None:
        pool = new.unionByName(
            stored.select("graph_id", F.col("tag_id").alias("tag_key"), "embedding", F.lit(True).alias("lead"))
        )
    firsts = checkpointed(
        pool.groupBy("graph_id", "embedding").agg(F.min("tag_key").alias("tag_key"), F.max("lead").alias("lead"))
    )
    close = checkpointed(
        nearest(
            firsts.select("graph_id", F.col("tag_key").alias("earlier_key"), "embedding"), firsts, k=None,
            query_id="earlier_key", node_id="tag_key", floor=same, later_only=True,
        ).select("graph_id", "earlier_key", "tag_key")
    )
    # true leads, false follows, null undecided
    state = firsts.select("graph_id", "tag_key", F.when(F.col("lead"), True).alias("leads"))
    while True:
        before = state.select("graph_id", F.col("tag_key").alias("earlier_key"), F.col("leads").alias("_earlier"))
        view = (
            close.join(before, ["graph_id", "earlier_key"])
            .groupBy("graph_id", "tag_key")
            .agg(
                F.coalesce(F.max("_earlier"), F.lit(False)).alias("_led"),
                F.max(F.col("_earlier").isNull()).alias("_waiting"),
            )
        )
        verdict = (
            F.when(F.col("leads").isNotNull(), F.col("leads"))
            .when(F.coalesce("_led", F.lit(False)), False)
            .when(~F.coalesce("_waiting", F.lit(False)), True)
        )
        state = checkpointed(
            state.join(view, ["graph_id", "tag_key"], "left").select("graph_id", "tag_key", verdict.alias("leads"))
        )
        if state.where(F.col("leads").isNull()).isEmpty():
            break
    # of leaders with one vector only the earliest can be chosen
    leaders = (
        pool.join(state.where("leads"), ["graph_id", "tag_key"], "left_semi")
        .groupBy("graph_id", "embedding").agg(F.min("tag_key").alias("tag_key"))
    )
    rest = new.join(state.where("leads"), ["graph_id", "tag_key"], "left_anti")
    # earlier leaders only: search on negated keys, so "later" in the search is earlier in arrival
    led = nearest(
        rest.select("graph_id", (-F.col("tag_key")).alias("follower"), "embedding"),
        leaders.select("graph_id", (-F.col("tag_key")).alias("leader"), "embedding"),
        k=1, query_id="follower", node_id="leader", floor=same, later_only=True,
    )
    chosen = led.select("graph_id", (-F.col("follower")).alias("tag_key"), (-F.col("leader")).alias("leader_key"))
    return new.select("graph_id", "tag_key").join(chosen, ["graph_id", "tag_key"], "left").withColumn(
        "leader_key", F.coalesce("leader_key", "tag_key")
    )


def upsert_subgoals(
    procedures: DataFrame, stored: DataFrame | None = None, merged: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Exact-text subgoal upsert: (subgoal rows to write, procedure-subgoal edges).

    ``procedures`` carries procedural_id, subgoal, subgoal_embedding and time. A matched subgoal keeps
    its label and takes the vector of the merged wording (``merged(graph_id, subgoal, embedding)``) or of
    the latest mention, and the latest time.
    """
    seen = procedures.groupBy("graph_id", "subgoal").agg(
        F.min("procedural_id").alias("procedural_id"),
        F.min_by("subgoal_embedding", "procedural_id").alias("_first_vector"),
        F.max_by("subgoal_embedding", "procedural_id").alias("_last_vector"),
        F.max("time").alias("time"),
    )
    if merged is not None:
        seen = seen.join(
            merged.select("graph_id", "subgoal", F.col("embedding").alias("_merged")), ["graph_id", "subgoal"], "left"
        )
    else:
        seen = seen.withColumn("_merged", F.lit(None).cast("array<float>"))
    known = None
    fresh = seen
    if stored is not None:
        known = seen.join(stored.select("graph_id", "subgoal", "subgoal_id", "importance"), ["graph_id", "subgoal"])
        fresh = seen.join(stored.select("graph_id", "subgoal"), ["graph_id", "subgoal"], "left_anti")
    created = assign_ids(fresh, ["procedural_id"], "subgoal_id", None if stored is None else next_ids(stored, "subgoal_id")).withColumn(
        "importance", F.lit(DEFAULT_IMPORTANCE)
    )
    columns = ["graph_id", "subgoal_id", "subgoal", F.coalesce("_merged", "_last_vector").alias("embedding"), "time", "importance"]
    rows = created.select(*columns)
    if known is not None:
        rows = rows.unionByName(known.select(*columns))
    edges = procedures.select("graph_id", "procedural_id", "subgoal").join(rows.select("graph_id", "subgoal", "subgoal_id"), ["graph_id", "subgoal"]).select(
        *edge("procedural", "procedural_id", "grouped_by", "subgoal", "subgoal_id")
    )
    return rows, edges


def resolve_subgoals(procedures: DataFrame, subgoals: DataFrame, same: float = vf.SUBGOAL_EQUAL.threshold) -> DataFrame:
    """Find each procedure's subgoal by id, then equal text, then similarity; else it is to be created."""
    by_id = subgoals.select("graph_id", F.col("subgoal_id").alias("stated_subgoal_id"), F.lit(True).alias("_id"))
    by_text = subgoals.groupBy("graph_id", "subgoal").agg(F.min("subgoal_id").alias("_text_id"))
    rows = procedures.join(by_id, ["graph_id", "stated_subgoal_id"], "left").join(by_text, ["graph_id", "subgoal"], "left")
    open_ = rows.where(F.col("_id").isNull() & F.col("_text_id").isNull())
    close = nearest(
        open_.select("graph_id", "procedural_id", F.col("subgoal_embedding").alias("embedding")),
        subgoals, k=1, query_id="procedural_id", node_id="subgoal_id",
    ).where(F.col("value") >= same).select("graph_id", "procedural_id", F.col("subgoal_id").alias("_near_id"))
    rows = rows.join(close, ["graph_id", "procedural_id"], "left")
    how = (
        F.when(F.col("_id").isNotNull(), "id").when(F.col("_text_id").isNotNull(), "text")
        .when(F.col("_near_id").isNotNull(), "similar").otherwise("create")
    )
    found = F.when(F.col("_id").isNotNull(), F.col("stated_subgoal_id")).otherwise(F.coalesce("_text_id", "_near_id"))
    return rows.select("graph_id", "procedural_id", "subgoal", found.alias("subgoal_id"), how.alias("resolved_by"))


def edges_from_lists(
    nodes: DataFrame, src_type: str, src_id: str, ids: Column, kind: str, dst_type: str, targets: DataFrame, dst_id: str
) -> DataFrame:
    """Edges out of an id-list column; ids of nodes that do not exist are dropped."""
    rows = nodes.select("graph_id", src_id, F.explode(F.array_distinct(ids)).alias(dst_id))
    return rows.join(targets.select("graph_id", dst_id), ["graph_id", dst_id], "left_semi").select(
        *edge(src_type, src_id, kind, dst_type, dst_id)
    )


def repair_edges(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """One edge set from lists kept on both ends: the union of both directions."""
    flipped = backward.select(
        "graph_id", F.col("dst_type").alias("src_type"), F.col("dst_id").alias("src_id"), "kind",
        F.col("src_type").alias("dst_type"), F.col("src_id").alias("dst_id"),
    )
    return forward.unionByName(flipped).dropDuplicates()


def cited_by(edges: DataFrame, episodes: DataFrame) -> DataFrame:
    """Facts that cite the given episodes."""
    return edges.where((F.col("kind") == "evidenced_by") & (F.col("dst_type") == "episodic")).join(
        episodes.select("graph_id", F.col("episodic_id").alias("dst_id")), ["graph_id", "dst_id"], "left_semi"
    ).select("graph_id", F.col("dst_id").alias("episodic_id"), F.col("src_id").alias("semantic_id"))


def degree_importance(nodes: DataFrame, id_column: str, edges: DataFrame, kind: str) -> DataFrame:
    """Importance never below the number of linked nodes."""
    degree = edges.where(F.col("kind") == kind).groupBy("graph_id", F.col("dst_id").alias(id_column)).agg(
        F.count(F.lit(1)).alias("_degree")
    )
    return (
        nodes.join(degree, ["graph_id", id_column], "left")
        .withColumn("importance", F.greatest(F.col("importance"), F.coalesce("_degree", F.lit(0))))
        .drop("_degree")
    )


def lineage(edges: DataFrame) -> DataFrame:
    """All originals behind each merged fact: (graph_id, semantic_id, ancestor_id, depth).

    The relation is joined with itself, so known paths double in length per round: a chain of n merges takes
    log2(n) rounds. Rounds stop when neither the pairs nor their depths change; the merge graph has no cycles.
    """
    key = ["graph_id", "semantic_id", "ancestor_id"]
    known = checkpointed(
        edges.where(F.col("kind") == "derived_from")
        .select("graph_id", F.col("src_id").alias("semantic_id"), F.col("dst_id").alias("ancestor_id"), F.lit(1).alias("depth"))
        .distinct()
    )
    size = None
    while True:
        found = known.agg(F.count(F.lit(1)), F.sum("depth")).first()
        if found == size:
            return known
        size = found
        onward = known.select("graph_id", F.col("semantic_id").alias("ancestor_id"), F.col("ancestor_id").alias("_next"), F.col("depth").alias("_more"))
        longer = known.join(onward, ["graph_id", "ancestor_id"]).select("graph_id", "semantic_id", F.col("_next").alias("ancestor_id"), (F.col("depth") + F.col("_more")).alias("depth"))
        known = checkpointed(known.unionByName(longer).groupBy(*key).agg(F.min("depth").alias("depth")))


def insert_batch(
    steps: DataFrame,
    facts: DataFrame,
    procedures: DataFrame,
    stored: dict[str, DataFrame] | None = None,
    embed: Callable[[Column], Column] | None = None,
) -> dict[str, DataFrame]:
    """Turn one batch of structured inserts into rows for every table.

    ``stored`` holds the present tables (ids and clock continue after them). Vectors must already be on
    ``facts.embedding``, ``procedures.embedding`` and ``procedures.subgoal_embedding``; ``embed`` makes those of
    new tags.
    """
    stored = stored or {}

    def first(name: str, id_column: str, clock: str | None = None) -> DataFrame | None:
        return next_ids(stored[name], id_column, clock) if name in stored else None

    episodes = assign_ids(steps, ["insert_id", "trajectory_num", "turn_num"], "episodic_id", first("episodic", "episodic_id"))
    # the logical clock advances by one per inserted fact; merged facts take ids without moving it, and without a graph there is none
    semantic = (
        assign_ids(without_blank(facts).where("graph_id is not null"), ["insert_id", "fact_pos"], "semantic_id", first("semantic", "semantic_id", "time"), "time")
        .withColumn("tags", F.array_distinct("tags"))
        .withColumn("is_active", F.lit(True))
        .withColumn("credibility", F.lit(DEFAULT_CREDIBILITY))
    )
    new_tags, tagged = upsert_tags(semantic, stored.get("tag"), embed)
    procedural = assign_ids(without_blank(procedures), ["insert_id", "proc_pos"], "procedural_id", first("procedural", "procedural_id")).withColumn(
        "time", F.col("procedural_id")
    )
    subgoals, grouped = upsert_subgoals(procedural, stored.get("subgoal"))
    own = grouped.select("graph_id", F.col("src_id").alias("procedural_id"), F.col("dst_id").alias("subgoal_id"))
    procedural = procedural.join(own, ["graph_id", "procedural_id"], "left")
    tag_ids = tagged.groupBy("graph_id", F.col("src_id").alias("semantic_id")).agg(F.sort_array(F.collect_set("dst_id")).alias("tag_ids"))
    semantic = semantic.join(tag_ids, ["graph_id", "semantic_id"], "left").withColumn(
        "tag_ids", F.coalesce("tag_ids", F.array().cast("array<bigint>"))
    )
    edges = (
        tagged.unionByName(evidence_links(semantic, episodes))
        .unionByName(sibling_links(semantic))
        .unionByName(grouped)
        .unionByName(procedure_links(procedural, episodes))
    )
    return {
        "episodic": episodes, "semantic": semantic, "tag": new_tags, "subgoal": subgoals,
        "procedural": procedural, "edges": edges,
    }
