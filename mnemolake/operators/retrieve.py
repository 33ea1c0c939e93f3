"""Batch retrieval over memory graphs.

Inputs: ``queries(graph_id, query_id, embedding, ...)``, ``query_tags(graph_id, query_id, query_tag,
embedding)``, ``tags(graph_id, tag_id, tag, embedding, time, importance)`` and ``facts(graph_id,
semantic_id, embedding, tags, tag_ids, time, is_active, credibility, session_id, ...)``. All queries of
all graphs run in one job; only rows a query keeps are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions import text as tx
from mnemolake.functions import value as vf
from mnemolake.functions.value import ValueFunction
from mnemolake.functions.vector import cosine, hash_embedding
from mnemolake.operators.ordered import number_rows
from mnemolake.operators.similarity import nearest
from mnemolake.schema import MODES
from mnemolake.session import checkpointed

if TYPE_CHECKING:
    from mnemolake.operators.vote_postings import VotePostings

GQ = ["graph_id", "query_id"]

# Direct neighbours considered, vote weights, hits that promote a session, hit pool.
DIRECT_HITS = 5
OWN_TAG_WEIGHT = 5.0
OTHER_TAG_WEIGHT = 1.0
DIRECT_WEIGHT = 2.0
PROMOTE_AT = 3
EPISODIC_POOL = 30
NO_SESSION = "There is no relevant memory"
NO_FACT = "No relevant fact"
NO_EXPERIENCE = "No relevant experiences"


def graph_clock(nodes: DataFrame) -> DataFrame:
    """Logical now per graph: one past the newest node."""
    return nodes.groupBy("graph_id").agg((F.max(F.coalesce("time", F.lit(0))) + 1).alias("now"))


def with_recency(nodes: DataFrame, clock: DataFrame) -> DataFrame:
    return nodes.join(clock, "graph_id").withColumn("recency", F.col("now") - F.col("time")).drop("now")


def _aged(nodes: DataFrame, value: ValueFunction, clock: DataFrame | None) -> DataFrame:
    """Nodes with a ``recency`` column when the value function reads it."""
    if value.recency is None or "recency" in nodes.columns:
        return nodes
    return with_recency(nodes, graph_clock(nodes) if clock is None else clock)


def retrieve_tags(
    query_tags: DataFrame,
    tags: DataFrame,
    value: ValueFunction = vf.TAG_RELEVANT,
    *,
    clock: DataFrame | None = None,
    trace: bool = False,
) -> DataFrame:
    """Stored tags chosen for every query tag; ``trace`` keeps all scored tags with ``selected``."""
    wanted = query_tags.groupBy("graph_id", "query_tag").agg(F.first("embedding").alias("embedding"))
    if trace and clock is None:
        clock = graph_clock(tags)
    scored = _aged(tags, value, clock) if not trace else with_recency(tags, clock)
    if trace:
        pairs = nearest(
            wanted, scored, k=None, query_id="query_tag", node_id="tag_id", value=value
        ).withColumn(
            "rank",
            F.row_number().over(Window.partitionBy("graph_id", "query_tag").orderBy(F.desc("value"), "tag_id")),
        )
    else:
        pairs = nearest(wanted, scored, k=value.k, query_id="query_tag", node_id="tag_id", value=value)
    pairs = pairs.withColumn("selected", (F.col("rank") <= value.k) & (F.col("value") >= value.threshold))
    if not trace:
        pairs = pairs.where("selected")
    keep = ["graph_id", "tag_id", "tag", "importance"] + (["recency"] if trace else [])
    return (
        query_tags.select(*GQ, "query_tag")
        .join(pairs, ["graph_id", "query_tag"])
        .join(scored.select(*keep), ["graph_id", "tag_id"])
    )


def direct_facts(queries: DataFrame, facts: DataFrame, k: int = DIRECT_HITS) -> DataFrame:
    """The k active facts closest to each query."""
    return nearest(queries, facts.where("is_active"), k=k)


def weighted_hits(query_tags: DataFrame, hits: DataFrame) -> DataFrame:
    """Chosen tags per query with vote count and weight; a tag the query names weighs five-fold."""
    named = query_tags.groupBy(*GQ).agg(F.collect_set("query_tag").alias("_named"))
    weight = F.when(F.array_contains("_named", F.col("tag")), OWN_TAG_WEIGHT).otherwise(OTHER_TAG_WEIGHT)
    return (
        hits.join(named, GQ)
        .withColumn("_weight", weight * F.col("importance"))
        .groupBy(*GQ, "tag_id")
        .agg(F.count(F.lit(1)).alias("hit_votes"), F.sum("_weight").alias("hit_weight"))
    )


def fact_tags(facts: DataFrame, *keep: str) -> DataFrame:
    """One row per (fact, tag)."""
    return facts.select("graph_id", "semantic_id", *keep, F.explode(F.array_distinct("tag_ids")).alias("tag_id"))


def tag_votes(weighted: DataFrame, facts: DataFrame, direct: DataFrame) -> DataFrame:
    """Votes per (query, fact): one and the tag's weight per chosen tag, one and 2 per direct hit.

    The join key is (graph, tag); a tag holding a large share of the facts is split by adaptive
    skew handling, or never shuffled when the chosen tags are few enough to be broadcast.
    """
    by_tag = fact_tags(facts).join(weighted, ["graph_id", "tag_id"]).select(
        *GQ, "semantic_id", "hit_votes", "hit_weight"
    )
    by_distance = direct.select(
        *GQ, "semantic_id", F.lit(1).cast("bigint").alias("hit_votes"), F.lit(DIRECT_WEIGHT).alias("hit_weight")
    )
    return (
        by_tag.unionByName(by_distance)
        .groupBy(*GQ, "semantic_id")
        .agg(F.sum("hit_votes").alias("tag_votes"), F.sum("hit_weight").alias("vote_weight"))
    )


def _score(votes: DataFrame, queries: DataFrame, facts: DataFrame, value: ValueFunction) -> DataFrame:
    """Value of every candidate (query, fact) row."""
    asked = queries.select(*GQ, F.col("embedding").alias("_query_vector"))
    extra = [c for c in ("recency", "credibility", "is_active", "tags") if c in facts.columns]
    nodes = facts.select("graph_id", "semantic_id", "embedding", F.size("tags").alias("_n_tags"), *extra)
    rows = votes.join(asked, GQ).join(nodes, ["graph_id", "semantic_id"])
    rows = rows.withColumn("relevance", cosine(F.col("_query_vector"), F.col("embedding"))).withColumn(
        "importance", F.col("vote_weight") / F.greatest(F.lit(1), F.col("_n_tags"))
    )
    recency = F.col("recency") if "recency" in extra else F.lit(0)
    total = value.score(F.col("relevance"), F.col("importance"), recency)
    return rows.withColumn("value", F.round(total, 12)).drop(
        "_query_vector", "embedding", "_n_tags", "vote_weight"
    )


def _ranked(rows: DataFrame, node: str) -> DataFrame:
    best = Window.partitionBy(*GQ).orderBy(F.desc("value"), node)
    return rows.withColumn("rank", F.row_number().over(best))


def choose_tags(
    query_tags: DataFrame, tags: DataFrame, tag_value: ValueFunction = vf.TAG_RELEVANT, clock: DataFrame | None = None
) -> DataFrame:
    """Stored tags chosen per query with their votes and weight (a few rows per query, settled once)."""
    return checkpointed(weighted_hits(query_tags, retrieve_tags(query_tags, tags, tag_value, clock=clock)))


def retrieve_semantic(
    queries: DataFrame,
    query_tags: DataFrame,
    tags: DataFrame,
    facts: DataFrame,
    *,
    tag_value: ValueFunction = vf.TAG_RELEVANT,
    value: ValueFunction = vf.SEMANTIC_RELEVANT,
    clock: DataFrame | None = None,
    prune: bool = True,
    chosen: DataFrame | None = None,
    postings: VotePostings | None = None,
) -> DataFrame:
    """Facts kept per query: candidates are tag-voted facts (inactive too) and the direct hits.

    When the value function ignores importance, a fact outside the k best of each chosen tag cannot
    win, so tags are searched with a running top-k and no candidate pairs are produced
    (``prune=False`` forces the general route; both give the same rows). ``chosen`` hands in the
    result of ``choose_tags`` when several calls share it. ``postings`` are stored lists of the same facts:
    with a value of monotone components only those of their blocks are scored that can hold a winner.
    """
    if chosen is None:
        chosen = choose_tags(query_tags, tags, tag_value, clock)
    if postings is not None:
        return postings.search(queries, chosen, direct_facts(queries, facts), value, clock=clock)[0]
    facts = _aged(facts, value, clock)
    direct = direct_facts(queries, facts)
    if prune and value.importance is None:
        scored = _pruned_candidates(queries, chosen, facts, direct, value)
    else:
        scored = _score(tag_votes(chosen, facts, direct), queries, facts, value)
    scored = _ranked(scored, "semantic_id")
    return scored.where((F.col("rank") <= value.k) & (F.col("value") >= value.threshold)).select(
        *GQ, "semantic_id", "relevance", "importance", "tag_votes", "value", "rank"
    )


def _pruned_candidates(
    queries: DataFrame, chosen: DataFrame, facts: DataFrame, direct: DataFrame, value: ValueFunction
) -> DataFrame:
    """Candidates that can still win, with votes counted for them alone.

    Relevance comes from the searches, so the facts are joined once, without their vectors.
    """
    recency = ["recency"] if value.recency is not None else []
    scoped = chosen.select(*GQ, "tag_id").join(queries.select(*GQ, "embedding"), GQ)
    near = nearest(scoped, fact_tags(facts, "embedding", *recency), k=value.k, by=("graph_id", "tag_id"), value=value)
    rows = near.select(*GQ, "semantic_id", "relevance", F.lit(0).alias("_direct")).unionByName(
        direct.select(*GQ, "semantic_id", "relevance", F.lit(1).alias("_direct"))
    )
    pairs = rows.groupBy(*GQ, "semantic_id").agg(F.max("relevance").alias("relevance"), F.max("_direct").alias("_direct"))
    nodes = facts.select("graph_id", "semantic_id", "tag_ids", F.size("tags").alias("_n_tags"), *recency)
    pairs = pairs.join(nodes, ["graph_id", "semantic_id"])
    voters = pairs.select(*GQ, "semantic_id", F.explode_outer(F.array_distinct("tag_ids")).alias("tag_id"), "relevance", "_direct", "_n_tags", *recency)
    zero = F.lit(0)
    votes = (
        voters.join(chosen, [*GQ, "tag_id"], "left")
        .groupBy(*GQ, "semantic_id")
        .agg(
            F.first("relevance").alias("relevance"),
            (F.sum(F.coalesce("hit_votes", zero)) + F.first("_direct")).alias("tag_votes"),
            (F.sum(F.coalesce("hit_weight", zero)) + F.first("_direct") * DIRECT_WEIGHT).alias("_weight"),
            F.first("_n_tags").alias("_n_tags"),
            *[F.first(c).alias(c) for c in recency],
        )
        .withColumn("importance", F.col("_weight") / F.greatest(F.lit(1), F.col("_n_tags")))
    )
    age = F.col("recency") if recency else F.lit(0)
    return votes.withColumn("value", F.round(value.score(F.col("relevance"), F.col("importance"), age), 12))


def trace_semantic(
    queries: DataFrame,
    query_tags: DataFrame,
    tags: DataFrame,
    facts: DataFrame,
    *,
    tag_value: ValueFunction = vf.TAG_RELEVANT,
    value: ValueFunction = vf.SEMANTIC_RELEVANT,
    clock: DataFrame | None = None,
) -> DataFrame:
    """Every candidate fact with its components and whether it was selected."""
    chosen = choose_tags(query_tags, tags, tag_value, clock)
    aged = with_recency(facts, graph_clock(facts) if clock is None else clock)
    votes = tag_votes(chosen, aged, direct_facts(queries, aged))
    scored = _ranked(_score(votes, queries, aged, value), "semantic_id")
    return scored.withColumn(
        "selected", (F.col("rank") <= value.k) & (F.col("value") >= value.threshold)
    ).withColumn("k", F.lit(value.k)).withColumn("value_threshold", F.lit(value.threshold))


def plan_source(override: Column, supplied: Column, stated: Column) -> Column:
    """Where a query's plan came from: caller override, parsed response, or default."""
    return (
        F.when(override.isNotNull(), "override").when(supplied.isNotNull(), "llm").otherwise(F.coalesce(stated, F.lit("default")))
    )


def retrieve_semantic_untagged(
    queries: DataFrame,
    facts: DataFrame,
    value: ValueFunction = vf.SEMANTIC_RELEVANT_FOR_EPISODIC,
    clock: DataFrame | None = None,
) -> DataFrame:
    """Best facts by value alone, inactive ones included."""
    found = nearest(queries, _aged(facts, value, clock), k=value.k, value=value)
    return found.where(F.col("value") >= value.threshold)


def promote_sessions(hits: DataFrame, facts: DataFrame, pool: int = EPISODIC_POOL) -> DataFrame:
    """Sessions with three or more hits stand for all their hits; other hits stand for themselves.

    Promoted sessions come first, by first hit; item numbers start at 0 per query.
    """
    rows = hits.where(F.col("rank") <= pool).join(
        facts.select("graph_id", "semantic_id", "session_id"), ["graph_id", "semantic_id"]
    )
    session = Window.partitionBy(*GQ, "session_id")
    rows = rows.withColumn(
        "_size", F.when(F.col("session_id").isNotNull(), F.count(F.lit(1)).over(session)).otherwise(0)
    )
    whole = (
        rows.where(F.col("_size") >= PROMOTE_AT)
        .groupBy(*GQ, "session_id")
        .agg(F.min("rank").alias("_rank"))
        .select(*GQ, F.lit("session").alias("kind"), "session_id", F.lit(None).cast("bigint").alias("semantic_id"), "_rank")
    )
    single = rows.where(F.col("_size") < PROMOTE_AT).select(
        *GQ, F.lit("fact").alias("kind"), "session_id", "semantic_id", F.col("rank").alias("_rank")
    )
    number = F.row_number().over(Window.partitionBy(*GQ).orderBy(F.desc("kind"), "_rank")) - 1
    return whole.unionByName(single).withColumn("item", number).drop("_rank")


def episode_text(observation: Column, action: Column) -> Column:
    blank = F.lit("")
    return F.concat_ws("\n", F.nullif(observation, blank), F.nullif(action, blank))


def session_text(episodes: DataFrame) -> DataFrame:
    """Per session: the first step's date, then observation and action lines. One cell per session."""
    ordered = tx.ordered_join(F.col("episodic_id"), episode_text(F.col("observation"), F.col("action")), "\n")
    first = F.coalesce(F.min_by("time", "episodic_id"), F.lit(""))
    return (
        episodes.where(F.col("session_id").isNotNull())
        .groupBy("graph_id", "session_id")
        .agg(F.concat(first, F.lit("\n"), ordered, F.lit("\n")).alias("text"))
    )


def episodic_context(items: DataFrame, facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """Numbered ``Relevant Memory i:`` text per query; only promoted sessions are rendered."""
    wanted = items.where("kind = 'session'").select("graph_id", "session_id").distinct()
    texts = session_text(episodes.join(wanted, ["graph_id", "session_id"], "left_semi"))
    sessions = (
        items.where("kind = 'session'")
        .join(texts, ["graph_id", "session_id"], "left")
        .select(*GQ, "item", F.coalesce("text", F.lit(NO_SESSION)).alias("text"))
    )
    singles = (
        items.where("kind = 'fact'")
        .join(facts.select("graph_id", "semantic_id", "text"), ["graph_id", "semantic_id"])
        .select(*GQ, "item", F.concat("text", F.lit("\n")).alias("text"))
    )
    line = F.concat(F.lit("Relevant Memory "), F.col("item").cast("string"), F.lit(":\n"), F.col("text"))
    return sessions.unionByName(singles).groupBy(*GQ).agg(tx.ordered_join(F.col("item"), line, "").alias("text"))


def best_subgoal(
    queries: DataFrame, subgoals: DataFrame, value: ValueFunction = vf.SUBGOAL_RELEVANT, clock: DataFrame | None = None
) -> DataFrame:
    """The one subgoal of highest value per query, if it reaches the threshold."""
    found = nearest(queries, _aged(subgoals, value, clock), k=1, node_id="subgoal_id", value=value)
    return found.where(F.col("value") >= value.threshold)


def subgoal_matches(matches: DataFrame, subgoals: DataFrame) -> DataFrame:
    """Subgoal importance grown by one per successful match, from a log of matches."""
    counts = matches.groupBy("graph_id", "subgoal_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        subgoals.join(counts, ["graph_id", "subgoal_id"], "left")
        .withColumn("importance", F.col("importance") + F.coalesce("_n", F.lit(0)))
        .drop("_n")
    )


def retrieve_procedural(
    queries: DataFrame,
    subgoals: DataFrame,
    procedures: DataFrame,
    *,
    subgoal_value: ValueFunction = vf.SUBGOAL_RELEVANT,
    value: ValueFunction = vf.PROCEDURAL_RELEVANT,
    clock: DataFrame | None = None,
    trace: bool = False,
) -> DataFrame:
    """Procedures of each query's best subgoal, best value first.

    ``procedures`` carries ``subgoal_id`` and, for value functions that read it, ``ret``.
    """
    match = best_subgoal(queries, subgoals, subgoal_value, clock)
    scoped = match.select(*GQ, "subgoal_id").join(queries.select(*GQ, "embedding"), GQ)
    found = nearest(
        scoped,
        _aged(procedures, value, clock),
        k=None if trace else value.k,
        node_id="procedural_id",
        by=("graph_id", "subgoal_id"),
        value=value,
    )
    found = _ranked(found, "procedural_id")
    kept = (F.col("rank") <= value.k) & (F.col("value") >= value.threshold)
    return found.withColumn("selected", kept) if trace else found.where(kept)


def _numbered(hits: DataFrame, nodes: DataFrame, node_id: str, label: str) -> DataFrame:
    line = F.concat(F.lit(f"{label} "), (F.col("rank") - 1).cast("string"), F.lit(": "), F.col("text"), F.lit("\n"))
    return (
        hits.select(*GQ, node_id, "rank")
        .join(nodes.select("graph_id", node_id, "text"), ["graph_id", node_id])
        .groupBy(*GQ)
        .agg(tx.ordered_join(F.col("rank"), line, "").alias("text"))
    )


def render_facts(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """``Fact i: text`` lines per query in rank order."""
    return _numbered(hits, facts, "semantic_id", "Fact")


def render_fact_ids(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """``Fact i (Sem Node id): text`` lines over the distinct facts of a query, by id; blank texts skipped."""
    number = F.row_number().over(Window.partitionBy(*GQ).orderBy("semantic_id")) - 1
    line = F.concat(
        F.lit("Fact "), F.col("_n").cast("string"), F.lit(" (Sem Node "), F.col("semantic_id").cast("string"),
        F.lit("): "), tx.strip(F.col("text")),
    )
    return (
        hits.select(*GQ, "semantic_id").distinct().withColumn("_n", number)
        .join(facts.select("graph_id", "semantic_id", "text"), ["graph_id", "semantic_id"])
        .where(tx.strip(F.col("text")) != "")
        .groupBy(*GQ)
        .agg(tx.ordered_join(F.col("semantic_id"), line, "\n").alias("text"))
    )


def retrieve(
    queries: DataFrame,
    query_tags: DataFrame,
    tables: dict[str, DataFrame],
    *,
    tag_value: ValueFunction = vf.TAG_RELEVANT,
    value: ValueFunction = vf.SEMANTIC_RELEVANT,
    subgoal_value: ValueFunction = vf.SUBGOAL_RELEVANT,
    procedural_value: ValueFunction = vf.PROCEDURAL_RELEVANT,
) -> DataFrame:
    """Answer each query in its ``mode``: one row per query with the rendered memory text.

    An unknown mode fails the job. ``queries`` may carry ``subgoal_embedding`` for procedural search.
    Selected ids of both node kinds come along for the audit log.
    """
    known = F.assert_true(F.col("mode").isin(*MODES), F.concat(F.lit("Invalid mode: "), F.col("mode")))
    queries = queries.where(known.isNull())
    facts, episodes = tables["semantic"], tables["episodic"]
    wants_facts = queries.where(F.col("mode") != "procedural_memory")
    wants_procedures = queries.where(F.col("mode") != "semantic_memory")
    if "subgoal_embedding" in queries.columns:
        wants_procedures = wants_procedures.withColumn("embedding", F.col("subgoal_embedding"))
    facts_hit = retrieve_semantic(
        wants_facts, query_tags.join(wants_facts.select(*GQ), GQ, "left_semi"), tables["tag"], facts,
        tag_value=tag_value, value=value,
    )
    procedures_hit = retrieve_procedural(
        wants_procedures, tables["subgoal"], tables["procedural"], subgoal_value=subgoal_value, value=procedural_value
    )
    episodic_queries = queries.where(F.col("mode") == "episodic_memory")
    items = promote_sessions(retrieve_semantic_untagged(episodic_queries, facts), facts)
    texts = (
        render_facts(facts_hit, facts).withColumn("mode", F.lit("semantic_memory"))
        .unionByName(_numbered(procedures_hit, tables["procedural"], "procedural_id", "Experience").withColumn("mode", F.lit("procedural_memory")))
        .unionByName(episodic_context(items, facts, episodes).withColumn("mode", F.lit("episodic_memory")))
    )
    ids = facts_hit.groupBy(*GQ).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "semantic_id"))), lambda r: r["semantic_id"]).alias("selected_semantic_ids")
    )
    pids = procedures_hit.groupBy(*GQ).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "procedural_id"))), lambda r: r["procedural_id"]).alias("selected_procedural_ids")
    )
    empty = (
        F.when(F.col("mode") == "semantic_memory", NO_FACT)
        .when(F.col("mode") == "procedural_memory", NO_EXPERIENCE)
        .otherwise("")
    )
    none = F.array().cast("array<bigint>")
    return (
        queries.select(*GQ, "mode")
        .join(texts, [*GQ, "mode"], "left")
        .join(ids, GQ, "left")
        .join(pids, GQ, "left")
        .withColumn("text", F.coalesce("text", empty))
        .withColumn("selected_semantic_ids", F.coalesce("selected_semantic_ids", none))
        .withColumn("selected_procedural_ids", F.coalesce("selected_procedural_ids", none))
    )


def dense_passages(queries: DataFrame, passages: DataFrame, k: int = 5) -> DataFrame:
    """Plain dense retrieval: k best passages and their ``[rank] (sim=…) text`` lines."""
    found = nearest(queries, passages, k=k, node_id="passage_id")
    line = F.format_string("[%d] (sim=%.4f) %s", F.col("rank"), F.col("relevance"), F.col("text"))
    return found.join(passages.select("graph_id", "passage_id", "text"), ["graph_id", "passage_id"]).select(
        *GQ, "passage_id", "rank", "relevance", line.alias("line")
    )


def nearest_objective(queries: DataFrame, objectives: DataFrame) -> DataFrame:
    """The stored trajectory whose objective is closest."""
    return nearest(queries, objectives, k=1, node_id="entry_id")


def fan_out(queries: DataFrame, graphs: DataFrame) -> DataFrame:
    """One row per (query, target graph): primary first, then shared ones, repeats dropped.

    A graph that does not exist gives a row with ``error`` and does not disturb the others.
    """
    targets = F.array_distinct(F.concat(F.array("graph_id"), F.coalesce("shared_graphs", F.array().cast("array<string>"))))
    rows = queries.withColumn("_targets", targets).select(
        *[c for c in queries.columns if c not in ("graph_id", "shared_graphs")],
        F.posexplode("_targets").alias("target_pos", "graph_id"),
    )
    known = graphs.select("graph_id", F.lit(True).alias("_known"))
    missing = F.concat(F.lit("graph not found: "), F.col("graph_id"))
    return (
        rows.join(known, "graph_id", "left")
        .withColumn("error", F.when(F.col("_known").isNull(), missing))
        .drop("_known")
    )


def labelled_blocks(answers: DataFrame) -> DataFrame:
    """Per-graph answers of a query joined in target order, each under its graph label."""
    failed = F.col("error").isNotNull()
    label = F.concat(
        F.lit("[graph:"), F.col("graph_id"), F.lit(" | "), F.when(failed, "error").otherwise(F.col("mode")), F.lit("]\n")
    )
    block = F.concat(label, F.when(failed, F.col("error")).otherwise(F.coalesce("text", F.lit(""))))
    return answers.groupBy("query_id").agg(
        tx.ordered_join(F.col("target_pos"), block, "\n\n---\n\n").alias("text")
    )


def audit_rows(answers: DataFrame, last_ids: DataFrame, *, endpoint: str, ts: Column) -> DataFrame:
    """Recall-log rows for a batch of answers; ids continue after the last one of each graph."""
    rows = number_rows(answers, ["graph_id"], ["query_id"], "_n")
    return (
        rows.join(last_ids, "graph_id", "left")
        .withColumn("recall_id", F.col("_n") + F.coalesce(F.col("last_id") + 1, F.lit(0)))
        .withColumn("endpoint", F.lit(endpoint))
        .withColumn("ts", ts)
        .drop("_n", "last_id", "query_id")
    )


def multi_hop(
    queries: DataFrame,
    query_tags: DataFrame,
    tags: DataFrame,
    facts: DataFrame,
    *,
    max_rounds: int = 3,
    seeds: int = 3,
    control: DataFrame | None = None,
    embed: Callable[[Column], Column] | None = None,
    tag_value: ValueFunction = vf.TAG_RELEVANT,
    value: ValueFunction = vf.SEMANTIC_RELEVANT,
) -> tuple[DataFrame, DataFrame]:
    """Iterated fact retrieval: each round asks again with the texts of chosen facts added.

    ``control(graph_id, query_id, round, enough, top_ids)`` holds parsed controller answers; without a row the
    lowest ``seeds`` ids of the round are chosen. A query stops on no new fact, ``enough``, no
    chosen id, or blank chosen texts. Returns (facts found per query, round log). Rounds are a
    bounded driver loop; state is checkpointed between rounds and stopped queries leave it.
    """
    embed = embed or (lambda text: hash_embedding(text, 64))
    fact_texts = facts.select("graph_id", "semantic_id", tx.strip(F.col("text")).alias("_text"))
    open_ = queries.select(*GQ, "question", F.col("embedding"))
    tags_chosen = choose_tags(query_tags, tags, tag_value)
    seen: DataFrame | None = None
    logs: list[DataFrame] = []
    for round_no in range(1, max_rounds + 1):
        hits = checkpointed(
            retrieve_semantic(open_, query_tags, tags, facts, value=value, chosen=tags_chosen).select(*GQ, "semantic_id")
        )
        fresh = hits if seen is None else hits.join(seen.drop("round"), [*GQ, "semantic_id"], "left_anti")
        fresh = fresh.withColumn("round", F.lit(round_no))
        seen = checkpointed(fresh if seen is None else seen.unionByName(fresh))
        gained = seen.where(F.col("round") == round_no).groupBy(*GQ).agg(F.count(F.lit(1)).alias("n_new"))
        found = hits.groupBy(*GQ).agg(F.sort_array(F.collect_set("semantic_id")).alias("_ids"))
        state = open_.join(found, GQ, "left").join(gained, GQ, "left")
        state = state.withColumn("n_new", F.coalesce("n_new", F.lit(0).cast("bigint"))).withColumn(
            "_ids", F.coalesce("_ids", F.array().cast("array<bigint>"))
        )
        if control is None:
            state = state.withColumn("enough", F.lit(False)).withColumn("_picked", F.slice("_ids", 1, seeds))
        else:
            answers = control.where(F.col("round") == round_no).select(*GQ, "enough", "top_ids")
            cleaned = F.slice(F.array_distinct(F.filter("top_ids", lambda i: F.array_contains(F.col("_ids"), i))), 1, seeds)
            state = (
                state.join(answers, GQ, "left")
                .withColumn("_picked", F.when(F.col("top_ids").isNull(), F.slice("_ids", 1, seeds)).otherwise(cleaned))
                .withColumn("enough", F.coalesce("enough", F.lit(False)))
                .drop("top_ids")
            )
        chosen = state.select(*GQ, F.posexplode("_picked").alias("_pos", "semantic_id")).join(
            fact_texts, ["graph_id", "semantic_id"]
        ).where("_text <> ''")
        more = chosen.groupBy(*GQ).agg(tx.ordered_join(F.col("_pos"), F.col("_text"), "\n").alias("_more"))
        reason = (
            F.when(F.col("n_new") == 0, "no_gain")
            .when(F.col("enough"), "enough")
            .when(F.size("_picked") == 0, "no_candidates")
            .when(F.col("_more").isNull(), "selected_nodes_empty")
        )
        state = state.join(more, GQ, "left").withColumn("stop_reason", reason)
        state = checkpointed(state)
        logs.append(
            state.select(*GQ, F.lit(round_no).alias("round"), F.size("_ids").alias("n_retrieved"), "n_new", "stop_reason")
        )
        open_ = state.where(F.col("stop_reason").isNull()).select(
            *GQ, "question",
            embed(F.concat(F.lit("original question: "), F.col("question"), F.lit("\n"), F.col("_more"))).alias("embedding"),
        )
        if round_no < max_rounds and open_.isEmpty():
            break
    log = logs[0]
    for more_rows in logs[1:]:
        log = log.unionByName(more_rows)
    return seen, log
