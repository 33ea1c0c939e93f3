"""Merging near-duplicate facts: candidate search, exact greedy resolution, merged rows.

Facts are scanned in id order; each takes its best still-active later fact that shares a tag. The
order matters, so resolution is a fold, but only over facts that can influence each other: candidate
lists come from a blocked similarity search (best ``list_size`` later facts at the threshold or above,
never all pairs), their connected components are independent, and each component is folded in id
order on narrow rows. Oversized components are cut to their first ``fold_size`` scanners and the rest
waits for the next round; a fact whose shortened list runs dry waits too, and everything it might
have reached is decided again after it. The outcome is the sequential one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.functions.value import SEMANTIC_EQUAL, ValueFunction
from mnemolake.functions.vector import hash_embedding
from mnemolake.operators.components import connected_components
from mnemolake.operators.ordered import number_rows
from mnemolake.operators.similarity import nearest
from mnemolake.schema import DEFAULT_CREDIBILITY
from mnemolake.session import checkpointed

# Default limits of a consolidation run.
MERGE_THRESHOLD = 0.5
MERGES_PER_FACT = 1
MIN_CREDIBILITY = -10
LIST_SIZE = 32
FOLD_SIZE = 50_000

MERGE_ROW = "graph_id string, event string, id_a long, id_b long, place int, score double, deactivate_a boolean, deactivate_b boolean"


def decay_credibility(facts: DataFrame, amount: int) -> DataFrame:
    """Active facts older than the graph's ``now`` lose ``amount``."""
    ages = F.col("is_active") & (F.col("time") < F.col("now"))
    return facts.withColumn("credibility", F.when(ages, F.col("credibility") - amount).otherwise(F.col("credibility")))


def in_scope(window: int | None = None) -> Column:
    """Facts a run looks at: all past ones, or the last ``window`` ticks."""
    past = F.col("time") < F.col("now")
    if window is None:
        return past
    return past & (F.col("time") >= F.greatest(F.lit(0), F.col("now") - window))


def soft_deactivated(minimum: int = MIN_CREDIBILITY) -> Column:
    return F.col("is_active") & (F.col("credibility") < minimum)


def candidate_lists(
    scanners: DataFrame,
    candidates: DataFrame,
    *,
    threshold: float = MERGE_THRESHOLD,
    value: ValueFunction = SEMANTIC_EQUAL,
    list_size: int = LIST_SIZE,
    search: Callable[..., DataFrame] = nearest,
) -> DataFrame:
    """Best later facts sharing a tag: (graph_id, id_a, id_b, score, place, full).

    ``full`` marks facts whose list may have been cut at ``list_size``: working lists of the fold, not an answer.
    ``all_pairs`` has every pair. ``search`` may be ``PivotJoin(candidates).nearest``, which gives the same rows.
    """
    copies, searched = (None, scanners)
    if value == SEMANTIC_EQUAL.with_limits(value.k, value.threshold) and 0 < threshold <= 1:
        copies, searched = _next_copies(scanners, candidates, list_size)
    nodes = _by_tag(candidates)
    near = search(
        _by_tag(searched).withColumnRenamed("semantic_id", "id_a"), nodes, k=list_size, query_id="id_a",
        by=("graph_id", "tag_id"), value=value, floor=threshold, later_only=True,
    )
    pairs = near.groupBy("graph_id", "id_a", F.col("semantic_id").alias("id_b")).agg(
        F.max("value").alias("score"), F.max(F.col("rank") >= list_size).alias("_cut")
    )
    best = Window.partitionBy("graph_id", "id_a").orderBy(F.desc("score"), "id_b")
    whole = Window.partitionBy("graph_id", "id_a")
    lists = (
        pairs.withColumn("place", F.row_number().over(best))
        .withColumn("full", F.max("_cut").over(whole) | (F.max("place").over(whole) >= list_size))
        .where(F.col("place") <= list_size)
        .drop("_cut")
    )
    return lists if copies is None else lists.unionByName(copies)


def all_pairs(
    scanners: DataFrame, candidates: DataFrame, *, threshold: float = MERGE_THRESHOLD, value: ValueFunction = SEMANTIC_EQUAL,
    search: Callable[..., DataFrame] = nearest,
) -> DataFrame:
    """Every later fact that shares a tag and reaches the threshold: (graph_id, id_a, id_b, score).

    ``search`` may be ``PivotJoin(candidates).nearest``: hot tags are then not compared with themselves pair by pair.
    """
    near = search(
        _by_tag(scanners).withColumnRenamed("semantic_id", "id_a"), _by_tag(candidates), k=None, query_id="id_a",
        by=("graph_id", "tag_id"), value=value, floor=threshold, later_only=True,
    )
    return near.groupBy("graph_id", "id_a", F.col("semantic_id").alias("id_b")).agg(F.max("value").alias("score"))


def _next_copies(scanners: DataFrame, candidates: DataFrame, list_size: int) -> tuple[DataFrame | None, DataFrame]:
    """Lists of facts with plenty of later copies, and the scanners that still need a search.

    Nothing is closer than a copy (same vector, same tags), so a fact with ``list_size`` later copies has
    the next ones as its list. Large groups of copies then cost a numbering instead of a search of the
    group against itself. Scanners must be among the candidates.
    """
    key = ["graph_id", "_copy"]
    mark = F.xxhash64("embedding", "tag_ids")
    real = (F.size("tag_ids") > 0) & F.exists("embedding", lambda x: x != 0)
    marked = candidates.where(real).select("graph_id", "semantic_id", "embedding", "tag_ids", mark.alias("_copy"))
    sizes = marked.groupBy(*key, "embedding", "tag_ids").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > list_size)
    sizes = checkpointed(sizes.groupBy(*key).agg(F.max("_size").alias("_size"), F.count(F.lit(1)).alias("_kinds")).where("_kinds = 1"))
    if sizes.isEmpty():
        return None, scanners
    grouped = checkpointed(
        number_rows(marked.select(*key, "semantic_id").join(sizes, key), key, ["semantic_id"], "_pos")
    )
    mine = grouped.join(scanners.select("graph_id", "semantic_id"), ["graph_id", "semantic_id"], "left_semi").where(
        F.col("_pos") + list_size < F.col("_size")
    )
    steps = F.sequence(F.lit(1), F.lit(list_size))
    wanted = mine.select(*key, F.col("semantic_id").alias("id_a"), "_pos", F.explode(steps).alias("place"))
    wanted = wanted.withColumn("_pos", F.col("_pos") + F.col("place"))
    lists = wanted.join(grouped.select(*key, "_pos", F.col("semantic_id").alias("id_b")), [*key, "_pos"]).select(
        "graph_id", "id_a", "id_b", F.lit(1.0).alias("score"), "place", F.lit(True).alias("full")
    )
    rest = scanners.join(mine.select("graph_id", "semantic_id"), ["graph_id", "semantic_id"], "left_anti")
    return lists, rest


def _by_tag(facts: DataFrame) -> DataFrame:
    return facts.select("graph_id", "semantic_id", "embedding", F.explode(F.array_distinct("tag_ids")).alias("tag_id"))


def evidence_lists(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """``facts`` with ``episodic_ids`` and ``whole_insert`` from their stored ``evidenced_by`` edges."""
    cited = edges.where((F.col("kind") == "evidenced_by") & (F.col("src_type") == "semantic"))
    lists = cited.groupBy("graph_id", F.col("src_id").alias("semantic_id")).agg(
        F.sort_array(F.collect_set(F.when(F.col("dst_type") == "episodic", F.col("dst_id")))).alias("episodic_ids"),
        F.max(F.col("dst_type") == "insert").alias("whole_insert"),
    )
    bare = facts.drop(*[c for c in ("episodic_ids", "whole_insert") if c in facts.columns])
    return bare.join(lists, ["graph_id", "semantic_id"], "left")


def share_evidence(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Add ``barred``: both facts rest on a common episode.

    Evidence is ``episodic_ids`` (``evidence_lists`` reads it off stored edges); a fact evidenced by its whole
    insert says so in ``whole_insert``, next to ``insert_id``.
    """
    if "episodic_ids" not in facts.columns:
        raise ValueError("facts carry no evidence: add it by evidence_lists, or allow common evidence")
    no = F.lit(False)
    names = ["episodic_ids", *[c for c in ("insert_id", "whole_insert") if c in facts.columns]]
    lists = facts.select("graph_id", "semantic_id", *names)

    def side(name: str) -> DataFrame:
        return lists.select("graph_id", F.col("semantic_id").alias(f"id_{name}"), F.struct(*names).alias(f"_{name}"))

    barred = F.coalesce(F.arrays_overlap(F.col("_a.episodic_ids"), F.col("_b.episodic_ids")), no)
    if len(names) == 3:
        whole = F.coalesce("_a.whole_insert", no) | F.coalesce("_b.whole_insert", no)
        barred |= F.coalesce((F.col("_a.insert_id") == F.col("_b.insert_id")) & whole, no)
    return pairs.join(side("a"), ["graph_id", "id_a"]).join(side("b"), ["graph_id", "id_b"]).withColumn("barred", barred).drop("_a", "_b")


def _folder(k: int, max_merges: int) -> Callable[[tuple, pa.Table], pa.Table]:
    columns = [c.split()[0] for c in MERGE_ROW.split(", ")]

    def fold(key: tuple, rows: pa.Table) -> pa.Table:
        """Scan one component in id order; report merges and decided scanners; stop where a list runs dry.

        The rows stay columns of numbers; Python values are made for one scanner's list at a time.
        """
        names = ("id_a", "id_b", "place", "score", "full", "barred", "deactivate_a", "deactivate_b")
        ids, others, places, *rest = (rows[name].to_numpy() for name in names)
        order = np.lexsort((places, ids))
        starts = np.flatnonzero(np.diff(ids[order], prepend=ids.min() - 1)) if len(ids) else np.zeros(0, np.int64)
        gone: set[int] = set()
        out: list[tuple] = []
        for lo, hi in zip(starts, np.r_[starts[1:], len(ids)]):
            own = order[lo:hi]
            a = int(ids[own[0]])
            if a not in gone:
                options = zip(others[own].tolist(), *(column[own].tolist() for column in rest))
                first = next(options)
                live = [o for o in chain([first], options) if o[0] not in gone][:k]
                if len(live) < k and first[2]:
                    break
                done = 0
                for b, score, _, barred, drop_a, drop_b in live:
                    if barred:
                        continue
                    out.append(("merge", a, b, done, score, drop_a, drop_b))
                    gone.update(([a] if drop_a else []) + ([b] if drop_b else []))
                    done += 1
                    if done >= max_merges:
                        break
            out.append(("scanned", a, None, 0, None, None, None))
        types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.bool_(), pa.bool_())
        made = [pa.array([row[i] for row in out], kind) for i, kind in enumerate(types)]
        return pa.table([pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(out)), *made], columns)

    return fold


def resolve_merges(
    facts: DataFrame,
    *,
    scanner: Column,
    candidate: Column,
    decisions: DataFrame | None = None,
    threshold: float = MERGE_THRESHOLD,
    value: ValueFunction = SEMANTIC_EQUAL,
    max_merges: int = MERGES_PER_FACT,
    allow_common_evidence: bool = False,
    list_size: int = LIST_SIZE,
    fold_size: int = FOLD_SIZE,
) -> DataFrame:
    """Merges of a sequential greedy scan: (graph_id, id_a, id_b, place, score, deactivate_a, deactivate_b).

    ``decisions(graph_id, id_a, id_b, deactivate_earlier, deactivate_later)`` says what a merge does to its
    two sources; without a row both are deactivated.
    """
    list_size = max(list_size, value.k)
    scanners, candidates = facts.where(scanner), facts.where(candidate)
    merges: list[DataFrame] = []
    while True:
        lists = candidate_lists(
            scanners, candidates, threshold=threshold, value=value, list_size=list_size
        )
        lists = lists.withColumn("barred", F.lit(False)) if allow_common_evidence else share_evidence(lists, facts)
        yes = F.lit(True)
        if decisions is None:
            lists = lists.withColumn("deactivate_a", yes).withColumn("deactivate_b", yes)
        else:
            lists = (
                lists.join(decisions.select("graph_id", "id_a", "id_b", "deactivate_earlier", "deactivate_later"), ["graph_id", "id_a", "id_b"], "left")
                .withColumn("deactivate_a", F.coalesce("deactivate_earlier", yes))
                .withColumn("deactivate_b", F.coalesce("deactivate_later", yes))
            )
        lists = checkpointed(lists)
        turn = _first_scanners(_independent(lists, fold_size), fold_size)
        events = checkpointed(turn.groupBy("graph_id", "component").applyInArrow(_folder(value.k, max_merges), MERGE_ROW))
        scanned = events.where("event = 'scanned'").select("graph_id", "id_a")
        waiting = checkpointed(
            lists.groupBy("graph_id", "id_a").agg(F.max("full").alias("full")).join(scanned, ["graph_id", "id_a"], "left_anti")
        )
        if waiting.isEmpty():
            merges.append(events.where("event = 'merge'"))
            break
        # a waiting fact with a shortened list may reach outside its component: redo what follows it
        redo = waiting.where("full").groupBy("graph_id").agg(F.min("id_a").alias("_from"))
        kept = checkpointed(
            events.join(redo, "graph_id", "left").where(F.col("_from").isNull() | (F.col("id_a") < F.col("_from"))).drop("_from")
        )
        merged = kept.where("event = 'merge'")
        merges.append(merged)
        gone = (
            merged.where("deactivate_a").select("graph_id", F.col("id_a").alias("semantic_id"))
            .unionByName(merged.where("deactivate_b").select("graph_id", F.col("id_b").alias("semantic_id")))
            .distinct()
        )
        passed = kept.where("event = 'scanned'").select("graph_id", F.col("id_a").alias("semantic_id"))
        key = ["graph_id", "semantic_id"]
        candidates = checkpointed(candidates.join(gone, key, "left_anti"))
        scanners = checkpointed(scanners.join(gone.unionByName(passed).distinct(), key, "left_anti"))
    return reduce(DataFrame.unionByName, merges).drop("event")


def _independent(lists: DataFrame, fold_size: int) -> DataFrame:
    """Add ``component``: list rows that can be folded apart from each other.

    A graph with no more scanners than one fold takes is one component as it stands; only larger
    graphs are searched for connected components.
    """
    sizes = lists.groupBy("graph_id").agg((F.count_distinct("id_a") > fold_size).alias("_large"))
    marked = lists.join(sizes, "graph_id")
    large = marked.where("_large").drop("_large")
    whole = marked.where("not _large").drop("_large").withColumn("component", F.lit(-1).cast("bigint"))
    if large.isEmpty():
        return whole
    groups = connected_components(large.select("graph_id", F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    return whole.unionByName(large.join(groups.select("graph_id", F.col("id").alias("id_a"), "component"), ["graph_id", "id_a"]))


def _first_scanners(lists: DataFrame, fold_size: int) -> DataFrame:
    """The list rows of each component's first scanners, about ``fold_size`` of them.

    Scanners are counted by ranges of ``fold_size`` ids; whole ranges are taken while they fit, the first one always.
    So no component is ever sorted, however large.
    """
    part = ["graph_id", "component"]
    span = F.floor(F.col("id_a") / F.lit(fold_size))
    sizes = lists.select(*part, "id_a").distinct().groupBy(*part, span.alias("_span")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*part).orderBy("_span").rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(Window.partitionBy(*part).orderBy("_span"))
    last = sizes.select(*part, "_span", upto.alias("_upto"), place.alias("_place")).where((F.col("_upto") <= fold_size) | (F.col("_place") == 1))
    last = last.groupBy(*part).agg(F.max("_span").alias("_last"))
    return lists.join(last, part).where(span <= F.col("_last")).drop("_last")


def consolidate(
    facts: DataFrame,
    clock: DataFrame,
    *,
    decisions: DataFrame | None = None,
    threshold: float = MERGE_THRESHOLD,
    value: ValueFunction = SEMANTIC_EQUAL,
    max_merges: int = MERGES_PER_FACT,
    min_credibility: int = MIN_CREDIBILITY,
    credibility_decay: int = 0,
    window: int | None = None,
    allow_common_evidence: bool = False,
    list_size: int = LIST_SIZE,
    fold_size: int = FOLD_SIZE,
    embed: Callable[[Column], Column] | None = None,
) -> dict[str, DataFrame]:
    """One consolidation run over all graphs: updated facts, merged facts, lineage edges, statistics.

    Merged facts take the graph's present time, which the run does not advance, and no session.
    """
    embed = embed or (lambda text: hash_embedding(text, 32))
    facts = facts.join(clock, "graph_id")
    if credibility_decay:
        facts = decay_credibility(facts, credibility_decay)
    facts = facts.withColumn("_scope", in_scope(window)).withColumn("_weak", F.col("credibility") < min_credibility)
    active = F.col("is_active")
    merges = checkpointed(
        resolve_merges(
            facts, scanner=F.col("_scope") & active & ~F.col("_weak"), candidate=active & (F.col("time") < F.col("now")),
            decisions=decisions, threshold=threshold, value=value, max_merges=max_merges,
            allow_common_evidence=allow_common_evidence, list_size=list_size, fold_size=fold_size,
        )
    )
    key = ["graph_id", "semantic_id"]
    as_earlier = merges.where("deactivate_a").select("graph_id", F.col("id_a").alias("semantic_id"), F.lit(True).alias("_own"))
    as_later = merges.where("deactivate_b").select("graph_id", F.col("id_b").alias("semantic_id"), F.lit(True).alias("_taken"))
    rows = facts.join(as_earlier.distinct(), key, "left").join(as_later.distinct(), key, "left")
    no = F.lit(False)
    own, taken = F.coalesce("_own", no), F.coalesce("_taken", no)
    soft = F.col("_scope") & F.col("_weak") & active & ~taken
    rows = rows.withColumn("_soft", soft).withColumn("_skipped", F.col("_scope") & (~active | taken))
    updated = rows.withColumn("is_active", active & ~own & ~taken & ~F.col("_soft"))
    scanned = rows.groupBy("graph_id").agg(
        F.count_if(F.col("_scope")).alias("scanned"),
        F.count_if(F.col("_skipped")).alias("skipped_inactive"),
        F.count_if(F.col("_soft")).alias("soft_deactivated"),
    )
    pairs = merges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("merged_pairs"))
    zero = F.lit(0).cast("bigint")
    stats = (
        scanned.join(pairs, "graph_id", "left")
        .withColumn("merged_pairs", F.coalesce("merged_pairs", zero))
        .withColumn("new_facts", F.col("merged_pairs"))
    )
    merged = merged_facts(merges, facts, decisions, embed)
    def links(ids: Column, kind: str, target: str) -> DataFrame:
        return merged.select("graph_id", "semantic_id", F.explode(ids).alias("_to")).select(
            "graph_id", F.lit("semantic").alias("src_type"), F.col("semantic_id").alias("src_id"), F.lit(kind).alias("kind"),
            F.lit(target).alias("dst_type"), F.col("_to").cast("bigint").alias("dst_id"),
        )

    sons = links(F.array("id_a", "id_b"), "derived_from", "semantic").unionByName(links(F.col("tag_ids"), "tagged", "tag"))
    if "episodic_ids" in merged.columns:
        sons = sons.unionByName(links(F.col("episodic_ids"), "evidenced_by", "episodic"))
    if "insert_ids" in merged.columns:
        sons = sons.unionByName(links(F.col("insert_ids"), "evidenced_by", "insert"))
    hidden = [c for c in rows.columns if c.startswith("_")]
    return {"facts": updated.drop(*hidden, "now"), "merged": merged, "edges": sons, "stats": stats, "merges": merges}


def merged_facts(merges: DataFrame, facts: DataFrame, decisions: DataFrame | None, embed: Callable[[Column], Column]) -> DataFrame:
    """New fact per merge: decided text (or both texts), united tags and evidence, fresh id."""
    first = facts.groupBy("graph_id").agg((F.max("semantic_id") + 1).alias("_first"))
    numbered = number_rows(merges.select("graph_id", "id_a", "id_b", "place"), ["graph_id"], ["id_a", "place"], "_n")
    has_evidence = "episodic_ids" in facts.columns
    if {"whole_insert", "insert_id"} <= set(facts.columns):
        facts = facts.withColumn("insert_ids", F.when(F.col("whole_insert"), F.array("insert_id")).otherwise(F.array().cast("array<bigint>")))
    parts = ["text", "tags", "tag_ids"] + (["episodic_ids"] if has_evidence else []) + (["insert_ids"] if "insert_ids" in facts.columns else [])

    def side(name: str) -> DataFrame:
        return facts.select("graph_id", F.col("semantic_id").alias(f"id_{name}"), *[F.col(p).alias(f"{p}_{name}") for p in parts])

    rows = numbered.join(first, "graph_id").join(side("a"), ["graph_id", "id_a"]).join(side("b"), ["graph_id", "id_b"])
    rows = rows.join(facts.select("graph_id", "now").distinct(), "graph_id")
    text = F.concat_ws(" ", "text_a", "text_b")
    if decisions is not None and "merged_statement" in decisions.columns:
        rows = rows.join(decisions.select("graph_id", "id_a", "id_b", "merged_statement"), ["graph_id", "id_a", "id_b"], "left")
        text = F.coalesce("merged_statement", text)
    rows = rows.withColumn("text", text)
    united = [
        F.array_sort(F.array_union(F.coalesce(f"{p}_a", F.array().cast(facts.schema[p].dataType)), F.coalesce(f"{p}_b", F.array().cast(facts.schema[p].dataType)))).alias(p)
        for p in parts[1:]
    ]
    return rows.select(
        "graph_id", (F.col("_first") + F.col("_n")).alias("semantic_id"), "text", embed(F.col("text")).alias("embedding"),
        *united, F.col("now").alias("time"), F.lit(True).alias("is_active"),
        F.lit(DEFAULT_CREDIBILITY).alias("credibility"), F.lit(None).cast("string").alias("session_id"), "id_a", "id_b",
    )
