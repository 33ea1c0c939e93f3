"""Answer quality: exact match, token F1, gold contexts, baselines with random context."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.functions import text as tx
from mnemolake.operators.ordered import number_rows
from mnemolake.session import checkpointed

# Fixed value: share of the budget at which packing stops.
FULL_AT = 0.99

# Primes above any 32-bit position: each is a stride that visits every position exactly once.
STRIDES = (4294967311, 4294967357, 4294967371, 4294967377, 4294967387, 4294967389, 4294967459, 4294967477)


def _token_f1(pred: list[str], gold: list[str]) -> float:
    same = (Counter(pred) & Counter(gold)).total()
    if not same:
        return 0.0
    precision, recall = same / len(pred), same / len(gold)
    return 2.0 * precision * recall / (precision + recall)


def em_f1(predictions: DataFrame, key: str, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Exact match and token F1 (multiset overlap) per ``key``, which is unique: (key, em, f1).

    Without gold both are 0. Both texts stand in one row, so tokens are counted there, in Arrow batches and
    without any shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f1 = [_token_f1(p, g) for p, g in zip(batch.column("p").to_pylist(), batch.column("g").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("em"), pa.array(f1, pa.float64())], [key, "em", "f1"])

    none = F.array().cast("array<string>")
    p, g = tx.answer_tokens(F.col(pred)), tx.answer_tokens(F.col(gold))
    rows = predictions.select(key, F.coalesce(p, none).alias("p"), g.alias("g"))
    rows = rows.select(key, F.coalesce(F.col("p") == F.col("g"), F.lit(False)).cast("double").alias("em"), "p", F.coalesce("g", none).alias("g"))
    out = T.StructType([rows.schema[key], T.StructField("em", T.DoubleType()), T.StructField("f1", T.DoubleType())])
    return rows.mapInArrow(count, out)


def score_summary(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("em").alias("em"), F.avg("f1").alias("f1"))


def task_success(results: DataFrame, *by: str) -> DataFrame:
    """A task succeeds with positive reward or success."""
    good = (F.coalesce("reward", F.lit(0.0)) > 0) | (F.coalesce("success", F.lit(0.0)) > 0)
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(good).alias("successful_tasks"),
        F.count_if(~good).alias("failed_tasks"),
        (F.avg(good.cast("double")) * 100).alias("success_rate"),
    )


def gold_sentences(items: DataFrame, include_title: bool = False) -> DataFrame:
    """Supporting sentences of each question, in context order then sentence order.

    ``context ARRAY<STRUCT<title, sents>>``, ``supporting_facts ARRAY<STRUCT<title, idx>>``; indexes
    out of range are skipped.
    """
    wanted = F.transform(
        F.filter("supporting_facts", lambda s: s["title"] == F.col("_p.title")), lambda s: s["idx"]
    )
    rows = items.select("id", "supporting_facts", F.posexplode("context").alias("_c", "_p"))
    rows = rows.select("id", "_c", "_p", F.explode(F.array_distinct(wanted)).alias("idx")).where(
        (F.col("idx") >= 0) & (F.col("idx") < F.size("_p.sents"))
    )
    sentence = F.get(F.col("_p.sents"), F.col("idx"))
    text = F.concat(F.col("_p.title"), F.lit("\n"), sentence) if include_title else sentence
    return rows.groupBy("id").agg(tx.ordered_join(F.struct("_c", "idx"), text, "\n").alias("gold_context"))


def gold_paragraphs(items: DataFrame, include_title: bool = False) -> DataFrame:
    """Supporting paragraphs by index; the decomposition's indexes when none is marked."""
    marked = F.transform(
        F.filter("paragraphs", lambda p: F.coalesce(p["is_supporting"], F.lit(False)) & p["idx"].isNotNull()), lambda p: p["idx"]
    )
    fallback = F.filter(F.transform("question_decomposition", lambda s: s["paragraph_support_idx"]), lambda i: i.isNotNull())
    chosen = F.when(F.size(marked) > 0, marked).otherwise(F.coalesce(fallback, F.array().cast("array<int>")))
    # of paragraphs with one index the last one counts
    rows = items.select("id", F.explode(F.array_distinct(chosen)).alias("idx"), "paragraphs").select(
        "id", "idx", F.try_element_at(F.filter("paragraphs", lambda p: p["idx"] == F.col("idx")), F.lit(-1)).alias("_p")
    )
    rows = rows.where(tx.strip(F.col("_p.paragraph_text")) != "")
    titled = F.concat_ws("\n", F.nullif(tx.strip(F.col("_p.title")), F.lit("")), F.col("_p.paragraph_text"))
    text = titled if include_title else F.col("_p.paragraph_text")
    return rows.groupBy("id").agg(tx.ordered_join(F.col("idx"), text, "\n").alias("gold_context"))


def _digits(seed: int, key: Column, salt: str) -> Column:
    """A reproducible non-negative BIGINT per key."""
    text = F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def with_permutation(queries: DataFrame, sizes: DataFrame, seed: int, key: str = "query_id") -> DataFrame:
    """Give every query its own order over the positions 0..n-1 of its graph: start and stride.

    Position j of the order is ``(start + j * stride) mod n``; strides are primes above n, so the
    first n positions are all different. Nothing is shuffled to draw a sample.
    """
    index = _digits(seed, F.col(key), "stride") % len(STRIDES)
    stride = F.element_at(F.array(*[F.lit(p) for p in STRIDES]), (index + 1).cast("int"))
    return (
        queries.join(sizes, "graph_id")
        .withColumn("_start", _digits(seed, F.col(key), "start") % F.col("_n"))
        .withColumn("_stride", stride % F.col("_n"))
    )


def _positions(first: Column, count: Column) -> Column:
    n = F.col("_n")
    steps = F.sequence(first, first + count - 1)
    return F.transform(steps, lambda j: (F.col("_start") + (j * F.col("_stride")) % n) % n)


def random_context(queries: DataFrame, facts: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k facts per question, drawn reproducibly without looking at the question.

    Returns (graph_id, query_id, rank, semantic_id); fewer when the graph is smaller.
    """
    placed = number_rows(facts.select("graph_id", "semantic_id"), ["graph_id"], ["semantic_id"], "_pos")
    sizes = facts.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"))
    drawn = with_permutation(queries.select("graph_id", "query_id"), sizes, seed)
    picks = drawn.select(
        "graph_id", "query_id", F.posexplode(_positions(F.lit(0).cast("bigint"), F.least(F.lit(k), F.col("_n")))).alias("_j", "_pos")
    )
    return picks.join(placed, ["graph_id", "_pos"]).select(
        "graph_id", "query_id", (F.col("_j") + 1).alias("rank"), "semantic_id"
    )


def uniform_context(queries: DataFrame, facts: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """As ``random_context``, but every k facts of a graph, in every order, are equally likely.

    Positions are drawn by Floyd's method: of the last k numbers j below n, each adds a number drawn from 0..j, or itself
    when that one is taken. k draws per question, whatever the size of the graph; the order is that of a hash.
    """
    placed = number_rows(facts.select("graph_id", "semantic_id"), ["graph_id"], ["semantic_id"], "_pos")
    sizes = facts.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"))
    asked = queries.select("graph_id", "query_id").join(sizes, "graph_id")

    def mark(salt: str, number: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string"), F.lit(salt), number.cast("string")))

    def add(taken: Column, j: Column) -> Column:
        drawn = F.conv(F.substring(mark("draw", j), 1, 12), 16, 10).cast("bigint") % (j + 1)
        return F.array_append(taken, F.when(F.array_contains(taken, drawn), j).otherwise(drawn))

    last = F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("_n") - k), F.col("_n") - 1)
    taken = F.aggregate(last, F.array().cast("array<bigint>"), add) if k > 0 else F.array().cast("array<bigint>")
    order = F.array_sort(F.transform(taken, lambda p: F.struct(mark("rank", p).alias("mark"), p.alias("pos"))))
    picks = asked.select("graph_id", "query_id", F.posexplode(F.transform(order, lambda o: o["pos"])).alias("_j", "_pos"))
    return picks.join(placed, ["graph_id", "_pos"]).select("graph_id", "query_id", (F.col("_j") + 1).alias("rank"), "semantic_id")


PACK_STATE = "graph_id string, query_id long, passage_id long, pick int, total long, full boolean"


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """Greedy fold over one block of a query's shuffled passages."""
    head = rows.iloc[0]
    total, budget, picks = int(head["total"]), int(head["budget"]), int(head["picks"])
    full, out = False, []
    for row in rows.sort_values("j").itertuples():
        if total + row.n_tokens > budget:
            continue
        total += int(row.n_tokens)
        out.append((row.graph_id, row.query_id, row.passage_id, picks, total, False))
        picks += 1
        if total > budget * FULL_AT:
            full = True
            break
    out.append((head["graph_id"], head["query_id"], -1, picks, total, full))
    return pd.DataFrame(out, columns=[c.split()[0] for c in PACK_STATE.split(", ")])


def pack_context(
    queries: DataFrame, passages: DataFrame, *, seed: int = 0, block: int = 1024
) -> DataFrame:
    """Fill each query's token ``budget`` with passages in random order, skipping ones too long.

    ``queries(graph_id, query_id, budget)``, ``passages(graph_id, passage_id, n_tokens)``. Passages are
    walked in blocks of each query's own order; a query leaves the loop when it is 99 % full or has
    seen every passage, so only the blocks it needs are ever joined. Returns (graph_id, query_id,
    pick, passage_id).
    """
    placed = checkpointed(number_rows(passages, ["graph_id"], ["passage_id"], "_pos"))
    sizes = passages.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"))
    open_ = checkpointed(
        with_permutation(queries, sizes, seed)
        .withColumn("total", F.lit(0).cast("bigint")).withColumn("picks", F.lit(0)).where("budget > 0")
    )
    picked: DataFrame | None = None
    start = 0
    while not open_.isEmpty():
        lo = F.lit(start).cast("bigint")
        rows = open_.select(
            "graph_id", "query_id", "budget", "total", "picks",
            F.posexplode(_positions(lo, F.least(F.lit(block), F.col("_n") - lo))).alias("j", "_pos"),
        ).join(placed, ["graph_id", "_pos"])
        state = checkpointed(
            rows.select("graph_id", "query_id", "budget", "total", "picks", "j", "passage_id", "n_tokens")
            .groupBy("graph_id", "query_id").applyInPandas(_pack, PACK_STATE)
        )
        taken = state.where("passage_id >= 0").select("graph_id", "query_id", "pick", "passage_id")
        picked = taken if picked is None else picked.unionByName(taken)
        start += block
        after = state.where("passage_id < 0").select("graph_id", "query_id", F.col("total").alias("_t"), F.col("pick").alias("_p"), "full")
        open_ = checkpointed(
            open_.join(after, ["graph_id", "query_id"])
            .where(~F.col("full") & (F.col("_n") > start))
            .withColumn("total", F.col("_t")).withColumn("picks", F.col("_p")).drop("_t", "_p", "full")
        )
    if picked is None:
        return queries.select("graph_id", "query_id", F.lit(0).alias("pick"), F.lit(None).cast("bigint").alias("passage_id")).where("false")
    return picked
