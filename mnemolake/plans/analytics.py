"""Registered cost and answer-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import text as tx
from mnemolake.operators import cost, evaluate
from mnemolake.plans import bindings as b
from mnemolake.plans.bindings import with_bindings
from mnemolake.plans.registry import query

_CELLS = """cells AS (
  SELECT letter, rounds, scope, count(DISTINCT trajectory_id) AS n_trajectories,
         sum(input_tokens) / count(DISTINCT trajectory_id) AS tokens_in, sum(output_tokens) / count(DISTINCT trajectory_id) AS tokens_out,
         sum(usd) / count(DISTINCT trajectory_id) AS usd
  FROM priced WHERE scope <> 'EVAL' GROUP BY letter, rounds, scope),
quality AS (
  SELECT letter, rounds, avg(judge_score) AS mean_score, count(*) AS n FROM usage WHERE scope = 'EVAL' AND judge_score >= 0 GROUP BY letter, rounds),
curves AS (
  SELECT letter, rounds, coalesce(scope, 'all') AS scope, sum(tokens_in + tokens_out) AS tokens, sum(usd) AS usd
  FROM cells GROUP BY GROUPING SETS ((letter, rounds, scope), (letter, rounds)))"""


def _cells(spark, d) -> DataFrame:
    return cost.cost_cells(b.usage(spark, d), b.prices(spark, d))


@query("cost_cells", with_bindings("""
SELECT letter, rounds::INTEGER AS rounds, scope, n_trajectories, round(tokens_in, 4) AS tokens_in, round(tokens_out, 4) AS tokens_out, round(usd, 6) AS usd FROM cells""", _CELLS))
def cost_cells(spark, d) -> DataFrame:
    return _cells(spark, d).select("letter", "rounds", "scope", "n_trajectories", F.round("tokens_in", 4).alias("tokens_in"), F.round("tokens_out", 4).alias("tokens_out"), F.round("usd", 6).alias("usd"))


@query("quality_cells", with_bindings("SELECT letter, rounds::INTEGER AS rounds, round(mean_score, 6) AS mean_score, n FROM quality", _CELLS))
def quality_cells(spark, d) -> DataFrame:
    return cost.quality_cells(b.usage(spark, d)).select("letter", "rounds", F.round("mean_score", 6).alias("mean_score"), "n")


@query("cost_curve", with_bindings("SELECT letter, rounds::INTEGER AS rounds, scope, round(tokens, 4) AS tokens, round(usd, 6) AS usd FROM curves", _CELLS))
def cost_curve(spark, d) -> DataFrame:
    return cost.cost_curves(_cells(spark, d)).select("letter", "rounds", "scope", F.round("tokens", 4).alias("tokens"), F.round("usd", 6).alias("usd"))


@query("crossover", with_bindings("""
SELECT c.letter, c.scope, min(c.rounds) FILTER (c.tokens <= a.tokens)::INTEGER AS tokens_rounds, min(c.rounds) FILTER (c.usd <= a.usd)::INTEGER AS usd_rounds
FROM curves c LEFT JOIN curves a ON a.letter = 'A' AND a.rounds = c.rounds AND a.scope = c.scope WHERE c.letter <> 'A' GROUP BY c.letter, c.scope""", _CELLS))
def crossover(spark, d) -> DataFrame:
    return cost.crossover(cost.cost_curves(_cells(spark, d)))


@query("reduction_ratio", with_bindings("""
WITH last AS (SELECT max(rounds) AS r FROM cells),
exposed AS (SELECT c.letter, coalesce(sum(CASE WHEN rounds = r AND scope = 'EXPOSED' THEN tokens_in + tokens_out END), 0) AS t FROM cells c, last GROUP BY c.letter)
SELECT e.letter, r::INTEGER AS rounds, round(CASE WHEN e.t = 0 THEN 'inf'::DOUBLE ELSE a.t / e.t END, 6) AS ratio
FROM exposed e, exposed a, last WHERE a.letter = 'A' AND e.letter <> 'A'""", _CELLS))
def reduction_ratio(spark, d) -> DataFrame:
    return cost.reduction_ratio(_cells(spark, d)).select("letter", "rounds", F.round("ratio", 6).alias("ratio"))


@query("quality_retention", with_bindings("""
SELECT q.letter, q.rounds::INTEGER AS rounds, round(CASE WHEN q.letter <> 'A' THEN q.mean_score - a.mean_score END, 6) AS retention, q.n
FROM quality q LEFT JOIN quality a ON a.letter = 'A' AND a.rounds = q.rounds""", _CELLS))
def quality_retention(spark, d) -> DataFrame:
    return cost.quality_retention(cost.quality_cells(b.usage(spark, d))).select("letter", "rounds", F.round("retention", 6).alias("retention"), "n")


@query("cost_report", with_bindings("""
SELECT letter, rounds::INTEGER AS rounds, scope, format('{:,}', round_even(tokens_in, 0)::BIGINT) AS tokens_in,
       format('{:,}', round_even(tokens_out, 0)::BIGINT) AS tokens_out FROM cells""", _CELLS))
def cost_report(spark, d) -> DataFrame:
    return cost.report_rows(_cells(spark, d)).select("letter", "rounds", "scope", "tokens_in", "tokens_out")


@query("provider_usage", with_bindings("SELECT model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM usage GROUP BY model"))
def provider_usage(spark, d) -> DataFrame:
    return cost.provider_usage(b.usage(spark, d))


@query("price_lookup", with_bindings("SELECT model, round(sum(usd), 6) AS usd FROM priced GROUP BY model"))
def price_lookup(spark, d) -> DataFrame:
    return cost.with_cost(b.usage(spark, d), b.prices(spark, d)).groupBy("model").agg(F.round(F.sum("usd"), 6).alias("usd"))


@query("query_prefixes", """
SELECT conv_id, turn, rounds::INTEGER AS rounds FROM (SELECT conv_id, turn, unnest([1, 3, 5]) AS rounds FROM conversations) WHERE turn < rounds""")
def query_prefixes(spark, d) -> DataFrame:
    """First R turns of every conversation for each R."""
    return cost.query_prefixes(b.table(spark, d, "conversations").select("conv_id", "turn"), (1, 3, 5), "turn")


@query("token_estimate", "SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def token_estimate(spark, d) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("message_tokens", "SELECT doc_id, greatest(1, length(source) // 4) + greatest(1, length(text) // 4) AS tokens FROM documents")
def message_tokens(spark, d) -> DataFrame:
    """A document and its source as the two messages of one prompt."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("content"))
    return b.table(spark, d, "documents").select("doc_id", tx.message_tokens(F.array(message("system", "source"), message("user", "text"))).alias("tokens"))


# --- answers ---

_NORMAL = (
    "array_to_string(list_filter(string_split_regex(regexp_replace(lower({c}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'),"
    " lambda t: t NOT IN ('a', 'an', 'the', '')), ' ')"
)

_ANSWERS = f"""answers AS (
  SELECT d.doc_id, d.lang, d.text AS pred, i.text AS gold FROM documents d
  JOIN benchmark i ON i.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
normal AS MATERIALIZED (
  SELECT doc_id, lang, {_NORMAL.format(c='pred')} AS p, {_NORMAL.format(c='gold')} AS g FROM answers),
counted AS (
  SELECT doc_id, list_histogram(pw) AS pc, list_histogram(gw) AS gc, len(pw) AS p, len(gw) AS g FROM (
    SELECT doc_id, list_filter(string_split(p, ' '), lambda t: t <> '') AS pw, list_filter(string_split(g, ' '), lambda t: t <> '') AS gw FROM normal)),
overlap AS (
  SELECT doc_id, coalesce(list_sum(list_transform(map_keys(gc), lambda t: least(gc[t], coalesce(pc[t], 0)))), 0)::DOUBLE AS same, p::DOUBLE AS p, g::DOUBLE AS g FROM counted),
scored AS (
  SELECT n.doc_id, n.lang, CASE WHEN n.p = n.g THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em,
         CASE WHEN o.same > 0 THEN 2 * (o.same / o.p) * (o.same / o.g) / (o.same / o.p + o.same / o.g) ELSE 0.0::DOUBLE END AS f1
  FROM normal n LEFT JOIN overlap o ON o.doc_id = n.doc_id)"""


def _answers(spark, d) -> DataFrame:
    """Every document as the answer to one benchmark item, taken in turn."""
    items = b.table(spark, d, "benchmark").select(F.col("item_id"), F.col("text").alias("gold"))
    n = items.agg(F.count(F.lit(1))).scalar()
    docs = b.table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("pred"))
    return docs.withColumn("item_id", F.col("doc_id") % n).join(items, "item_id")


@query("em_f1", with_bindings("SELECT doc_id, em, round(f1, 6) AS f1 FROM scored", _ANSWERS))
def em_f1(spark, d) -> DataFrame:
    return evaluate.em_f1(_answers(spark, d), "doc_id").select("doc_id", "em", F.round("f1", 6).alias("f1"))


@query("score_summary", with_bindings("SELECT lang, count(*) AS n, round(avg(em), 6) AS em, round(avg(f1), 6) AS f1 FROM scored GROUP BY lang", _ANSWERS))
def score_summary(spark, d) -> DataFrame:
    langs = b.table(spark, d, "documents").select("doc_id", "lang")
    rows = evaluate.score_summary(evaluate.em_f1(_answers(spark, d), "doc_id").join(langs, "doc_id"), "lang")
    return rows.select("lang", "n", F.round("em", 6).alias("em"), F.round("f1", 6).alias("f1"))


@query("gold_context", """
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS s, n_chars FROM documents)
SELECT doc_id AS id, CASE WHEN len(s) > 1 THEN s[1] || chr(10) || s[2] || chr(10) || s[1] ELSE s[1] || chr(10) || s[1] END AS gold_context FROM parts""")
def gold_context(spark, d) -> DataFrame:
    """A document's lines as two passages; supporting lines repeat, are unordered and run out of range."""
    sents = F.split("text", "\n")
    passage = lambda title: F.struct(F.lit(title).alias("title"), sents.alias("sents"))
    fact = lambda title, i: F.struct(F.lit(title).alias("title"), F.lit(i).alias("idx"))
    items = b.table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.array(passage("one"), passage("other"), passage("two")).alias("context"),
        F.array(fact("two", 0), fact("one", 1), fact("one", 0), fact("one", 1), fact("one", 100000), fact("two", -1)).alias("supporting_facts"),
    )
    return evaluate.gold_sentences(items)


@query("gold_paragraphs", """
SELECT doc_id AS id, CASE WHEN n_chars % 2 = 0 THEN 'T' || chr(10) || source || chr(10) || lang ELSE 'T' || chr(10) || text END AS gold_context FROM documents""")
def gold_paragraphs(spark, d) -> DataFrame:
    """Marked paragraphs for even text lengths, the decomposition's index otherwise."""
    even = F.col("n_chars") % 2 == 0

    def paragraph(i: int, title: str, text: str, marked) -> F.Column:
        return F.struct(F.lit(i).alias("idx"), F.lit(title).alias("title"), F.col(text).alias("paragraph_text"), marked.alias("is_supporting"))

    items = b.table(spark, d, "documents").select(
        F.col("doc_id").alias("id"),
        F.array(paragraph(7, "", "lang", even), paragraph(3, "T", "source", even), paragraph(5, "T", "text", F.lit(False))).alias("paragraphs"),
        F.array(F.struct(F.lit(5).alias("paragraph_support_idx")), F.struct(F.lit(99).alias("paragraph_support_idx"))).alias("question_decomposition"),
    )
    return evaluate.gold_paragraphs(items, include_title=True)


@query("success_rate", """
SELECT event_type, count(*) AS total_tasks, count(*) FILTER (value > 50 OR event_id % 7 = 0) AS successful_tasks,
       count(*) FILTER (NOT (value > 50 OR event_id % 7 = 0)) AS failed_tasks,
       round(100 * avg(CASE WHEN value > 50 OR event_id % 7 = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS success_rate FROM events GROUP BY event_type""")
def success_rate(spark, d) -> DataFrame:
    rows = b.table(spark, d, "events").select(
        "event_type", (F.col("value") - 50).alias("reward"), F.when(F.col("event_id") % 7 == 0, 1.0).otherwise(0.0).alias("success")
    )
    return evaluate.task_success(rows, "event_type").withColumn("success_rate", F.round("success_rate", 6))
