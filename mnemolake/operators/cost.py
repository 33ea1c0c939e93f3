"""Token and cost analytics over usage records.

``usage(trajectory_id, system, scope, phase, model, input_tokens, output_tokens, extra, …)`` where
``system`` reads ``X@R=n``: system X after n retrievals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.functions import text as tx

# Dollars per million tokens of an unlisted model, scope names.
DEFAULT_PRICE = (1.0, 3.0)
EXPOSED = "EXPOSED"
EVALUATION = "EVAL"
JUDGE_PHASE = "judge_score"


def with_cost(usage: DataFrame, prices: DataFrame, default: tuple[float, float] = DEFAULT_PRICE) -> DataFrame:
    """Add ``usd``: listed price of the model, else the default price."""
    listed = prices.select("model", F.col("input").alias("_in"), F.col("output").alias("_out"))
    price_in, price_out = F.coalesce("_in", F.lit(default[0])), F.coalesce("_out", F.lit(default[1]))
    return (
        usage.join(listed, "model", "left")
        .withColumn("usd", tx.usd(F.col("input_tokens"), F.col("output_tokens"), price_in, price_out))
        .drop("_in", "_out")
    )


def _labelled(usage: DataFrame) -> DataFrame:
    letter, rounds = tx.split_system(F.col("system"))
    return usage.withColumn("letter", letter).withColumn("rounds", rounds).where(F.col("rounds") >= 0)


def cost_cells(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and dollars per (system, rounds, scope), averaged over distinct trajectories."""
    rows = _labelled(with_cost(usage.where(F.col("scope") != EVALUATION), prices))
    cell = ["letter", "rounds", "scope"]
    # sums per trajectory first: the distinct count then needs no second shuffle of raw records
    per = rows.groupBy(*cell, "trajectory_id").agg(
        F.sum("input_tokens").alias("_in"), F.sum("output_tokens").alias("_out"), F.sum("usd").alias("_usd")
    )
    n = F.count(F.lit(1))
    return per.groupBy(*cell).agg(
        n.alias("n_trajectories"),
        (F.sum("_in") / n).alias("tokens_in"),
        (F.sum("_out") / n).alias("tokens_out"),
        (F.sum("_usd") / n).alias("usd"),
    )


def quality_cells(usage: DataFrame) -> DataFrame:
    """Mean judge score and count per (system, rounds); unreadable scores (< 0) left out."""
    judged = (F.col("scope") == EVALUATION) & (F.col("phase") == JUDGE_PHASE) & (F.col("extra.judge_score") >= 0)
    return _labelled(usage.where(judged)).groupBy("letter", "rounds").agg(
        F.avg("extra.judge_score").alias("mean_score"), F.count(F.lit(1)).alias("n")
    )


def cost_curves(cells: DataFrame) -> DataFrame:
    """Tokens and dollars by rounds for every (system, scope) and for all scopes together."""
    tokens = F.col("tokens_in") + F.col("tokens_out")
    return (
        cells.withColumn("tokens", tokens)
        .groupingSets(
            [[F.col("letter"), F.col("rounds"), F.col("scope")], [F.col("letter"), F.col("rounds")]],
            F.col("letter"), F.col("rounds"), F.col("scope"),
        )
        .agg(F.sum("tokens").alias("tokens"), F.sum("usd").alias("usd"))
        .withColumn("scope", F.coalesce("scope", F.lit("all")))
    )


def crossover(curves: DataFrame, baseline: str = "A") -> DataFrame:
    """Least rounds at which a system costs no more than the baseline, per scope; null if never."""
    base = curves.where(F.col("letter") == baseline).select(
        "rounds", "scope", F.col("tokens").alias("_tokens"), F.col("usd").alias("_usd")
    )
    rows = curves.where(F.col("letter") != baseline).join(base, ["rounds", "scope"], "left")
    return rows.groupBy("letter", "scope").agg(
        F.min(F.when(F.col("tokens") <= F.col("_tokens"), F.col("rounds"))).alias("tokens_rounds"),
        F.min(F.when(F.col("usd") <= F.col("_usd"), F.col("rounds"))).alias("usd_rounds"),
    )


def reduction_ratio(cells: DataFrame, baseline: str = "A") -> DataFrame:
    """Exposed tokens of the baseline over each system's, at the largest round count (infinite over 0)."""
    last = cells.agg(F.max("rounds")).scalar()
    mine = F.sum(
        F.when((F.col("scope") == EXPOSED) & (F.col("rounds") == last), F.col("tokens_in") + F.col("tokens_out")).otherwise(0.0)
    )
    exposed = cells.groupBy("letter").agg(mine.alias("_tokens"))
    base = exposed.where(F.col("letter") == baseline).agg(F.coalesce(F.max("_tokens"), F.lit(0.0))).scalar()
    ratio = F.when(F.col("_tokens") == 0, F.lit(float("inf"))).otherwise(base / F.col("_tokens"))
    return exposed.where(F.col("letter") != baseline).select("letter", last.alias("rounds"), ratio.alias("ratio"))


def quality_retention(quality: DataFrame, baseline: str = "A") -> DataFrame:
    """Mean score minus the baseline's at the same rounds (null for the baseline itself)."""
    base = quality.where(F.col("letter") == baseline).select("rounds", F.col("mean_score").alias("_base"))
    change = F.when(F.col("letter") != baseline, F.col("mean_score") - F.col("_base"))
    return quality.join(base, "rounds", "left").select("letter", "rounds", "mean_score", "n", change.alias("retention"))


def report_rows(cells: DataFrame) -> DataFrame:
    """Cost cells as display text."""
    return cells.select(
        "letter", "rounds", "scope",
        F.format_number("tokens_in", 0).alias("tokens_in"),
        F.format_number("tokens_out", 0).alias("tokens_out"),
        F.format_string("$%.4f", "usd").alias("usd"),
    )


def crossover_text(rounds: Column) -> Column:
    return F.coalesce(rounds.cast("string"), F.lit("never"))


def query_prefixes(queries: DataFrame, sizes: Sequence[int], position: str = "position") -> DataFrame:
    """For every R in ``sizes`` the first R queries of each trajectory (position from 0)."""
    wanted = F.array(*[F.lit(r) for r in sorted(set(sizes))])
    return queries.withColumn("rounds", F.explode(F.filter(wanted, lambda r: r > F.col(position))))


def provider_usage(calls: DataFrame) -> DataFrame:
    """Calls and tokens per model."""
    return calls.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )
