"""Incremental jobs: session capture, graph insert, recall audit, usage totals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemolake.functions import text as tx
from mnemolake.operators.cost import with_cost

STEP = "session_id string, step long, observation string, action string"


#: Pending observation, finished steps, next ``ord`` to take, and messages that came before their turn.
PENDING = "observation string, step long, next_ord long, early array<struct<ord:long,part:string,line:string>>"


def _pair_turns(idle_ms: int | None) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """State per session. A message is taken when all before it were; earlier arrivals wait in the state.

    ``ord`` numbers a session's messages from 0 without gaps; a number seen before is a repeat. A session idle past
    ``idle_ms`` takes what waits, in order, gaps or not, and forgets its unanswered tail.
    """

    def pair(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, step, following, early = state.get if state.exists else (None, 0, 0, [])
        waiting = {int(m[0]): (m[1], m[2]) for m in early or []}
        timed_out = state.hasTimedOut
        if not timed_out:
            for batch in rows:
                for o, part, line in zip(batch["ord"].tolist(), batch["part"].tolist(), batch["line"].tolist()):
                    if o >= following:
                        waiting.setdefault(int(o), (part, line))
        out = []
        while waiting:
            if following not in waiting:
                if not timed_out:
                    break
                following = min(waiting)
            part, line = waiting.pop(following)
            following += 1
            if part == "observation":
                pending = line if pending is None else f"{pending}\n{line}"
            elif part == "action" and pending is not None:
                out.append((key[0], step, pending, line))
                pending, step = None, step + 1
        state.update((None if timed_out else pending, step, following, [(o, *m) for o, m in sorted(waiting.items())]))
        if idle_ms is not None and not timed_out:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["session_id", "step", "observation", "action"])

    return pair


def stream_steps(lines: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Streaming ``messages_to_steps``: flattened message lines in, finished steps out.

    ``lines`` has one row per message, silent ones (no ``part``) included, and messages may arrive in any order.
    ``idle_ms`` needs a continuously running trigger: a run-until-empty trigger would wait for ever.
    """
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    rows = lines.select("session_id", F.col("ord").cast("bigint").alias("ord"), "part", "line")
    return rows.groupBy("session_id").applyInPandasWithState(
        _pair_turns(idle_ms), STEP, PENDING, "append", timeout
    )


def stream_inserts(
    source: DataFrame, insert: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Run the batch insert on every micro-batch.

    ``insert(rows, batch_id)`` should build on ``MemoryStore.begin_batch(batch_id, stream)``, with a ``stream`` name
    that goes with ``checkpoint``: a batch tried again then gives its rows the ids it gave them before, and adds
    nothing twice.
    """
    writer = source.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def audit_windows(audit: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Recalls per window, endpoint and mode; repeats of a recall within the lateness count once."""
    rows = audit.withWatermark("ts", late)
    if audit.isStreaming:
        rows = rows.dropDuplicatesWithinWatermark(["graph_id", "recall_id"])
    else:
        rows = rows.dropDuplicates(["graph_id", "recall_id"])
    return (
        rows.groupBy(F.window("ts", size), "endpoint", "mode")
        .agg(F.count(F.lit(1)).alias("n_recalls"), F.sum("n_messages").alias("n_messages"))
        .select(F.col("window.start").alias("window_start"), "endpoint", "mode", "n_recalls", "n_messages")
    )


def usage_windows(usage: DataFrame, prices: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tokens and dollars per window, system and scope."""
    letter, rounds = tx.split_system(F.col("system"))
    rows = with_cost(usage, prices).withColumn("letter", letter).withColumn("rounds", rounds).withWatermark("ts", late)
    return (
        rows.groupBy(F.window("ts", size), "letter", "rounds", "scope")
        .agg(F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"), F.sum("usd").alias("usd"))
        .select(F.col("window.start").alias("window_start"), "letter", "rounds", "scope", "tokens_in", "tokens_out", "usd")
    )


def latest_windows(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Run a windowed aggregate over everything available; the last state of every window, open ones included.

    Each micro-batch writes the windows it changed to a folder of its own, over what a failed try left there.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/{batch_id}")

    running = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    spark = stream.sparkSession
    values = [c for c in stream.columns if c not in keys]
    written = spark.read.schema(f"{stream.select(*keys, *values).schema.simpleString()[7:-1].replace(':', ' ')}, batch_id int").parquet(f"{folder}/out/*")
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in values])
