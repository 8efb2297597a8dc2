"""A queue of merchants that is drained by a stream: state per merchant, timers for the next attempt.

Time is event time. A row (merchant, at) queues a merchant; a row without a merchant only moves the clock, so a source
that sends one now and then keeps retries going when nothing new is queued.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTCOME = "merchant string, queued_at timestamp, at timestamp, attempts int, status string, payload string, error string"
STATE = "queued_at long, due long, attempts int"


def drain_stream(queued: DataFrame, fetch: Callable, *, attempts: int = 5, wait: str = "1 minute", expiry: str = "1 day", late: str = "0 seconds") -> DataFrame:
    """``OUTCOME`` rows, one for each attempt, of a stream (merchant, at); append mode.

    A merchant is tried when it comes and, while ``fetch`` (see ``store.drained``) fails, again after ``wait``, twice that,
    four times that and so on. Status is ``done`` (its state is gone), ``retry``, or ``expired`` where ``attempts`` are used
    up or the next one would come more than ``expiry`` after it was queued. A merchant that is queued again while it waits
    keeps its place, its attempts and its timer; one that is done or expired starts anew. An error that ``fetch`` raises
    is a failed attempt. State and timers are in the checkpoint: a restart repeats no attempt of a batch that was finished.
    """
    seconds = lambda text: int(queued.sparkSession.range(1).select(F.unix_seconds(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {text}"))).first()[0])
    first_wait, longest = seconds(wait) * 1000, seconds(expiry) * 1000

    def step(key, frames, state: GroupState):
        import pandas as pd

        stamp = lambda ms: pd.Timestamp(ms, unit="ms")
        merchant = key[0]
        at = [x for f in frames for x in f["ms"].tolist()]  # of one merchant and batch: numbers only
        if state.hasTimedOut:
            queued_at, now, used = state.get
        elif merchant is None or state.exists:  # the clock moves, or it waits already
            if state.exists:
                state.setTimeoutTimestamp(max(state.get[1], state.getCurrentWatermarkMs() + 1))
            return
        else:
            queued_at = now = min(at)
            used = 0
        try:
            payload, success, error = fetch([merchant])[0]
        except Exception as e:  # noqa: BLE001
            payload, success, error = None, False, str(e)
        used += 1
        due = now + first_wait * 2 ** (used - 1)
        status = "done" if success else "expired" if used >= attempts or due - queued_at > longest else "retry"
        if status == "retry":
            state.update((queued_at, due, used))
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"merchant": [merchant], "queued_at": [stamp(queued_at)], "at": [stamp(now)], "attempts": [used], "status": [status], "payload": [payload if success else None], "error": [None if success else error]})

    rows = queued.where("at IS NOT NULL").select("merchant", "at", F.unix_millis("at").alias("ms")).withWatermark("at", late)
    return rows.groupBy("merchant").applyInPandasWithState(step, OUTCOME, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def waiting(outcomes: DataFrame) -> DataFrame:
    """The queue (merchant, queued_at, attempts, last_error) after the outcomes: merchants whose last attempt asks for another."""
    newest = Window.partitionBy("merchant").orderBy(F.desc("queued_at"), F.desc("attempts"))
    last = outcomes.withColumn("n", F.row_number().over(newest)).where("n = 1 AND status = 'retry'")
    return last.select("merchant", "queued_at", "attempts", F.col("error").alias("last_error"))
