"""Sliding windows with late rows kept, and a queue drained by a stream with retries, against plain Python."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from passbook.operators import store
from passbook.streaming import drain, statements

START = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def minutes(n):
    return START + dt.timedelta(minutes=n)


def test_sliding_stream_keeps_late_rows(spark, tmp_path):
    """Windows and late rows together are those of the whole input; closed windows do not change."""
    rng, source, path = random.Random(4), str(tmp_path / "in"), str(tmp_path / "out")
    batches, n = [], 0
    for b in range(5):
        rows = []
        for _ in range(80):
            late = rng.random() < 0.1
            rows.append((n, minutes(b * 200 + rng.randrange(200) - late * rng.randrange(600)), n % 7, rng.choice(["a", "b", None]), rng.choice([1.25, 2.0, None])))
            n += 1
        batches.append([*rows, (n, None, 1, "a", 1.0)])
        n += 1
    closed = None
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        statements.sliding_stream(stream, path, str(tmp_path / "cp"), late="1 hour", buckets=4).awaitTermination()
        now = {(r.event_type, r.window_start): (r.window_end, r.n, r.total) for r in statements.latest(spark, f"{path}/windows", statements.SLIDING).collect()}
        if closed is not None:
            assert all(now[k] == v for k, v in closed.items())
        mark = max(r[1] for x in batches[: batches.index(rows) + 1] for r in x if r[1]) - dt.timedelta(hours=1)
        closed = {k: v for k, v in now.items() if v[0] <= mark}
    kept = Counter({k: v[1] for k, v in now.items()})
    late = spark.read.parquet(f"{path}/late").collect()
    for r in late:
        assert r.missed_start <= r.ts < r.missed_end
        kept[r.event_type, r.missed_start] += 1
    whole = {(r.event_type, r.window_start): r.n for r in statements.sliding(spark.read.schema(EVENTS).parquet(source)).collect()}
    want, mark = set(), None
    for rows in batches:
        for r in rows:
            for k in range(4) if r[1] else ():
                begin = r[1].replace(minute=r[1].minute // 15 * 15, second=0) - dt.timedelta(minutes=15 * k)
                if mark and begin + dt.timedelta(hours=1) <= mark:
                    want.add((r[0], begin))
        mark = max([r[1] for r in rows if r[1]] + ([mark + dt.timedelta(hours=1)] if mark else [])) - dt.timedelta(hours=1)
    assert kept == whole and {(r.event_id, r.missed_start) for r in late} == want and want


def test_drain_stream(spark, tmp_path):
    """Attempts, growing waits, expiry and removal; a restart repeats nothing; one round is ``after_drain``."""
    source, out, calls = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "calls"
    calls.mkdir()
    needs = {"ok": 1, "third": 3, "never": 99}

    def fetch(merchants):
        found = []
        for m in merchants:
            n = len(list(calls.glob(f"{m}-*"))) + 1
            (calls / f"{m}-{n}").touch()
            if m == "raises":
                raise RuntimeError("no answer")
            found.append((f"page of {m}", True, None) if n >= needs[m] else (None, False, f"error {n}"))
        return found

    def put(*rows):
        spark.createDataFrame(list(rows), "merchant string, at timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("merchant string, at timestamp").parquet(source)
        found = drain.drain_stream(stream, fetch, attempts=4, wait="1 minute", expiry="1 hour")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return {(r.merchant, r.attempts): r for r in spark.read.schema(drain.OUTCOME).parquet(out).collect()}

    first = put(("ok", minutes(0)), ("third", minutes(0)), ("never", minutes(0)), ("raises", minutes(0)), ("third", minutes(0)), (None, minutes(0)), ("x", None))
    assert {k: r.status for k, r in first.items()} == {("ok", 1): "done", ("third", 1): "retry", ("never", 1): "retry", ("raises", 1): "retry"}
    assert first["ok", 1].payload == "page of ok" and first["raises", 1].error == "no answer"
    queue = spark.createDataFrame([(m, START, 0, None) for m in ("ok", "third", "never", "raises")], "merchant string, queued_at timestamp, attempts int, last_error string")
    results = spark.createDataFrame([(r.merchant, r.payload, r.status == "done", r.error) for r in first.values()], "merchant string, payload string, success boolean, error string")
    rows = lambda df: sorted(map(tuple, df.select("merchant", "queued_at", "attempts", "last_error").collect()))
    assert rows(drain.waiting(spark.read.schema(drain.OUTCOME).parquet(out))) == rows(store.after_drain(queue, results))
    for t in (2, 3, 10, 11, 30, 31):
        got = put((None, minutes(t)), ("third", minutes(t))) if t == 2 else put((None, minutes(t)))
    assert [got["third", k].status for k in (1, 2, 3)] == ["retry", "retry", "done"]
    assert [(got["never", k].at - START).seconds // 60 for k in (1, 2, 3, 4)] == [0, 1, 3, 7] and got["never", 4].status == "expired"
    assert len(list(calls.glob("*"))) == len(got) == spark.read.parquet(out).count() == 12
    assert drain.waiting(spark.read.schema(drain.OUTCOME).parquet(out)).count() == 0
