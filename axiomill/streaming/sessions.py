"""Sessions of keys in a stream, kept as state with a timer: spans of events of which none is further than a gap from the next."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

ROWS = "key string, version long, closed boolean, start long, end long, n long"


def _merged(spans: list[list[int]], gap: int) -> list[list[int]]:
    """Spans (start, end, n) by start, those within the gap of each other made one."""
    out: list[list[int]] = []
    for s, e, n in sorted(spans):
        if out and s - out[-1][1] <= gap:
            out[-1][1], out[-1][2] = max(out[-1][1], e), out[-1][2] + n
        else:
            out.append([s, e, n])
    return out


def session_updates(stream: DataFrame, key: str, time: str, gap_ms: int, late: str) -> DataFrame:
    """(key, version, closed, start, end, n) in milliseconds: what becomes of the sessions of each key as events come in, in any order.

    A key's open sessions are its state. Whenever they change they are told anew with a higher version; once the watermark, `late` behind
    the newest event, has passed a session's end by the gap it can't change any more: it is told as closed and leaves the state. A key without open sessions leaves too.
    Events later than that are dropped by the watermark. See session_rows for the table that this comes to. Null keys or times are left out.
    """
    events = stream.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("at")).where("key is not null and at is not null").withWatermark("at", late)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spans = json.loads(state.get[0]) if state.exists else []
        for pdf in batches:
            ms = pdf["ms"].to_numpy()
            spans = _merged(spans + [[int(t), int(t), 1] for t in ms], gap_ms)
        now = state.getCurrentWatermarkMs()
        done = [s for s in spans if s[1] + gap_ms < now]
        spans = [s for s in spans if s[1] + gap_ms >= now]
        version = state.getCurrentProcessingTimeMs()
        if spans:
            state.update((json.dumps(spans),))
            state.setTimeoutTimestamp(max(min(s[1] for s in spans) + gap_ms, now) + 1)
        elif state.exists:
            state.remove()
        told = [(key[0], version, True, *s) for s in done] + [(key[0], version, False, *s) for s in spans or [[0, 0, 0]]]
        yield pd.DataFrame(told, columns=["key", "version", "closed", "start", "end", "n"])

    rows = events.withColumn("ms", F.unix_millis("at")).groupBy("key")
    return rows.applyInPandasWithState(update, ROWS, "spans string", "append", GroupStateTimeout.EventTimeTimeout)


def session_rows(updates: DataFrame) -> DataFrame:
    """(key, start, end, n): the closed sessions and those of each key's latest version, from the table that a stream of session_updates has written."""
    last = updates.where("not closed").withColumn("newest", F.max("version").over(Window.partitionBy("key"))).where("version = newest and n > 0")
    return updates.where("closed").select("key", "start", "end", "n").union(last.select("key", "start", "end", "n"))


def batch_sessions(events: DataFrame, key: str, time: str, gap_ms: int) -> DataFrame:
    """The same table from all events at once."""
    at = events.select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col(time).cast("timestamp")).alias("ms")).where("key is not null and ms is not null")
    w = Window.partitionBy("key").orderBy("ms")
    first = at.withColumn("new", F.coalesce(F.col("ms") - F.lag("ms").over(w) > gap_ms, F.lit(True)).cast("int"))
    runs = first.withColumn("run", F.sum("new").over(w))
    return runs.groupBy("key", "run").agg(F.min("ms").alias("start"), F.max("ms").alias("end"), F.count(F.lit(1)).alias("n")).drop("run")
