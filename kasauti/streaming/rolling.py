"""Hit rates of perturbations as verdicts arrive: the counts that a bandit's choices rest on, kept as state.

Each key has one value state (tries, hits) and, if ``idle`` is given, an event-time
timer: a key without news for so long is closed, with a row that says so, and starts
anew. Within a micro-batch events are taken in order of time and id. The state of a
key is two numbers, whatever the length of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The store that state with timers needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, ts timestamp, event_id long, tries long, hits long, rate double, closed boolean"


class RollingRate(StatefulProcessor):
    """From rows (key, ts, event_id, hit) to the rate after each of them."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "tries long, hits long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tries, hits, last = self.counts.get() if self.counts.exists() else (0, 0, None)
        told = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable").reset_index(drop=True)
        at = told["ts"].astype("datetime64[ms]").astype("int64")
        # A silence of ``idle`` ends a count wherever the stream is cut into batches.
        silence = at - at.shift(fill_value=int(at[0]) if last is None else last)
        spell = (silence >= self.idle_ms).cumsum() if self.idle_ms is not None else silence * 0
        for _, own in told.groupby(spell):
            first = own.index[0]
            if tries and self.idle_ms is not None and silence[first] >= self.idle_ms:
                yield self._closed(key, tries, hits, last)
                tries, hits = 0, 0
            n = tries + pd.Series(range(1, len(own) + 1), index=own.index)
            h = hits + own["hit"].astype("int64").cumsum()
            tries, hits, last = int(n.iloc[-1]), int(h.iloc[-1]), max(int(at[own.index].max()), -1 if last is None else last)
            yield pd.DataFrame({"key": key[0], "ts": own["ts"], "event_id": own["event_id"], "tries": n, "hits": h, "rate": h / n, "closed": False})
        self.counts.update((tries, hits, last))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.idle_ms)

    @staticmethod
    def _closed(key, tries: int, hits: int, last: int) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "ts": [pd.Timestamp(last, unit="ms")], "event_id": pd.array([None], "Int64"), "tries": [tries], "hits": [hits], "rate": [hits / tries], "closed": [True]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.counts.exists():
            return
        tries, hits, last = self.counts.get()
        self.counts.clear()
        yield self._closed(key, tries, hits, last)

    def close(self) -> None:
        pass


def rolling_rates(events: DataFrame, late: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """key, ts, event_id, tries, hits, rate and closed: the rate after each event of a stream of (key, ts, event_id, hit)."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    seen = events.select(F.col("key").cast("string").alias("key"), "ts", "event_id", "hit").withWatermark("ts", late)
    return seen.groupBy("key").transformWithStateInPandas(RollingRate(idle_ms), outputStructType=OUT, outputMode="Append", timeMode="EventTime" if idle_ms is not None else "None")


def prefix_rates(events: DataFrame) -> DataFrame:
    """The same of a table, by a window over each key's events; for tables that fit this, as one key's events are sorted in one task."""
    from pyspark.sql.window import Window

    upto = Window.partitionBy("key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    tries, hits = F.count(F.lit(1)).over(upto), F.count_if("hit").over(upto)
    return events.select(F.col("key").cast("string").alias("key"), "ts", "event_id", tries.alias("tries"), hits.alias("hits"), (hits / tries).alias("rate"), F.lit(False).alias("closed"))
