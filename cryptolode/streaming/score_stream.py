"""Score events on a stream of scans (an extension): when a finding was first seen, changed its score, and went away.

Sightings wait in the state of their fingerprint until the watermark has passed them, so events don't depend on the order
of arrival within the delay, nor on how the stream is cut into batches. Each fingerprint has one timer: the next sighting
that waits, or the time by which it is given up. A fingerprint that isn't seen for longer than the patience is resolved,
and created again when it comes back. `lifecycle.score_history` gives the same rows from a table.

State holds one value for each fingerprint that is open or waits, with a time and a score for each of its scans that the
watermark hasn't passed; resolved ones are forgotten. However often a scan repeats a fingerprint, that is one entry: rows
stream through the task of their fingerprint and aren't held.

Defined results: of several scores of a fingerprint at one time the largest counts, nulls and NaN only where there is no
other; rows without fingerprint or time take no part; times count in milliseconds; no sightings, no events; columns other
than fingerprint, score and the time are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isnan

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EVENTS = "fingerprint string, at_ms long, event string, old_score double, new_score double"
STORE = "spark.sql.streaming.stateStore.providerClass"


class ScoreEvents(StatefulProcessor):
    """One fingerprint: its last sighting and score if it is open, the sightings yet to be passed, and its timer, all in one
    value, so that a batch reads and writes the state of a fingerprint once."""

    def __init__(self, patience_ms: int) -> None:
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sightings", "seen long, score double, timer long, waiting array<long>, scores array<double>")

    def _load(self) -> tuple[tuple | None, dict, int | None]:
        seen, score, timer, waiting, scores = self.state.get() or (None, None, None, [], [])
        return None if seen is None else (seen, score), dict(zip(waiting, scores, strict=True)), timer

    def _store(self, current: tuple | None, waiting: dict, timer: int | None) -> None:
        due = min([*waiting, *([current[0] + self.patience_ms] if current else [])], default=None)
        if due is None:
            self.state.clear()
            return
        if timer != due + 1:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due + 1)
        self.state.update((*(current or (None, None)), due + 1, list(waiting), list(waiting.values())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        current, waiting, timer = self._load()
        for part in rows:
            for at, score in zip(part["at_ms"].tolist(), part["score"].tolist(), strict=True):
                new = None if score is None or isnan(score) else score
                old = waiting.get(at)
                waiting[at] = new if old is None or (new is not None and new > old) else old
        self._store(current, waiting, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        current, waiting, _ = self._load()
        events = []
        for at in sorted(at for at in waiting if at < now):
            score = waiting.pop(at)
            if current and at > current[0] + self.patience_ms:
                events.append((key[0], current[0] + self.patience_ms, "resolved", current[1], None))
                current = None
            if not current:
                events.append((key[0], at, "created", None, score))
            elif current[1] != score:
                events.append((key[0], at, "updated", current[1], score))
            current = (at, score)
        if current and current[0] + self.patience_ms < now:
            events.append((key[0], current[0] + self.patience_ms, "resolved", current[1], None))
            current = None
        self._store(current, waiting, None)  # Spark takes the timer away that has fired
        if events:
            found = pd.DataFrame(events, columns=["fingerprint", "at_ms", "event", "old_score", "new_score"])
            yield found.astype({"old_score": "float64", "new_score": "float64"})

    def close(self) -> None:
        pass


def score_events(sightings: DataFrame, patience_ms: int, delay: str, at: str = "scanned_at") -> DataFrame:
    """Events (fingerprint, at, event, old_score, new_score) of a stream of sightings (fingerprint, score, and the scan's time)."""
    own = sightings.where(F.col(at).isNotNull() & F.col("fingerprint").isNotNull())
    own = own.select("fingerprint", F.nanvl(F.col("score").cast("double"), F.lit(None)).alias("score"), F.col(at).alias("at"), F.unix_millis(at).alias("at_ms"))
    found = own.withWatermark("at", delay).groupBy("fingerprint").transformWithStateInPandas(ScoreEvents(patience_ms), EVENTS, "Append", "EventTime")
    return found.select("fingerprint", F.timestamp_millis("at_ms").alias("at"), "event", "old_score", "new_score")


def write_available(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start to write the events of all that has arrived, as Parquet, exactly once; a later call goes on from the checkpoint.

    Timers need the RocksDB store, which is set for this query alone.
    """
    conf = events.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = events.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        return out.outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.unset(STORE) if before is None else conf.set(STORE, before)
