"""Score events of a stream against the same events of a table, and against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cryptolode.operators import lifecycle
from cryptolode.streaming import score_stream

HOUR = 3_600_000
START = dt.datetime(2024, 1, 1)
SCHEMA = "scanned_at timestamp, fingerprint string, score double, at string, event long"


def by_hand(rows, patience, until):
    """Events of rows (hour, fingerprint, score), hours and patience as numbers."""
    scans = {}
    for at, mark, score in rows:
        if mark is not None and at is not None and at < until:
            scans.setdefault(mark, {}).setdefault(at, []).append(score)
    out = set()
    for mark, times in scans.items():
        seen, old = None, None
        for at in sorted(times):
            score = max((s for s in times[at] if s is not None), default=None)
            if seen is not None and at > seen + patience:
                out.add((mark, seen + patience, "resolved", old, None))
                seen = None
            if seen is None:
                out.add((mark, at, "created", None, score))
            elif score != old:
                out.add((mark, at, "updated", old, score))
            seen, old = at, score
        if seen + patience < until:
            out.add((mark, seen + patience, "resolved", old, None))
    return out


def sightings(spark, rows):
    return spark.createDataFrame([(None if h is None else START + dt.timedelta(hours=h), m, s, "x", 1) for h, m, s in rows], SCHEMA)


def events(df):
    got = [(r.fingerprint, (r["at"] - START).total_seconds() / 3600, r.event, r.old_score, r.new_score) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(n, seed):
    """Sightings with repeats, ties, nulls, a key that holds a third of the rows, and gaps."""
    dice = random.Random(seed)
    rows = [(dice.randrange(60), "hot" if dice.random() < 0.34 else f"f{dice.randrange(40)}", dice.choice([1.0, 2.0, 3.5, None])) for _ in range(n)]
    return [*rows, *rows[:20], (None, "f1", 1.0), (5, None, 1.0), (7, "", 2.0), (59, "last", 1.0)]


def test_table_agrees_with_plain_python(spark):
    rows = made(500, 1)
    until = F.lit(START + dt.timedelta(hours=57, minutes=30))
    assert events(lifecycle.score_history(sightings(spark, rows), 4 * HOUR, until)) == by_hand(rows, 4, 57.5)
    assert lifecycle.score_history(sightings(spark, []), HOUR, until).count() == 0


@pytest.mark.parametrize("cuts", [[60], [20, 21, 60]])
def test_restarted_stream_gives_the_rows_of_the_table(spark, tmp_path, cuts):
    """However arrivals are cut into runs, each starting from the checkpoint of the one before, and in whatever order rows
    arrive within the delay."""
    rows = made(400, 2)
    arrivals, out, checkpoint = (str(tmp_path / n) for n in ("arrivals", "out", "checkpoint"))
    dice = random.Random(3)
    arrives = [((r[0] or 0) + dice.choice([0, 0, 1]), r) for r in rows]
    low = -1
    for high in cuts:
        part = [r for t, r in arrives if low < t and (t <= high or high == cuts[-1])]
        sightings(spark, part).coalesce(2).write.mode("append").parquet(arrivals)
        low = high
        stream = spark.readStream.schema(SCHEMA).parquet(arrivals)
        query = score_stream.write_available(score_stream.score_events(stream, 4 * HOUR, "150 minutes"), out, checkpoint)
        query.awaitTermination()
        assert query.exception() is None
    assert events(spark.read.parquet(out)) == by_hand(rows, 4, 59 - 2.5)
    assert spark.conf.get(score_stream.STORE).endswith("HDFSBackedStateStoreProvider")


def test_watermark_at_a_sightings_own_time_loses_nothing(spark, tmp_path):
    """Timers that come due exactly at the watermark fire once it has passed."""
    arrivals, out, checkpoint = (str(tmp_path / n) for n in ("arrivals", "out", "checkpoint"))
    rows = []
    for part in ([(0, "a", 1.0), (1, "b", 1.0)], [(2, "b", 2.0)], [(6, "b", 2.0), (6, "a", 5.0)], [(20, "c", 1.0)]):
        rows += part
        sightings(spark, part).coalesce(1).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(SCHEMA).parquet(arrivals)
        score_stream.write_available(score_stream.score_events(stream, 2 * HOUR, "1 hour"), out, checkpoint).awaitTermination()
    assert events(spark.read.parquet(out)) == by_hand(rows, 2, 19)


def test_stream_of_nothing(spark, tmp_path):
    """Rows that take no part, or no rows at all, give no events."""
    for name, rows in (("none", []), ("undated", [(None, "f", 1.0), (3, None, 1.0)])):
        arrivals, out, checkpoint = (str(tmp_path / name / n) for n in ("arrivals", "out", "checkpoint"))
        sightings(spark, rows).write.parquet(arrivals)
        stream = spark.readStream.schema(SCHEMA).parquet(arrivals)
        score_stream.write_available(score_stream.score_events(stream, HOUR, "1 hour"), out, checkpoint).awaitTermination()
        assert spark.read.schema(score_stream.EVENTS).parquet(out).count() == 0
