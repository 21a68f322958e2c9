"""Several batches of a stream, with rows that come behind the watermark."""

import datetime
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadloom.session import scratch_path
from threadloom.streaming import streams

LOG = "ts timestamp, total_time_ms double, success boolean, cache_hit boolean"


def at(minute):
    return datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(minutes=minute)


def test_late_rows_are_left_out_and_delayed_ones_are_not(spark):
    """A batch drops rows behind the watermark that the batch before it started from."""
    path = scratch_path(spark, "log")
    batches = [[1, 2, 61], [62], [58, 3], [200], [201], [4], [400], [401]]
    for n, minutes in enumerate(batches):
        rows = [(at(m), float(m), True, False) for m in minutes]
        spark.createDataFrame(rows, LOG).coalesce(1).write.parquet(f"{path}/{n}")
    stream = (spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("latestFirst", "false")
              .option("recursiveFileLookup", "true").parquet(f"{path}/*"))
    out = streams.run_to_table(streams.telemetry_windows(stream), "late")
    got = {r.start: r.queries for r in spark.read.parquet(out).select(F.date_format("start", "HH:mm").alias("start"), "queries").collect()}
    # minute 3 came after the watermark had passed its window, minute 4 long after; minute 58 did not
    assert got["12:00"] == 2 and got["12:55"] == 1 and got["13:00"] == 2 and got["15:20"] == 2


class Kept:
    """State of one key in memory, with the number of calls."""

    def __init__(self):
        self.maps, self.values, self.lists, self.timers, self.calls = {}, {}, {}, set(), 0

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def of(self, store, name, **calls):
        def counted(call):
            def run(*args):
                self.calls += 1
                return call(*args)
            return run
        return SimpleNamespace(exists=counted(lambda: name in store), clear=counted(lambda: store.pop(name, None)),
                               **{k: counted(c) for k, c in calls.items()})

    def getValueState(self, name, schema):
        return self.of(self.values, name, get=lambda: self.values[name], update=lambda v: self.values.update({name: v}))

    def getListState(self, name, schema):
        return self.of(self.lists, name, get=lambda: iter(list(self.lists[name])),
                       appendList=lambda v: self.lists.setdefault(name, []).extend(v))

    def getMapState(self, name, *schemas):
        held = self.maps.setdefault(name, {})
        return self.of(self.maps, name, getValue=lambda k: held[tuple(k)], containsKey=lambda k: tuple(k) in held,
                       updateValue=lambda k, v: held.update({tuple(k): v}), removeKey=lambda k: held.pop(tuple(k)),
                       keys=lambda: iter(list(held)))


def told(messages):
    """Groups of a channel by a plain fold: anchor, count, last stamp and text."""
    groups = []
    for m in sorted(messages):
        if groups and groups[-1][0][3] == m[3] and 0 < m[0] - groups[-1][0][0] <= 3600:
            groups[-1].append(m)
        else:
            groups.append([m])
    return groups


@pytest.mark.parametrize("gap, chars", [(40, 16_000_000), (40, 3000), (1900, 16_000_000), (1900, 3000)])
def test_anchor_groups_make_few_state_calls(monkeypatch, gap, chars):
    """One timer per channel and batch and a few calls per block of slots, however many slots have messages; groups come out
    when the watermark has passed them, also in the middle of a block."""
    monkeypatch.setattr(streams, "HELD_CHARS", chars, raising=False)
    rng = np.random.default_rng(gap)
    times = np.cumsum(rng.integers(0, 2 * gap, 900)) + 1_700_000_000.5
    messages = [(float(t), f"m{n}", f"s{n}", "ab"[int(u)], f"text {n}" + " ü" * (n % 3)) for n, (t, u) in enumerate(zip(times, rng.random(900) < 0.2))]
    handle, job = Kept(), streams.AnchorGroups()
    job.init(handle)
    out, watermark, seen = [], 0, []
    for batch in [messages[:300], messages[300:310], [], messages[310:890], messages[890:], [(2e9, "beat", "beat", "beat", "beat")]]:
        rows = [batch[k] for k in rng.permutation(len(batch))]
        seen += rows
        if rows:
            frames = [pd.DataFrame(rows[k : k + 50], columns=["t", "id", "ts", "user", "msg"]) for k in range(0, len(rows), 50)]
            list(job.handleInputRows(("c",), iter(frames), None))
        watermark = max(watermark + 900_000, *[int(m[0] * 1000) - 1_000_000 for m in rows or seen])
        for at in sorted(t for t in handle.timers if t <= watermark):
            times = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
            for frame in job.handleExpiredTimer(("c",), times, SimpleNamespace(getExpiryTimeInMs=lambda: at)):
                out += frame.itertuples(index=False, name=None)
            handle.timers.remove(at)
        over = [g for g in told(seen) if (int((g[0][0] + 3600) // 60) + 1) * 60_000 <= watermark]
        assert len(out) >= len(over)
    assert out == [("c", g[0][1], g[0][3], g[-1][2], len(g), " ".join(m[4] for m in g)) for g in told(messages)]
    assert 300 < len(out) < 900 and len(handle.timers) == 1
    if chars > 3000:
        assert handle.calls <= 4 * len({m[0] // 3600 for m in messages}) + 120
