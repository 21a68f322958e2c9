"""Structured Streaming jobs. Each transformation also runs on a batch table."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadloom import fixed_values as fv
from threadloom.session import scratch_path


def watch_files(spark: SparkSession, path: str, schema: Any, fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    """New files below a folder, at most ``max_files`` per round."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def run_to_table(stream: DataFrame, name: str, mode: str = "append",
                 trigger: dict[str, Any] | None = None) -> str:
    """Run a stream over all input there is into Parquet; gives the folder."""
    out = scratch_path(stream.sparkSession, name)
    query = (stream.writeStream.format("parquet").outputMode(mode)
             .option("path", out).option("checkpointLocation", scratch_path(stream.sparkSession, name + "-log"))
             .trigger(**(trigger or {"availableNow": True})).start())
    query.awaitTermination()
    return out


def run_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None],
                mode: str = "append", trigger: dict[str, Any] | None = None) -> None:
    query = (stream.writeStream.foreachBatch(each).outputMode(mode)
             .option("checkpointLocation", scratch_path(stream.sparkSession, name + "-log"))
             .trigger(**(trigger or {"availableNow": True})).start())
    query.awaitTermination()


def new_messages(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once within the watermark; for sources that repeat what they sent."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def _telemetry(rows: DataFrame, slot: Column) -> DataFrame:
    """Rows ``ts, total_time_ms, success, cache_hit`` per window, with alert flags."""
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    grouped = rows.groupBy(slot.alias("w")).agg(
        F.count(F.lit(1)).alias("queries"), F.avg("total_time_ms").alias("mean_ms"),
        F.max("total_time_ms").alias("max_ms"), share(F.col("cache_hit")).alias("hit_rate"),
        share(~F.col("success")).alias("error_rate"))
    return grouped.select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "queries", "mean_ms", "max_ms",
        "hit_rate", "error_rate",
        (F.col("mean_ms") > fv.ALERT_LATENCY_MS).alias("high_latency"),
        (F.col("hit_rate") < fv.ALERT_HIT_RATE).alias("low_hit_rate"),
        (F.col("error_rate") > fv.ALERT_ERROR_RATE).alias("high_error_rate"))


def telemetry_windows(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Five-minute figures; rows later than the watermark are dropped."""
    rows = rows.withWatermark("ts", delay) if rows.isStreaming else rows
    return _telemetry(rows, F.window("ts", "5 minutes"))


def sliding_error_rate(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Error rate over fifteen minutes, every five."""
    rows = rows.withWatermark("ts", delay) if rows.isStreaming else rows
    return (rows.groupBy(F.window("ts", "15 minutes", "5 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("error_rate"))
        .select(F.col("w.start").alias("start"), "queries", "error_rate",
                (F.col("error_rate") > fv.ALERT_ERROR_RATE).alias("high_error_rate")))


def conversation_sessions(rows: DataFrame, key: str, gap: str = "30 minutes",
                          delay: str = "10 minutes") -> DataFrame:
    """Sessions of a user, closed by half an hour of silence."""
    rows = rows.withWatermark("ts", delay) if rows.isStreaming else rows
    return (rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
            .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events"))


GROUP_SCHEMA = "channel_id string, id string, user_name string, ts string, message_count long, text string"
SLOT_SECONDS, BLOCK_SLOTS = 60, 60
HELD_CHARS = 16_000_000  # a message counts for its text and this much besides
MESSAGE_CHARS = 200


class AnchorGroups(StatefulProcessor):
    """Messages of a channel wait in parts, in map state: what came at once for a block of time slots is one value, which
    no later message rewrites. One event-time timer per channel, at the end of the first slot that holds or ends something,
    folds the slots the watermark has passed, block by block and in order, into the open group. Of the open group
    only its anchor is rewritten; its texts are appended to list state. So a channel costs a few calls per part, however
    many slots its messages lie in, and no step holds all that it has waiting.

    A group is closed by a message that cannot join it, or once the slot in which its window ends has passed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # the first slot of the part and its number; the messages as JSON lists of t, id, ts, user and msg
        self.parts = handle.getMapState("parts", "slot long, part long", "messages string")
        self.known = handle.getValueState("known", "parts long, wake long")
        self.anchor = handle.getValueState("anchor", "t double, id string, user string, last_ts string, count long")
        self.texts = handle.getListState("texts", "msg string")

    def _keep(self, messages: list, part: int) -> int:
        """Store the messages of one block; gives their first slot."""
        first = int(min(m[0] for m in messages) // SLOT_SECONDS)
        self.parts.updateValue((first, part), (json.dumps(messages, ensure_ascii=False),))
        return first

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        parts, wake = self.known.get() if self.known.exists() else (0, None)
        new: dict[int, list[tuple]] = {}
        held, firsts = 0, []

        def keep() -> None:
            firsts.append(min(self._keep(messages, parts) for messages in new.values()))
            new.clear()

        for pdf in rows:
            for m in zip(pdf["t"].tolist(), pdf["id"], pdf["ts"], pdf["user"], pdf["msg"]):
                new.setdefault(int(m[0] // SLOT_SECONDS) // BLOCK_SLOTS, []).append(m)
                held += len(m[4]) + MESSAGE_CHARS
            if held >= HELD_CHARS:
                keep()
                held, parts = 0, parts + 1
        if new:
            keep()
            parts += 1
        due = (min(firsts) + 1) * SLOT_SECONDS * 1000 if firsts else wake
        if due is not None and (wake is None or due < wake):
            if wake is not None:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(due)
            wake = due
        self.known.update((parts, wake))
        yield pd.DataFrame(columns=[c.split()[0] for c in GROUP_SCHEMA.split(", ")])

    def _passed(self, before: int, waiting: list[int]) -> Iterator[list]:
        """The messages of slots before ``before``, block by block and in order, out of state. Slots that still
        have something waiting are added to ``waiting``."""
        blocks: dict[int, list[tuple]] = {}
        for part in self.parts.keys():
            if part[0] < before:
                blocks.setdefault(part[0] // BLOCK_SLOTS, []).append(part)
            else:
                waiting.append(part[0])
        for block in sorted(blocks):
            messages = []
            for part in blocks[block]:
                messages += json.loads(self.parts.getValue(part)[0])
                self.parts.removeKey(part)
            if (block + 1) * BLOCK_SLOTS > before:  # the watermark is inside this block
                later = [m for m in messages if m[0] // SLOT_SECONDS >= before]
                if later:
                    waiting.append(self._keep(later, blocks[block][0][1]))
                    messages = [m for m in messages if m[0] // SLOT_SECONDS < before]
            yield sorted(messages)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        before = timerValues.getCurrentWatermarkInMs() // 1000 // SLOT_SECONDS
        closed, waiting, size = [], [], 0
        anchor = self.anchor.get() if self.anchor.exists() else None
        fresh: list[tuple] = []  # texts of the open group that are not in state yet
        kept = anchor
        frame = lambda: pd.DataFrame(closed, columns=[c.split()[0] for c in GROUP_SCHEMA.split(", ")])

        def close() -> int:
            nonlocal kept
            texts = []
            if kept:  # only the group that was open before has texts in state
                texts = [m[0] for m in self.texts.get()] if self.texts.exists() else []
                self.texts.clear()
                kept = None
            closed.append((key[0], anchor[1], anchor[2], anchor[3], anchor[4], " ".join(texts + [m[0] for m in fresh])))
            fresh.clear()
            return len(closed[-1][5]) + MESSAGE_CHARS

        for messages in self._passed(before, waiting):
            for m in messages:
                if anchor and anchor[2] == m[3] and 0 < m[0] - anchor[0] <= fv.ANCHOR_WINDOW_SECONDS:
                    anchor = (*anchor[:3], m[2], anchor[4] + 1)
                else:
                    if anchor:
                        size += close()
                    anchor = (m[0], m[1], m[3], m[2], 1)
                fresh.append((m[4],))
            if size >= HELD_CHARS:
                yield frame()
                closed, size = [], 0
        if anchor:
            last = int((anchor[0] + fv.ANCHOR_WINDOW_SECONDS) // SLOT_SECONDS)
            if last < before:  # over
                close()
                anchor = None
            else:
                waiting.append(last)
        if anchor:
            self.anchor.update(anchor)
            if fresh:
                self.texts.appendList(fresh)
        elif self.anchor.exists():
            self.anchor.clear()
        wake = (min(waiting) + 1) * SLOT_SECONDS * 1000 if waiting else None
        if wake is not None:
            self.handle.registerTimer(wake)
        self.known.update((self.known.get()[0], wake))
        yield frame()

    def close(self) -> None:
        pass


def anchor_groups(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Streaming form of the first grouping pass, over ``channel_id, event_time, t, id, ts, user, msg``.

    Messages wait until the watermark has passed them, then they are folded in order. An
    open group is given out as soon as no later message can join it. The state lies in RocksDB, which this
    kind of state needs.
    """
    stream.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return (stream.filter("msg <> ''").withWatermark("event_time", delay).groupBy("channel_id")
            .transformWithStateInPandas(AnchorGroups(), GROUP_SCHEMA, "Append", "eventTime"))
