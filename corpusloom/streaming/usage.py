"""A provider's limits as keyed state of a stream: rolling usage by user, and cooldowns after failures.

The log of a user's requests is list state; a batch adds its rows, sums of the minute, the day and 30 days before each
request come from running totals and binary search, and an event-time timer drops what is
older than 30 days, or all, once the watermark is past it. Results equal ``limits.usage`` and
``limits.cooldowns`` over the same rows as long as no row comes later than the watermark
and rows of one moment come in one batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.streaming.limits import DAY, MINUTE, MONTH, Limits

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A user's log is cleared of old rows by a timer this often, in event time (where a time to live cannot be set).
SWEEP = DAY


def with_state_store(spark: SparkSession) -> None:
    """Keyed processors need a store that can hold lists and timers."""
    spark.conf.set(PROVIDER, ROCKS)


def ordered(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one batch by time; a batch is bounded by the source's limit on what it reads at once."""
    return pd.concat(list(parts), ignore_index=True).sort_values(["at", "event_id"], kind="stable", ignore_index=True)


class Usage(StatefulProcessor):
    """Usage, decision, reason and wait of each request."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "at long, tokens long")
        self.sweep = handle.getValueState("sweep", "at long")

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        rows = list(self.log.get()) if self.log.exists() else []
        return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = ordered(rows)
        at, tokens = new["at"].to_numpy(np.int64), new["tokens"].to_numpy(np.int64)
        old_at, old_tokens = self.read()
        self.log.appendList(list(zip(at.tolist(), tokens.tolist(), strict=True)))
        if not self.sweep.exists():
            self.set_timer(int(at[-1]))
        all_at = np.concatenate([old_at, at])
        by = np.argsort(all_at, kind="stable")
        all_at = all_at[by]
        total = np.concatenate([[0], np.cumsum(np.concatenate([old_tokens, tokens])[by])])
        end = np.searchsorted(all_at, at, "right")
        begin = {size: np.searchsorted(all_at, at - size, "left") for size in (MINUTE, DAY, MONTH)}
        used = {size: total[end] - total[b] - tokens for size, b in begin.items()}
        requests, oldest = end - begin[MINUTE] - 1, all_at[begin[MINUTE]]
        m = self.limits
        no_day = (used[DAY] + tokens > m.day()) & (used[DAY] >= m.day())
        no_month = (used[MONTH] + tokens > m.month()) & (used[MONTH] >= m.month())
        many, heavy = requests >= m.requests_minute, used[MINUTE] + tokens > m.tokens_minute
        slow = (many | heavy) & (requests > 0)
        reason = np.select([no_month, no_day, slow & heavy & ~many, slow], ["month", "day", "tokens_minute", "requests_minute"], "")
        wait = np.where(no_day | no_month, -1.0, np.where(slow, np.round(60 - (at - oldest) / 1_000_000, 6), 0.0))
        yield pd.DataFrame({
            "event_id": new["event_id"], "tokens_minute": used[MINUTE], "tokens_day": used[DAY], "tokens_month": used[MONTH],
            "allowed": ~(no_day | no_month), "reason": [r or None for r in reason.tolist()], "wait": wait,
        })

    def set_timer(self, at: int) -> None:
        self.sweep.update((at,))
        self.handle.registerTimer((at + SWEEP) // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Drops rows that no later request can count; while some are left, the next sweep is set."""
        watermark = 1000 * timerValues.getCurrentWatermarkInMs()
        at, tokens = self.read()
        live = at >= watermark - MONTH
        if live.any():
            if not live.all():
                self.log.put(list(zip(at[live].tolist(), tokens[live].tolist(), strict=True)))
            self.set_timer(watermark)
        else:
            self.log.clear()
            self.sweep.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class Cooldown(StatefulProcessor):
    """Until when earlier failures of the key hold its requests back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = ordered(rows)
        none = np.iinfo(np.int64).min
        before = self.until.get()[0] if self.until.exists() else none
        ends = new["ends"].fillna(none).to_numpy(np.int64)
        reached = np.maximum.accumulate(np.concatenate([[before], ends]))
        if reached[-1] > none and reached[-1] > before:
            self.until.update((int(reached[-1]),))
            self.handle.registerTimer(int(reached[-1]) // 1000 + 1)
        held = reached[:-1]
        until = pd.Series([None if h == none else h for h in held.tolist()], dtype="Int64")
        yield pd.DataFrame({"event_id": new["event_id"], "until": until, "blocked": new["at"].to_numpy(np.int64) < held})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Forgets a pause that the watermark has passed; one that was made longer has a timer of its own."""
        if self.until.exists() and self.until.get()[0] // 1000 < timerValues.getCurrentWatermarkInMs():
            self.until.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def usage(events: DataFrame, limits: Limits, late: str = "2 days") -> DataFrame:
    """(event_id, user_id, ts, tokens) events of a stream with usage, decision, reason and seconds to wait."""
    with_state_store(events.sparkSession)
    rows = events.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    schema = "event_id long, tokens_minute long, tokens_day long, tokens_month long, allowed boolean, reason string, wait double"
    return rows.groupBy("user_id").transformWithStateInPandas(Usage(limits), schema, "Append", "EventTime")


def cooldowns(events: DataFrame, key: str, failed: Column, seconds: Column, low: int, high: int, late: str = "2 days") -> DataFrame:
    """(event_id, ts, key) events of a stream: until when the failures before block the key, and whether they block the event."""
    with_state_store(events.sparkSession)
    ends = F.when(failed, F.unix_micros("ts") + F.round(F.least(F.greatest(seconds, F.lit(low)), F.lit(high)) * 1_000_000).cast("long"))
    rows = events.withWatermark("ts", late).select(key, "event_id", "ts", F.unix_micros("ts").alias("at"), ends.alias("ends"))
    return rows.groupBy(key).transformWithStateInPandas(Cooldown(), "event_id long, until long, blocked boolean", "Append", "EventTime")
