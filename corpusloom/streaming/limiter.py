"""A request and token limiter as keyed state: rolling minute sums with a safety margin decide every request."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REQUESTS = 30
TOKENS = 14_400
MARGIN = 0.9
MINUTE = 60.0


def decide(window: list[tuple[float, int]], at: float, tokens: int, requests: int = REQUESTS, limit: int = TOKENS) -> tuple[bool, list[tuple[float, int]]]:
    """Whether a request fits, and the log after it. An entry exactly a minute old still counts."""
    live = [(t, n) for t, n in window if t >= at - MINUTE]
    fits = len(live) + 1 <= requests * MARGIN and sum(n for _, n in live) + tokens <= limit * MARGIN
    return fits, [*live, (at, tokens)] if fits else live


def limited(events: DataFrame, requests: int = REQUESTS, limit: int = TOKENS) -> DataFrame:
    """event_id, user_id and allowed for every event; state holds one minute of a user's granted requests."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (times, sizes) = state.get if state.exists else ([], [])
        window = list(zip(times, sizes, strict=True))
        rows: list[tuple[Any, ...]] = []
        frame = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for event_id, ts, value in zip(frame.event_id, frame.ts, frame.value, strict=True):
            fits, window = decide(window, ts.timestamp(), int(value), requests, limit)
            rows.append((event_id, key[0], fits))
        state.update(([t for t, _ in window], [n for _, n in window]))
        yield pd.DataFrame(rows, columns=["event_id", "user_id", "allowed"])

    return events.groupBy("user_id").applyInPandasWithState(step, "event_id long, user_id long, allowed boolean", "times array<double>, sizes array<int>", "append", GroupStateTimeout.NoTimeout)
