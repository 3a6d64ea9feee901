"""Limits of a provider over a log of requests: rolling usage, gaps and cooldowns as windows by user."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE, DAY, MONTH = 60_000_000, 86_400_000_000, 2_592_000_000_000


@dataclass(frozen=True)
class Limits:
    """Requests and tokens a minute, tokens a day and in 30 days; day and month keep a margin of a tenth."""

    requests_minute: int = 30
    tokens_minute: int = 14_400
    tokens_day: int = 600_000
    tokens_month: int = 15_000_000
    margin: float = 10.0

    def day(self) -> int:
        return self.tokens_day - int(self.tokens_day * self.margin / 100)

    def month(self) -> int:
        return self.tokens_month - int(self.tokens_month * self.margin / 100)


def rolling(events: DataFrame) -> DataFrame:
    """The events with what their user has used before them in each range; an entry exactly as old as the range still counts."""
    at = F.unix_micros("ts")
    window = lambda size: Window.partitionBy("user_id").orderBy(at).rangeBetween(-size, 0)
    used = lambda size: (F.sum("tokens").over(window(size)) - F.col("tokens")).cast("long")
    return events.select("*", (F.count("*").over(window(MINUTE)) - 1).alias("requests"), used(MINUTE).alias("tokens_minute"), used(DAY).alias("tokens_day"), used(MONTH).alias("tokens_month"), F.min(at).over(window(MINUTE)).alias("oldest"))


def usage(events: DataFrame, limits: Limits) -> DataFrame:
    """(event_id, user_id, ts, tokens) events with usage, decision, reason and seconds to wait (-1 where day or month deny)."""
    rows = rolling(events)
    no_day = (F.col("tokens_day") + F.col("tokens") > limits.day()) & (F.col("tokens_day") >= limits.day())
    no_month = (F.col("tokens_month") + F.col("tokens") > limits.month()) & (F.col("tokens_month") >= limits.month())
    many, heavy = F.col("requests") >= limits.requests_minute, F.col("tokens_minute") + F.col("tokens") > limits.tokens_minute
    slow = (many | heavy) & (F.col("requests") > 0)
    reason = F.when(no_month, "month").when(no_day, "day").when(slow & heavy & ~many, "tokens_minute").when(slow, "requests_minute")
    wait = F.when(no_day | no_month, -1.0).when(slow, F.round(60 - (F.unix_micros("ts") - F.col("oldest")) / 1_000_000, 6)).otherwise(0.0)
    return rows.withColumn("allowed", ~(no_day | no_month)).withColumn("reason", reason).withColumn("wait", wait)


def report(events: DataFrame, limits: Limits) -> DataFrame:
    """Each user's usage after the last request in percent (tenths, rounded down) of the day's and month's limits, and alerts beyond 80."""
    last = rolling(events).groupBy("user_id").agg(F.max_by(F.struct("tokens_day", "tokens_month", "tokens"), F.struct("ts", "event_id")).alias("u"))
    day, month = ((F.col(f"u.tokens_{k}") + F.col("u.tokens")) / limit * 100 for k, limit in (("day", limits.tokens_day), ("month", limits.tokens_month)))
    tenths = lambda k, limit: F.floor((F.col(f"u.tokens_{k}") + F.col("u.tokens")) * 1000 / limit) / 10
    return last.select("user_id", tenths("day", limits.tokens_day).alias("day_percent"), tenths("month", limits.tokens_month).alias("month_percent"), (day > 80).alias("day_alert"), (month > 80).alias("month_alert"))


def gaps(events: DataFrame, key: str, least: float) -> DataFrame:
    """What the pause before each event of a key lacks of ``least`` seconds."""
    before = F.lag(F.unix_micros("ts")).over(Window.partitionBy(key).orderBy("ts", "event_id"))
    paused = (F.unix_micros("ts") - before) / 1_000_000
    return events.withColumn("wait", F.round(F.greatest(F.lit(least) - F.coalesce(paused, F.lit(least)), F.lit(0.0)), 6))


def cooldowns(events: DataFrame, key: str, failed: Column, seconds: Column, low: int, high: int) -> DataFrame:
    """``until``, in microseconds: the latest end of the pauses that failures before the event began, each clamped to low..high seconds; and whether it blocks the event."""
    ends = F.when(failed, F.unix_micros("ts") + F.round(F.least(F.greatest(seconds, F.lit(low)), F.lit(high)) * 1_000_000).cast("long"))
    earlier = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    marked = events.withColumn("__ends", ends).withColumn("until", F.max("__ends").over(earlier))
    return marked.withColumn("blocked", F.coalesce(F.unix_micros("ts") < F.col("until"), F.lit(False))).drop("__ends")
