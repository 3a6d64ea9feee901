"""Which level of a chain of caches answers a request: cooldown, memory, disk, remembered failure, network."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.scans import scanned

SECOND = 1_000_000


@dataclass(frozen=True)
class Times:
    """Seconds that memory and disk entries live, and the least and most of the pauses after a refusal, for all requests and for its key."""

    memory: int = 3600
    disk: int = 86_400
    pause: tuple[int, int] = (10, 120)
    failure: tuple[int, int] = (10, 180)


def answer_levels(requests: DataFrame, writes: DataFrame, refusals: DataFrame, times: Times) -> DataFrame:
    """(request, level) by the state that earlier rows left.

    ``requests`` has request, key, at (microseconds), place and outcome (``ok``, ``refused`` or an error), ``writes`` key, at, place, store (``memory`` or
    ``disk``) and version, ``refusals`` key, at, place and seconds; places are unique over all three and order rows of one time. The last write
    of a key counts. On disk an envelope of version 2 lives its time, a bare list (version 1) for ever, another
    version is unreadable. During a pause for all, only the disk answers; after that memory, disk, a remembered refusal of the key, and the network by
    its outcome, in that order.
    """
    clamped = lambda c, bounds: F.least(F.greatest(c, F.lit(bounds[0])), F.lit(bounds[1]))
    until = lambda bounds: F.col("at") + F.round(clamped(F.col("seconds"), bounds) * SECOND).cast("long")
    asked = requests.select("request", "key", "at", "place", "outcome")
    written = writes.select("key", "at", "place", F.when(F.col("store") == "memory", F.col("at")).alias("memory_at"), F.when(F.col("store") == "disk", F.struct("at", "version")).alias("disk_entry"))
    refused = refusals.select("key", "at", "place", until(times.failure).alias("failure_until"), until(times.pause).alias("pause_until"))
    rows = asked.unionByName(written, allowMissingColumns=True).unionByName(refused, allowMissingColumns=True).withColumn("everyone", F.lit(0))
    by_key = scanned(rows, "key", ["at", "place"], lasts={"memory": F.col("memory_at"), "disk": F.col("disk_entry"), "failure": F.col("failure_until")})
    state = scanned(by_key, "everyone", ["at", "place"], highs={"pause": F.col("pause_until")}).filter(F.col("request").isNotNull())
    age = F.col("at") - F.col("disk.at")
    on_disk = F.coalesce((F.col("disk.version") == 1) | ((F.col("disk.version") == 2) & (age <= times.disk * SECOND)), F.lit(False))
    paused, failed = (F.coalesce(F.col("at") < F.col(c), F.lit(False)) for c in ("pause", "failure"))
    in_memory = F.coalesce(F.col("at") - F.col("memory") <= times.memory * SECOND, F.lit(False))
    level = (
        F.when(paused & on_disk, "disk_while_paused").when(paused, "paused").when(in_memory, "memory").when(on_disk, "disk").when(failed, "remembered_refusal")
        .when(F.col("outcome") == "ok", "network").when(F.col("outcome") == "refused", "refused").otherwise("error")
    )
    return state.select("request", level.alias("level"))
