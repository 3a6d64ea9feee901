"""Running values in order that need no ordered window over a whole key.

Rows are dealt by ranges of (key, order), so that a key with many rows is split. Each
range has its running sums, last values and greatest values by window; a key that reaches
over several ranges adds what its earlier ranges ended with. There are fewer such keys than
ranges, so those ends are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.resolution import checkpointed


def scanned(rows: DataFrame, within: str, order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, highs: dict[str, Column] | None = None) -> DataFrame:
    """The rows with a column for each name: over the rows of the same ``within`` up to and with this one, the sum, the last value that is not null, or the greatest.

    The order has to be a total one within a key. Nulls add nothing, are no last and no greatest value; a null key is a key like others.
    """
    sums, lasts, highs = sums or {}, lasts or {}, highs or {}
    taken = {**sums, **lasts, **highs}
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = rows.withColumns({f"of_{k}": c for k, c in taken.items()})
    # a checkpoint, so that ranges stay what they were counted as
    dealt = checkpointed(valued.repartitionByRange(parts, within, *order).withColumn("range", F.spark_partition_id()))
    own = Window.partitionBy("range", within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    value = lambda k: F.col(f"of_{k}")
    here = {k: F.sum(value(k)) for k in sums} | {k: F.last(value(k), ignorenulls=True) for k in lasts} | {k: F.max(value(k)) for k in highs}
    counted = dealt.withColumns({k: c.over(own) for k, c in here.items()})
    at = F.struct(*order)
    ends = {k: F.sum(value(k)) for k in sums} | {k: F.max_by(value(k), F.when(value(k).isNotNull(), at)) for k in lasts} | {k: F.max(value(k)) for k in highs}
    by_range = dealt.groupBy(within, "range").agg(*[c.alias(f"end_{k}") for k, c in ends.items()])
    spread = by_range.groupBy(within).agg(F.sort_array(F.collect_list(F.struct("range", *[f"end_{k}" for k in taken]))).alias("ends")).filter(F.size("ends") > 1)
    joined = counted.join(F.broadcast(spread.withColumnRenamed(within, "wide")), F.col(within).eqNullSafe(F.col("wide")), "left")

    def before(k: str) -> Column:
        """What the key's earlier ranges give."""
        earlier = F.filter("ends", lambda e: (e["range"] < F.col("range")) & e[f"end_{k}"].isNotNull())
        found = F.transform(earlier, lambda e: e[f"end_{k}"])
        if k in sums:
            return F.aggregate(F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), F.get(found, F.lit(0)), lambda a, x: a + x)
        return F.get(found, F.size(found) - 1) if k in lasts else F.array_max(found)

    whole = {k: F.coalesce(F.col(k) + before(k), k, before(k)) for k in sums} | {k: F.coalesce(k, before(k)) for k in lasts} | {k: F.greatest(k, before(k)) for k in highs}
    return joined.withColumns(whole).drop("ends", "wide", "range", *[f"of_{k}" for k in taken])


def numbered(rows: DataFrame, within: str, order: list[str], counters: dict[str, Column]) -> DataFrame:
    """For each counter, how many rows of the same ``within`` up to and with this one meet its condition; null conditions do not count."""
    return scanned(rows, within, order, sums={k: F.coalesce(c, F.lit(False)).cast("long") for k, c in counters.items()})


def asof(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], place: str) -> DataFrame:
    """Each left row with the values of the last right row of its key at its time or before, or nulls.

    Both sides have ``key``, ``at`` and ``place`` (unique on its side), the right one also ``values``; of right rows of one time the greatest place is the last.
    A left row sees right rows of its own time. Keys with many rows are split, unlike in a join by key.
    """
    held = F.struct(*values)
    rows = left.select("*", F.lit(1).alias("side"), F.lit(None).cast(right.select(held.alias("v")).schema["v"].dataType).alias("held"))
    added = right.select(key, at, place, F.lit(0).alias("side"), held.alias("held"))
    both = rows.unionByName(added, allowMissingColumns=True)
    found = scanned(both, key, [at, "side", place], lasts={"found": F.col("held")})
    return found.filter("side = 1").select(*left.columns, *[F.col(f"found.{v}").alias(v) for v in values])
