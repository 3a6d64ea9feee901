"""Planned compaction of many small Parquet files, day by day.

Rows are first written as starting files, one for each occurring (day, lot, piece). A
plan then says which files of a day are joined: the structs of the small ones, largest
first, are folded by SQL's ``aggregate`` over an array of groups, each taking the
first group where it fits; exploded, that is one row a file. The plan is carried out by
one job that reads the files named, puts each group's rows behind one another, and
writes a file a group. Files that stay alone are not touched.

The rows of a file or group go through one task, sorted with spills; counts, plans and
listings have a row a file, of which there are at most 4 * (200 + days), whatever the number
of rows. The plan and the new files are complete in the shared folder before any old
file goes, and ``publish`` can be called again after it was interrupted.

Defined cases: rows without a time are a day of their own (null); without a click_id they
are hashed as the empty text, sort first and are the empty text in ids_sha256; values that are null or
no finite number count 0 cents; rows equal in time and click_id keep any order, and a joined file keeps that of its sources;
an empty table makes a folder without data files and no rows; other columns are only
carried, and may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.llm.shared import bound_batches, shared_path, written

#: S(x) for lots, for files that are small, and for what a group may hold.
LOT_SHARE, SMALL_SHARE, GROUP_SHARE = 200, 750, 400
KEY = ("day", "lot", "piece")

#: Stands for the day of rows without a time, in folder names and joins.
NO_DAY = -(1 << 63)

#: Small files of a day, largest first, each put into the first group that can hold it.
FOLD = """
aggregate(
  files,
  CAST(array() AS ARRAY<STRUCT<rows: BIGINT, members: ARRAY<STRUCT<less: BIGINT, lot: BIGINT, piece: BIGINT, path: STRING>>>>),
  (groups, f) -> transform(
    array(array_position(transform(groups, g -> g.rows - f.less <= {capacity}), true)),
    spot -> CASE
      WHEN spot = 0 THEN concat(groups, array(named_struct('rows', -f.less, 'members', array(f))))
      ELSE transform(groups, (g, i) -> CASE
        WHEN i + 1 = spot THEN named_struct('rows', g.rows - f.less, 'members', concat(g.members, array(f)))
        ELSE g END) END)[0])
"""


def share(n_rows: int, x: int) -> int:
    return 1 + n_rows // x


def free_names(columns: list[str]) -> list[str]:
    """Names of the three key columns that the table does not use, in any case of letters."""
    taken, mark = [c.lower() for c in columns], "__"
    while any(c.startswith(f"{mark}{k}") for c in taken for k in KEY):
        mark += "_"
    return [f"{mark}{k}" for k in KEY]


def day_of() -> Column:
    return F.coalesce(F.unix_date(F.col("arrived_at").cast("date")).cast("long"), F.lit(NO_DAY))


def keyed(rows: DataFrame, names: list[str]) -> tuple[DataFrame, int]:
    """The rows with day, lot and piece under the given names, and the number of rows."""
    day, lot, piece = names
    counts = written(rows.groupBy(day_of().alias(day)).agg(F.count("*").alias(f"{day}_rows")), "compaction-days")
    n_rows = counts.agg(F.sum(f"{day}_rows")).first()[0] or 0
    h = F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")))
    out = rows.withColumn(day, day_of()).join(counts, day)
    lots = 1 + F.expr(f"`{day}_rows` div {share(n_rows, LOT_SHARE)}")
    out = out.withColumn(lot, F.floor(h / 16) % lots).withColumn(piece, F.least(h % 4, F.floor(h / 4) % 4))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *names), n_rows


def write_files(rows: DataFrame, names: list[str], order: list[str], folder: str, drop: tuple[str, ...] = ()) -> None:
    """One file for each value of the three keys, its rows in the given order; the keys are in folder names, not in the files."""
    placed = rows.repartition(*names).sortWithinPartitions(*names, *order).drop(*drop)
    placed.write.option("maxRecordsPerFile", 0).partitionBy(*names).parquet(folder)


def read_files(spark: SparkSession, folder: str, schema: StructType, names: list[str]) -> DataFrame:
    """The rows of such a folder with the keys, the file they are in (day's name + _path) and their place there (_place)."""
    whole = StructType([*schema.fields, *(StructField(n, LongType()) for n in names)])
    found = spark.read.schema(whole).parquet(folder)
    return found.select("*", F.col("_metadata.file_path").alias(f"{names[0]}_path"), F.col("_metadata.row_index").alias(f"{names[0]}_place"))


def file_sizes(files: DataFrame, names: list[str]) -> DataFrame:
    """day, lot, piece, path and n_rows of each file, from a count that reads no column."""
    key = [F.col(n).alias(k) for n, k in zip(names, KEY, strict=True)]
    return files.groupBy(*key, F.col(f"{names[0]}_path").alias("path")).agg(F.count("*").alias("n_rows"))


def plan(sizes: DataFrame, n_rows: int) -> DataFrame:
    """A row for each small file: day, group (in order of opening), turn (in order of joining), lot, piece, path, n_rows,
    joined (how many its group has), first_lot and first_piece (its group's first).

    ``sizes`` has day, lot, piece, path and n_rows; files of S(750) rows or more are left out.
    """
    small = sizes.filter(F.col("n_rows") < share(n_rows, SMALL_SHARE))
    file = F.struct((-F.col("n_rows")).alias("less"), "lot", "piece", "path")
    days = small.groupBy("day").agg(F.sort_array(F.collect_list(file)).alias("files"))
    groups = days.select("day", F.posexplode(F.expr(FOLD.format(capacity=share(n_rows, GROUP_SHARE)))).alias("group", "g"))
    first = F.col("g.members")[0]
    members = groups.select("day", "group", F.size("g.members").alias("joined"), first["lot"].alias("first_lot"), first["piece"].alias("first_piece"), F.posexplode("g.members").alias("turn", "f"))
    return members.select(
        "day", F.col("group").cast("long"), F.col("turn").cast("long"), F.col("f.lot").alias("lot"), F.col("f.piece").alias("piece"),
        F.col("f.path").alias("path"), (-F.col("f.less")).alias("n_rows"), F.col("joined").cast("long"), "first_lot", "first_piece",
    )


class Compaction:
    """One run in a new folder: ``root``/files holds the data, ``root``/staged the new files until they are published."""

    def __init__(self, rows: DataFrame, root: str | None = None) -> None:
        self.spark, self.rows = rows.sparkSession, rows
        self.root = root or shared_path(self.spark, "compaction")
        self.files, self.staged = f"{self.root}/files", f"{self.root}/staged"
        self.names = free_names(rows.columns)

    def run(self) -> DataFrame:
        """The listing after writing, planning, joining and publishing."""
        self.write()
        self.join()
        self.publish()
        return self.listing()

    def read(self) -> DataFrame:
        return read_files(self.spark, self.files, self.rows.schema, self.names)

    def write(self) -> None:
        """Writes the starting files."""
        rows, self.n_rows = keyed(self.rows, self.names)
        write_files(rows, self.names, ["arrived_at", "click_id"], self.files)

    def join(self) -> None:
        """Plans, and writes the joined files beside the folder."""
        self.plan = written(plan(file_sizes(self.read(), self.names), self.n_rows), "compaction-plan")
        day, lot, piece = self.names
        turn, first_lot, first_piece = f"{day}_turn", f"{day}_first_lot", f"{day}_first_piece"
        moves = self.plan.filter("joined > 1").select(F.col("day").alias(day), F.col("lot").alias(lot), F.col("piece").alias(piece), F.col("turn").alias(turn), F.col("first_lot").alias(first_lot), F.col("first_piece").alias(first_piece))
        rows = self.read().drop(f"{day}_path").join(moves, self.names).drop(lot, piece)
        rows = rows.withColumnsRenamed({first_lot: lot, first_piece: piece}).select(*[F.col(f"`{c}`") for c in self.rows.columns], *self.names, turn, f"{day}_place")
        write_files(rows, self.names, [turn, f"{day}_place"], self.staged, drop=(turn, f"{day}_place"))

    def publish(self) -> None:
        """Moves the staged files to their first source's folder, then deletes the sources, a row a file; can be repeated."""
        context = self.spark.sparkContext
        to_path = context._jvm.org.apache.hadoop.fs.Path
        system = to_path(self.root).getFileSystem(context._jsc.hadoopConfiguration())
        staged = system.listFiles(to_path(self.staged), True) if system.exists(to_path(self.staged)) else None
        while staged is not None and staged.hasNext():
            name = staged.next().getPath().toString()
            target = to_path(self.files + name[name.rindex("/staged/") + len("/staged") :])
            if name.endswith(".parquet") and not system.rename(to_path(name), target):
                raise OSError(f"{name} could not be moved")
        for row in self.plan.filter("joined > 1").select("path").toLocalIterator():
            system.delete(to_path(self.files + row.path[row.path.rindex("/files/") + len("/files") :]), False)
        system.delete(to_path(self.staged), True)

    def listing(self) -> DataFrame:
        """A row for each file in the folder, from what is in it now."""
        day = self.names[0]
        key = [F.col(n).alias(k) for n, k in zip(self.names, KEY, strict=True)]
        finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
        totals = self.read().groupBy(*key, F.col(f"{day}_path").alias("path")).agg(
            F.count("*").alias("n_rows"), F.min("click_id").alias("min_click_id"), F.max("click_id").alias("max_click_id"),
            F.sum(F.when(finite, F.floor(100 * F.col("value") + 0.5)).otherwise(0)).alias("cents"),
        )
        ids = self.read().select(*self.names, f"{day}_place", F.col("click_id").cast("string").alias("id"))
        ids = ids.repartition(*self.names).sortWithinPartitions(*self.names, f"{day}_place")
        hashes = ids.select(*key, "id").mapInArrow(id_hashes, "day long, lot long, piece long, ids_sha256 string")
        name = lambda f: F.concat_ws("-", f["lot"].cast("string"), f["piece"].cast("string"))
        groups = self.plan.groupBy("day", F.col("first_lot").alias("lot"), F.col("first_piece").alias("piece"))
        groups = groups.agg(F.sort_array(F.collect_list(F.struct("turn", "lot", "piece"))).alias("all"), (F.max("joined") > 1).alias("rewritten"))
        groups = groups.select(*KEY, F.array_join(F.transform("all", name), ",").alias("sources"), "rewritten")
        out = totals.join(hashes, list(KEY)).join(groups, list(KEY), "left")
        alone = F.concat_ws("-", F.col("lot").cast("string"), F.col("piece").cast("string"))
        return out.select(
            F.nullif("day", F.lit(NO_DAY)).alias("day"), "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents",
            F.coalesce("sources", alone).alias("sources"), "ids_sha256", F.lit(",".join(self.rows.columns)).alias("columns"), "path",
            F.coalesce("rewritten", F.lit(False)).alias("rewritten"),
        )


def id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each key; rows come sorted, so only one digest is open."""
    digest, current = None, None

    def done() -> pa.RecordBatch:
        values = [[x] for x in current] + [[digest.hexdigest()]]
        return pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in values[:3]), pa.array(values[3])], names=[*KEY, "ids_sha256"])

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(3)]
        ids = [x or "" for x in batch.column(3).to_pylist()]
        keys = list(zip(*columns, strict=True))
        begin = 0
        while begin < len(keys):
            end = begin + 1
            while end < len(keys) and keys[end] == keys[begin]:
                end += 1
            text = ",".join(ids[begin:end]).encode()
            if keys[begin] == current:
                digest.update(b"," + text)
            else:
                if digest is not None:
                    yield done()
                digest, current = hashlib.sha256(text), keys[begin]
            begin = end
    if digest is not None:
        yield done()


def compacted(rows: DataFrame) -> DataFrame:
    """Writes the rows into a new shared folder, compacts them there, and lists the files that are left."""
    bound_batches(rows.sparkSession)
    return Compaction(rows).run()
