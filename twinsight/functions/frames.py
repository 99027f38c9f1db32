"""Small helpers on whole DataFrames."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """A column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def merge_one_row_frames(*frames: DataFrame) -> DataFrame:
    """Put the columns of several one-row frames side by side without a cross join."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="twinsight-")
            context.setCheckpointDir(folder)
            folder = context.getCheckpointDir()
    return folder


def new_folder(spark: SparkSession, kind: str = "tables") -> str:
    """An unused path in the shared folder, removed with the tables of its scope."""
    if not any(_SCOPES):
        atexit.register(release, spark)
    path = f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"
    _SCOPES[-1].append(path)
    return path


def materialise(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result survives lost executors, is column-pruned on reading, and carries a true
    size, so that the planner's broadcast decision rests on bytes and not on a guess.
    The table lives as long as the scope it was written in (``own_tables``), outside any until ``release``. Readers take in
    thousands of rows of a file at once, so large rows need files of few (0: as many as a task has).
    """
    path = new_folder(df.sparkSession)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._folder = path
    return table


def drop_table(table: DataFrame) -> None:
    """Remove a table that ``materialise`` wrote in the innermost scope; nothing that reads it may be used after it."""
    _SCOPES[-1].remove(table._folder)
    remove_folders(table.sparkSession, [table._folder])


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs that run inside; what is planned after the block has the former ones."""
    former = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in former.items():
            spark.conf.set(name, value)


def small_batches(spark: SparkSession, most: int):
    """Settings under which tasks hand rows to Python workers in batches of about ``most`` bytes, and of a row at least."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    return settings(spark, {name: f"{min(most, now)}b"})


def shuffles_removed(spark: SparkSession):
    """Settings under which the shuffle files of a job go when it ends, and not when the driver collects its garbage."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


#: Folders written, by open scope; the first one stands for the whole program.
_SCOPES: list[list[str]] = [[]]


def sums_before(df: DataFrame, order: list[Column], what: Column, out: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``what`` over all rows that come before a row in a total order.

    The rows are dealt by range and written; running sums stay inside a part, and the parts' totals, one row a
    part, give where it begins. No window holds more than a part, and nothing goes to the driver. Merge rows with equal
    order first: they are never parted.
    """
    dealt = materialise(df.repartitionByRange(*order).withColumns({"_part": F.spark_partition_id(), "_what": what}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(F.sum("_what").alias("_total"))
    starts = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("_what").over(inside), F.lit(0))
    return dealt.withColumn("_within", within).join(starts, "_part").withColumn(out, F.col("_within") + F.col("_start")).drop("_part", "_what", "_within", "_start")


def rows_in_order(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """``df`` with ``rank``, the 0-based place of each row in a total order."""
    return sums_before(df, order, F.lit(1).cast("long"), rank)


def running_sums(df: DataFrame, by: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """``df`` with each of ``columns`` replaced by its sum over the row and all rows before it of the same group.

    ``by`` names the group and holds no null; inside a group the order is total. Rows are dealt by range and written, so a group may
    span any number of parts. The window across parts has one row for each part that a group lies in.
    """
    dealt = materialise(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part", *by).agg(*[F.sum(c).alias(c) for c in columns])
    starts = totals.select("_part", *by, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_from_{c}") for c in columns])
    within = dealt.withColumns({f"_in_{c}": F.sum(c).over(inside) for c in columns}).join(starts, ["_part", *by])
    return within.select(*[(F.col(f"_in_{c}") + F.col(f"_from_{c}")).alias(c) if c in columns else quoted(c) for c in df.columns])


#: Rows from which on a group is broadcast to its rows: there are few such groups.
HEAVY_ROWS = 1_000_000


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, spread: Column, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of their group; rows without one go. A null group is one of its own.

    ``groups`` has one row per ``key`` with its number of rows ``n``. Groups of many rows are broadcast, and their rows are dealt by ``spread``, so
    that no task gets a whole one; all other groups are joined by key.
    """
    found = {c: f"_light_{c}" for c in columns}
    # ``_none`` is 0 but no literal: as one it would be no key of the join, and a group would go to one task after all.
    heavy = groups.filter(F.col("n") >= HEAVY_ROWS).select(F.col(key).alias("_heavy"), F.lit(True).alias("_is_heavy"), *[F.col(c).alias(f"_heavy_{c}") for c in columns])
    light = groups.filter(F.col("n") < HEAVY_ROWS).select(F.col(key).alias("_light"), F.least(F.col("n"), F.lit(0)).cast("long").alias("_none"), F.lit(True).alias("_is_light"), *[F.col(c).alias(n) for c, n in found.items()])
    marked = rows.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_heavy")), "left")
    marked = marked.withColumn("_salt", F.when(F.col("_is_heavy"), F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1).otherwise(F.lit(0).cast("long")))
    both = marked.join(light, F.col(key).eqNullSafe(F.col("_light")) & (F.col("_salt") == F.col("_none")), "left").filter("_is_heavy OR _is_light")
    picked = [F.when(F.col("_is_heavy"), F.col(f"_heavy_{c}")).otherwise(F.col(n)).alias(c) for c, n in found.items()]
    return both.select(*[quoted(c) for c in rows.columns], *picked)


class own_tables:
    """``with own_tables(spark) as outer``: what is materialised inside goes when the block ends.

    ``outer.keep(df)`` writes a result that outlives the block: it belongs to the scope around it. Nothing else that
    reads the block's tables may be used after it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> own_tables:
        _SCOPES.append([])
        self.depth = len(_SCOPES)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        kept = materialise(df)
        _SCOPES[self.depth - 2].append(_SCOPES[-1].pop())
        return kept

    def __exit__(self, *failure) -> None:
        remove_folders(self.spark, _SCOPES.pop())


def remove_folders(spark: SparkSession, paths: list[str]) -> None:
    """Remove what was written to the paths, wherever they are."""
    context = spark.sparkContext
    for path in paths:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Remove every table that ``materialise`` wrote; call it once the results have been read.

    It also runs when the program ends, if the session is still there.
    """
    try:
        remove_folders(spark, [path for scope in _SCOPES for path in scope])
    except Exception:  # the session has ended: nothing can be reached through it any more
        return
    for scope in _SCOPES:
        scope.clear()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    Needed where it is not installed on the executors; harmless where it is.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='twinsight-ship-')}/{package.name}", "zip", package.parent, package.name
    )
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
