"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables up to this many bytes may be broadcast; beyond it a shuffle join is planned.
BROADCAST_BYTES = 32 << 20
#: What a partition should hold at least: bytes of files read, short rows written.
PART_BYTES, PART_ROWS = 8 << 20, 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where that is unset and all tasks run on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gapline-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


_made: list[str] = []


def new_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one; ``remove_scratch`` deletes it."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def remove_scratch(spark: SparkSession) -> None:
    """Delete the folders that this session has made, once what reads them has been written elsewhere; checkpoints go with Spark's own cleaner."""
    while _made:
        remove_dir(spark, _made.pop())


def cut(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there.

    If it has at most ``most_rows`` short rows, partitions are merged until
    there are few enough, so that no swarm of tiny files is written.
    """
    shared_dir(df.sparkSession)
    return (df if most_rows is None else df.coalesce(_parts(df.sparkSession, most_rows, PART_ROWS))).checkpoint()


def merged(df: DataFrame) -> DataFrame:
    """``df``, read from files, in partitions of about PART_BYTES at least, if Spark's splits are smaller; two for each core at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(_parts(df.sparkSession, size, PART_BYTES))


def _parts(spark: SparkSession, total: int, each: int) -> int:
    return max(2 * spark.sparkContext.defaultParallelism, min(-(-total // each), 1_000_000))  # unknown sizes are estimated without bound


def remove_dir(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows, of ``row_bytes`` each at most, fit ``limit``.

    ``df`` should be materialised: its rows are counted.  Without the hint
    Spark plans a shuffle join, which holds at any size.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def running_totals(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, into: str, per_group: DataFrame | None = None) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the rows before this one in its group, by (bucket, order).

    ``bucket`` has to be monotone in ``order`` and cuts each group, however
    large, into parts that are summed in tasks of their own; only the parts'
    sums (groups x buckets rows) are then accumulated.  Group and bucket
    columns must not be null.  Both the window and the join are dealt by
    (group, bucket), so the rows are shuffled once.  ``per_group``, with one
    row per group, adds its columns by way of the parts, of which a group has
    a bounded number, and so never meets a large group's rows in one task.
    """
    keys = [*group, bucket]
    parts = df.groupBy(*keys).agg(F.sum(value).alias("_part"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(*keys, F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_base"))
    base = base if per_group is None else base.join(per_group, group)
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inner.join(base, keys).withColumn(into, F.col("_base") + F.col("_within")).drop("_base", "_within")


def copies(df: DataFrame, number: str, at: str, together: int = 100_000) -> DataFrame:
    """Each row as often as ``number`` says, with ``at`` from 0; a row that stands very often is dealt to many tasks."""
    one = df.filter(F.col(number) == 1).withColumn(at, F.lit(0).cast("long"))
    some = df.filter((F.col(number) > 1) & (F.col(number) <= together)).withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.col(number) - 1)))
    many = df.filter(F.col(number) > together).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(number) - 1) / together)))).repartition("_part")
    first = F.col("_part") * together
    many = many.withColumn(at, F.explode(F.sequence(first, F.least(first + together, F.col(number)) - 1))).drop("_part")
    return one.unionByName(some).unionByName(many)


_kept: list[tuple[object, object]] = []


def kept(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in this Python worker for the tasks that follow, but only until another is asked for."""
    if not _kept or _kept[0][0] != key:
        _kept.clear()
        _kept.append((key, make()))
    return _kept[0][1]


def key_digest(*columns: str) -> Column:
    """32 hex digits that order rows at random and alike in every run; null counts as empty."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def row_digest(key: str, text: str) -> Column:
    """32 hex digits that rows share only if they agree in key and text, nulls included."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.sha2(text, 256), F.lit("-"))))
