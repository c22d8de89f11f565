"""Parquet table source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from charterloom.plans.materialize import materialize

#: A list of at most so many keys is broadcast (some tens of megabytes on an executor).
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Scan ``directory/name.parquet``; columns are pruned by the plans above it."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast if its counted ``rows`` of a few numbers are at most ``BROADCAST_KEYS``; else its joins shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_KEYS else df


def latest_rows(df: DataFrame, key: str, at: str, columns: list[str], spread: bool = False) -> DataFrame:
    """One row per ``key``: the latest by ``at`` (null times first, then by value).

    Repeated rows of a record are the same record.  Keys that stand in more
    than one row are found first, from the key column alone; only their rows
    are shuffled with what they hold, combined before that, so a key that
    holds a third of all rows stays small.  All other rows stay where they are.
    ``spread`` deals the rows of a scan of fewer partitions than cores (a few
    small files) out to all of them, for costly stages that follow.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    spread = spread and df.rdd.getNumPartitions() < cores
    dealt = lambda x: x.repartition(cores) if spread else x
    rows = df.where(F.col(key).isNotNull()).select(key, F.col(at).alias("_at"), *[F.col(c) for c in columns])
    repeated = materialize(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key), "repeated")
    n = repeated.count()
    if not n:
        return dealt(rows.select(key, *columns))
    repeated = bounded(repeated, n)
    packed = F.struct(F.col("_at").isNotNull().alias("_known"), "_at", *[F.col(c) for c in columns])
    best = rows.join(repeated, key, "left_semi").groupBy(key).agg(F.max(packed).alias("_best"))
    once = dealt(rows.join(repeated, key, "left_anti").select(key, *columns))
    return once.unionByName(best.select(key, *[F.col(f"_best.{c}").alias(c) for c in columns]))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``, the place of each row in ``order`` from 0 on.

    Rows are range-partitioned, each range counts its own, and the offsets
    come from the counts, so no task sees more than its range.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.join(F.broadcast(offsets.select("_part", "_offset")), "_part").withColumn(name, F.col("_offset") + rank).drop("_part", "_offset")
