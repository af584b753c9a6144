"""Cutting the lineage of iterative plans, and numbering rows of groups of any size."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared folder of spark.checkpoint.dir; where that is unset, a session on one machine gets a temporary one, a cluster is refused."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="lumenscan-"))
    if sc.applicationId not in _seen:
        _seen.add(sc.applicationId)
        atexit.register(_clean, sc)
    return df.checkpoint()


#: Applications whose checkpoints are deleted when the interpreter ends.
_seen: set[str] = set()


def _clean(sc: SparkContext) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        path = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())  # the application's own folder
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def spread(rows: DataFrame, by: str, most: int) -> DataFrame:
    """rows over tasks of about `most` of them, by the hash of a column; fewer where cores would stay idle, but most / 8 at least. For small rows that stand for much work, which one block of a table holds by the million. Counts rows."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, -(-n // most), min(cores, n * 8 // most)), by)


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], to: str = "idx") -> DataFrame:
    """rows with their number (from 0) within their group, by order.

    Rows are range-partitioned on group and order, numbered within their partition, and given the number of the group's
    rows in the partitions before (one small row a group and partition): a group of any size is spread over tasks. Rows
    that are equal in group and order stand in one partition, in any order."""
    keys = [f"{to}_o{i}" for i in range(len(order))]
    placed = rows.withColumns({k: F.col(o) if isinstance(o, str) else o for o, k in zip(order, keys)})
    placed = cut(placed.repartitionByRange(*group, *keys).withColumn(f"{to}_part", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy(*group, f"{to}_part").orderBy(*keys)) - 1
    sizes = placed.groupBy(*group, f"{to}_part").agg(F.count("*").alias(f"{to}_n"))
    earlier = Window.partitionBy(*group).orderBy(f"{to}_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(g).alias(f"{to}_g{i}") for i, g in enumerate(group)], F.col(f"{to}_part").alias(f"{to}_p"), F.coalesce(F.sum(f"{to}_n").over(earlier), F.lit(0)).alias(f"{to}_before"))
    same = [F.col(g).eqNullSafe(F.col(f"{to}_g{i}")) for i, g in enumerate(group)]
    joined = placed.withColumn(f"{to}_own", own).join(offsets, [*same, F.col(f"{to}_part") == F.col(f"{to}_p")])
    return joined.select(*rows.columns, (F.col(f"{to}_own") + F.col(f"{to}_before")).cast("long").alias(to))
