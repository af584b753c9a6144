"""Helpers shared by the operators: shared storage, word rules, safe names."""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Prefix of working columns, so that no column of the input can clash with one.
P = "_ls_"


@functools.cache
def _one_machine() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lumenscan-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a session on one machine gets a temporary one; a cluster is refused."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = _one_machine()
    return where.rstrip("/")


#: Paths of working tables not deleted yet, oldest first.
_working: list[str] = []


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder, deleted by clean() or when the interpreter ends."""
    if not _working:
        atexit.register(_clean_at_exit, spark)
    path = f"{shared_dir(spark)}/lumenscan/{what}-{uuid.uuid4().hex}"
    _working.append(path)
    return path


def mark() -> int:
    """What clean() takes to delete the working tables made from now on."""
    return len(_working)


def clean(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes the working tables made since a mark(), but for the paths to keep. What still reads them must be over."""
    for path in _working[since:]:
        if path not in keep:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            _working.remove(path)


def _clean_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        clean(spark)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation of what is before."""
    spark = df.sparkSession
    path = fresh_dir(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def paths_of(*tables: DataFrame | None) -> tuple[str, ...]:
    """The paths of tables made by written() that are read."""
    names = {os.path.dirname(x).rsplit("/", 1)[-1] for df in tables if df is not None for x in df.inputFiles()}
    return tuple(w for w in _working if w.rsplit("/", 1)[-1] in names)


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for spark in {t.sparkSession for t in tables if t is not None}:
        gone = paths_of(*tables)
        clean(spark, keep=tuple(w for w in _working if w not in gone))


def joined_hot(left: DataFrame, right: DataFrame, on: list[str], many: str, hot: int, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row a key and in column many the number of left's rows that have it. right becomes a table of the shared folder.

    Keys of more than hot rows are broadcast (there can't be more of them than rows of left / hot), so their rows stay
    where they are; all others are joined by key."""
    right = written(right, "keys")
    high = right.where(F.col(many) > hot)
    if high.isEmpty():
        return left.join(right, on, how)
    first = left.join(F.broadcast(high), on)
    rest = left.join(F.broadcast(high.select(*on)), on, "left_anti").join(right.where(F.col(many) <= hot), on, how)
    return first.unionByName(rest)


def aliased(df: DataFrame) -> DataFrame:
    """df with its columns renamed by position to _ls_0, _ls_1 and so on, so that no name of theirs (dotted, quoted, repeated or our own) matters."""
    return df.toDF(*[f"{P}{i}" for i in range(len(df.columns))])


def at(df: DataFrame, name: str) -> str:
    """The name aliased() gives to a column of df."""
    return f"{P}{df.columns.index(name)}"


def words_of(text: Column) -> Column:
    """Array of the words of text; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), F.array().cast("array<string>"))  # Java's \s is just these six


def let(value: Column, body) -> Column:
    """body(v) where v holds value, computed once: optimised plans would otherwise compute it anew at each use inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_chunks(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """batch in slices of rows whose texts make up about most_bytes; one row is never split."""
    col = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to
