"""What the training-data operators share: written intermediate tables, joins that survive hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every operator's contract: space, tab, line feed, vertical tab, form feed, carriage return.
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: At most this many keys can each hold more than 1/HOT_KEYS of the rows, so a table of hot keys has a proven bound.
HOT_KEYS = 10_000
HOT_LEAST = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where none is named, a local master gets a temporary one; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and the executors share")
        named = tempfile.mkdtemp(prefix="loomstone-")
        atexit.register(shutil.rmtree, named, True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what lies there is removed when the driver ends."""
    path = f"{shared_dir(spark)}/loomstone/{label}-{uuid.uuid4().hex}"
    where, files = _files(spark, path)
    files.mkdirs(where.getParent())
    files.create(where).close()  # only what exists can be marked
    files.deleteOnExit(where)
    files.delete(where, True)
    return path


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if _made:
        _made[-1].append(out)
    return out


#: The tables written in each open scratch().
_made: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the tables that are written within, but for the last one, when all is done."""
    _made.append([])
    try:
        yield
    finally:
        removed(*_made.pop()[:-1])


def removed(*tables: DataFrame | None) -> None:
    """Removes written tables that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "written_at", None):
            where, files = _files(table.sparkSession, path)
            files.delete(where, True)


def with_row_key(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """`docs` as a written table with a column that tells its rows apart, and that column's name (none of `docs` has it)."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), label), name


def whole_text(column: str) -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def hot_join(rows: DataFrame, groups: DataFrame, key: str | list[str], count: str, n_rows: int) -> DataFrame:
    """Inner join of `rows` with one row of `groups` per key, where `groups[count]` is the number of rows of the key.

    Keys with at least max(HOT_LEAST, n_rows / HOT_KEYS) rows are joined by broadcast: there are at most HOT_KEYS of
    them. Every other key has fewer rows than that, so no task of the sort-merge join gets a hot group.
    Both sides should be written tables, as each is read twice.
    """
    limit = max(HOT_LEAST, n_rows // HOT_KEYS)
    keys = [key] if isinstance(key, str) else key
    hot = groups.where(F.col(count) >= limit)
    cold = groups.where(F.col(count) < limit)
    many = rows.join(F.broadcast(hot), keys)
    few = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return many.unionByName(few)
