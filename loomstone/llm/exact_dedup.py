"""Exact dedup with a persistent digest index: DataFrame operations only.

The index is a table in the catalog, bucketed and sorted by digest, with one row per distinct text. A batch is reduced
to one row per digest (partial aggregation before the shuffle), anti-joined to the index by sort-merge on the buckets,
and what is new is appended. So the index never holds a digest twice, and appending the same batch again adds nothing.
Every verdict is read from the index: a row stays where the index holds that very row.

Defined cases: a null text counts as empty; texts are equal when identical after each run of white space became one
space. Of equal texts the smallest id stays (null ids only stay where the group has no other); of rows that repeat both
id and text one stays. Empty tables give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.common import WS_CLASS, hot_join, removed, written

#: keep_id is the id of the row that stays; run and row_no tell which row of which batch that was.
INDEX_SCHEMA = "digest binary, keep_id long, run string, row_no long"
#: Digests of one bucket: about 200 MB.
BUCKET_ROWS = 2_000_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, digest, row_no) of each row; row_no tells the rows apart."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{WS_CLASS}+", " ")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), row.alias("row_no"))


def buckets_for(rows: int, least: int = 16) -> int:
    """The number of buckets that an index of `rows` digests should begin with: a power of two."""
    return max(least, 1 << (max(1, rows // BUCKET_ROWS) - 1).bit_length())


class DigestIndex:
    """A bucketed and sorted table of INDEX_SCHEMA, made empty where it does not exist.

    With a `path` the files stay there whatever the catalog does: a session whose catalog does not know the table yet
    attaches it by its path. Without one the catalog owns the files.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 16, path: str | None = None):
        self.spark, self.table, self.buckets, self.path = spark, table, buckets, path

    def _made(self) -> None:
        if not self.spark.catalog.tableExists(self.table):
            if self.path:
                at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
            where = f" LOCATION '{self.path}'" if self.path else ""
            self.spark.sql(f"CREATE TABLE {self.table} ({INDEX_SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS{where}")

    def read(self) -> DataFrame:
        self._made()
        return self.spark.table(self.table)

    def drop(self) -> None:
        """Takes the table out of the catalog; files under a `path` stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def append(self, firsts: DataFrame) -> None:
        """Adds the digests of `firsts` (one row each) that the index lacks, found by a sort-merge anti-join; the index side is not shuffled."""
        fresh = written(firsts.join(self.read().hint("merge"), "digest", "left_anti"), "fresh-digests")
        # One file a bucket: the shuffle has the buckets' hash and number.
        dealt = fresh.select(*self.read().columns).repartition(self.buckets, "digest")
        writer = dealt.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.table)
        removed(fresh)


def first_rows(rows: DataFrame, run: str) -> DataFrame:
    """The row that stays of each digest, as the index holds it."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no"))
    return rows.groupBy("digest").agg(first.alias("first")).select("digest", F.col("first.doc_id").alias("keep_id"), F.lit(run).alias("run"), F.col("first.row_no").alias("row_no"))


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, batches: int = 1) -> DataFrame:
    """Judges `docs` against itself and the index, and appends what is new.

    One row per row of `docs`: doc_id, keep_id, group_size (rows of `docs` with that text), kept, text_sha256, and
    row_no (`row_col`, if given, which must tell the rows apart). A text that the index held before has the id in the
    index as keep_id, and none of its rows is kept. The rows reach the index in `batches` ranges of ascending ids, null
    ids with the last, each anti-joined to what the ranges before it left there.
    """
    run, rows = uuid.uuid4().hex, written(digests(docs, id_col, text_col, row_col), "digests")
    ends = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).first()
    if batches > 1 and ends["lo"] is not None:
        cuts = [ends["lo"] + (ends["hi"] - ends["lo"] + 1) * k // batches for k in range(1, batches)]
        parts = [F.col("doc_id") < cuts[0], *((F.col("doc_id") >= a) & (F.col("doc_id") < b) for a, b in zip(cuts, cuts[1:], strict=False)), (F.col("doc_id") >= cuts[-1]) | F.col("doc_id").isNull()]
    else:
        parts = [F.lit(True)]
    for part in parts:
        index.append(first_rows(rows.where(part), run))
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    held = index.read().select("digest", "keep_id", "run", F.col("row_no").alias("kept_row")).hint("merge")
    groups = written(sizes.join(held, "digest"), "digest-groups")
    joined = hot_join(rows, groups, "digest", "group_size", ends["n"])
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        ((F.col("run") == run) & (F.col("row_no") == F.col("kept_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row_no",
    )
