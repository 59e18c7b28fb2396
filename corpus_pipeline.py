"""The corpus pipeline: documents of good quality, each text once, one of each group of near copies, none that holds a
benchmark item, and at last how many words of each the mix of sources takes.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
`run` writes each stage's result as Parquet in the shared folder and rereads it as the next stage's input.

Defined cases: rows are told apart by keys of their own, so rows with a null or repeated doc_id are judged like any other.
A null text counts as empty; of all empty texts one stays, if the classifier lets it. A null id is larger than any other,
of rows that tie in id one stays. Nulls in lang, source or n_chars change nothing (a null source is a source of its own).
Empty tables give empty results; extra columns of `documents` pass all stages but the last, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import decontaminate, exact_dedup, mixing, quality, simhash
from loomstone.llm.common import fresh_path, removed, scratch, with_row_key, written
from loomstone.llm.queries import HELD_OUT, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), usable=~F.expr(HELD_OUT.format("mark_id")))
    return quality.keep_good(docs, model)


def once_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the row with the smallest doc_id (null last), and one of rows that tie."""
    keyed, row = with_row_key(docs, "exact-rows")
    name = f"pipeline_digests_{uuid.uuid4().hex}"
    index = exact_dedup.DigestIndex(spark, name, exact_dedup.buckets_for(keyed.count()), fresh_path(spark, name))
    judged = exact_dedup.exact_dedup(keyed, index, row_col=row)
    gone = written(judged.where(~F.col("kept")).select(F.col("row_no").alias(row)), "exact-copies")
    index.drop()
    return keyed.join(gone, row, "left_anti").drop(row)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 or more over five-word shingles, keeps the smallest doc_id.

    SimHash with pigeonring proposes pairs that the shingle sets check; an exact way finds those that it leaves.
    """
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold 0.8 or more of a benchmark item's five-word shingles."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document that is left."""
    placed, slots, _ = mixing.mix(docs)
    return mixing.taken_words(placed, slots)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", once_each),
    ("SimHash near-dedup", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
]

#: Fingerprints, the fitted model and the permutations have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scratch():
            docs = written(stage(spark, before, sf_dir), "pipeline-" + name.replace(" ", "-"))
        removed(before)
    return docs
