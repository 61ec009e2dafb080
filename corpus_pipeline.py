"""A training-corpus pipeline: toxic texts go, near-duplicates and benchmark leaks go, sources are mixed and sharded.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents; the last returns a row for each copy in the mix
with its shard and slot.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, an
empty table (which gives an empty one) and further columns of any name, which all but the
last hand on; what each does with them stands below and with its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnwatch.llm import decontaminate, mixing, sharding, simhash, toxicity
from cairnwatch.llm.common import cut, tidy


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that score 0.3 or more; the model learns from labelled rows of docs outside the held-out fold.

    Null and empty texts score as one empty word, very long ones by their strongest window;
    repeated rows go or stay alike; without labels of both kinds all score alike.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model, threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of texts whose 5-word shingles are 0.8 alike or more the row with the smallest doc_id.

    Null and empty texts are one group; a null doc_id comes after all others; of rows that
    tie in id and text the one with the smallest hash of all columns stays.
    """
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item.

    Null and empty texts stay, and so does everything if the benchmark is empty; items
    without text, words or id drop nothing.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source's tokens come to its weight's share.

    A null source is one of its own; texts without words keep a copy, or the cap's number
    where their source is at its cap; repeated rows share their number of copies.
    """
    return mixing.mixed(docs, weights=(1, 2, 3), cap=3)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts every row of the mix into one of 24 shards of equal counts, copies together.

    Null texts are empty (size 8) and lie with the empty ones; equal texts are parted only
    where no shard holds them.
    """
    rows = sharding.assign(docs, shards=24)
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot")


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("mixing", mix), ("sharding", shards)]

#: Learning, fingerprints and propagation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; tables of earlier stages are deleted at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
