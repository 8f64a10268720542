"""From raw documents to shards: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's documents. All but the last return the columns of documents. SQL cannot express the first two stages, so the
tests hold them against brute force.

Every stage takes empty tables (and gives them back empty), texts of any length whole, and columns beyond those of
``documents``, whatever their names, which all but the last pass on. What else it does with odd rows stands at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweave.llm.common import materialize, table
from gridweave.llm.decontaminate import drop_contaminated
from gridweave.llm.jaccard import keep_one
from gridweave.llm.mixing import Mix, mix_documents
from gridweave.llm.quality import keep_good
from gridweave.llm.sharding import shards

#: A document is taken once at most: what near-duplicate removal has made single is not repeated.
PIPELINE_MIX = Mix(max_epochs=1)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of quality keep. Null, empty and blank texts have too few words and go; a null id matches no label;
    equal rows are judged alike, and each stays or goes."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the least id, then the least MD5 of its text; of equal rows one. Null,
    empty and blank texts are in no class and all stay; rows with null ids are told apart by their texts."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Null and empty texts have no words and stay; equal rows fare
    alike; items without words, or a null one, take nothing out."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's documents in a seeded order, up to its budget. Null names make a leaf 'unknown'; null and empty texts cost
    nothing and come with whatever stands beside them in the order; a leaf's rows with equal ids, or none,
    are taken together."""
    return mix_documents(docs, PIPELINE_MIX)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document with its shard. Null and empty texts have no bytes; rows with equal ids, or none, share their
    bits and are dealt to overflow pages where they exceed a shard."""
    return shards(docs)


STAGES = [
    ("quality", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``; what is between the stages is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
