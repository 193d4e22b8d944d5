"""From raw documents to shuffled training shards, stage by stage.

Null and empty texts, null ids and sources, repeated rows, texts of any length and columns of other names go
through every stage as its operator states: the classifier scores an empty text like any other; rows without
words are nobody's copies, hit nothing and stay once in the mixture; an empty table gives an empty result.
Rows that repeat an id share what is decided of it.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  Each is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import Scratch, stored, table
from shelfline.llm.decontamination import find_contamination
from shelfline.llm.mixing import mixed_documents
from shelfline.llm.near_dedup import near_duplicates
from shelfline.llm.quality import rated_documents
from shelfline.llm.sharding import shuffle_into_shards

#: Ids of dropped documents that are sent to every task, at most (8 bytes each); more are joined by shuffle.
MOST_SENT = 2_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    rated = rated_documents(docs, table(spark, sf_dir, "labels"))
    return rated.filter("score >= 0.5").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates (five words, 0.8)."""
    found = near_duplicates(docs)
    dropped = stored(found.filter("not kept").select(F.col("doc_id").alias("__id")), "dropped")
    if dropped.count() <= MOST_SENT:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, docs["doc_id"] == dropped["__id"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in a random order over eight shards, with `shard` and `slot`."""
    return shuffle_into_shards(docs, ["doc_id"], n_shards=8)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: A trained model decides in the first stage, which SQL can't express; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        own = Scratch(spark)
        docs = own.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            before.clear()  # the next stage is written, and reads the one before it no more
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
