"""A training corpus in five stages, each a filter or a rearrangement of the documents before it.

Quality classifier, near-duplicate removal, benchmark decontamination, source mixing, sharding.
Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as
Parquet to the shared folder and hands the written table to the next stage. All stages but the last
return the columns of their input; the last one adds the shard. What a stage writes on its way is deleted when
its result stands.

Defined cases: null, empty and wordless texts get the classifier's bias like any text without
features, are no near duplicates, share no benchmark window, and have no words, so the mix takes
none of them. Rows without an id are judged by their text. Without labels every score is 0.5 and the
classifier keeps all; without benchmark items nothing is contaminated; an empty table passes through
as one. Only doc_id, text and source are needed; other columns ride along, whatever their names,
and n_chars follows a cut text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partmill.llm.common import table
from partmill.llm.decontaminate import without_contaminated
from partmill.llm.extendible_shards import assign_shards
from partmill.llm.mixing import mixed_documents
from partmill.llm.near_dedup import one_of_each
from partmill.llm.subword_quality import good_documents
from partmill.scale import scratch_path, scratch_scope


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier scores below 0.5; it learns from the labelled documents at hand."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates keep the document with the smallest id, and one row of it."""
    return one_of_each(docs, repeats=False)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that share ten words in a row with a benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, drop or cut documents until every source has its share of the words."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every document the shard it is written to."""
    return assign_shards(docs)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("decontamination", drop_contaminated),
          ("mixing", mix_sources), ("sharding", shard)]

#: The classifier and the signatures have no SQL equivalent; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"corpus-{name}")  # outlives the stage's own scratch tables
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
