"""A training-corpus pipeline over `documents`: five stages, each one operator of fernweave.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from fernweave.llm.decontaminate import drop_contaminated
from fernweave.llm.mixing import draw
from fernweave.llm.quality import keep_quality, learn_quality
from fernweave.llm.sharding import hilbert_shards
from fernweave.llm.simhash import drop_near_duplicates
from fernweave.llm.store import released, shared_dir

#: How often the mix reads a source at most: sources that it reads less are thinned.
MAX_REPEAT = 1.1
SHARDS = 8
#: Words in a shingle of near duplicates, and the least Jaccard likeness of their shingles.
SHINGLE, SIMILAR = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts."""
    return keep_quality(docs, learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of texts that are SIMILAR or more alike."""
    return drop_near_duplicates(docs, shingle=SHINGLE, similarity=SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mix of their sources reads them."""
    return draw(docs, budget_share=1.0, max_repeat=MAX_REPEAT)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard along the Hilbert curve and their slot in it."""
    return hilbert_shards(docs, SHARDS, "rows").select(*docs.columns, "size", "curve", "shard", "slot")


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: The ranking and the fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; the last one's rows without the texts, which the shards hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        if k:
            released(docs)
        docs = spark.read.parquet(f"{base}/{k}")
    return docs.select("doc_id", "lang", "source", "size", F.crc32("text").alias("text_crc32"), "curve", "shard", "slot")
