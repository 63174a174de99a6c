"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input.

Quality filter, near-duplicate removal, benchmark decontamination, mixing along the curriculum, token
shards. All stages but the last return the columns of ``documents``, and extra ones too, whatever their names
but for those that begin with ``__``.

Null and empty texts: scored by the classifier's bias alone, in no near-duplicate group, in no leak, mixed
with size 0, one end id as tokens. Rows without a doc_id are scored like others, never learnt from, and stay:
no group or leak can name them. Of rows that share a doc_id one stays after the near-duplicate stage. Very long
texts go through whole, one at a time in a task. An empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import decontaminate, mixing, near_dup, quality, token_shards
from lumenframe.plans.staging import Staged, new_path

QUALITY_AT_LEAST = 0.3
NEAR = 0.8


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id isn't among ``ids``; rows without a doc_id stay."""
    return docs.join(ids.select(F.col("doc_id").alias("__gone")).distinct(), F.col("doc_id") == F.col("__gone"), "left_anti")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit_on(docs, labels, "crc32(cast(doc_id as string)) % 5 <> 0")
    last = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != "text"), "text")
    return quality.score_quality(last, model, "__score").where(F.col("__score") >= QUALITY_AT_LEAST).select(*(F.col(f"`{c}`") for c in docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the smallest doc_id; of rows that share a doc_id, one."""
    found = Staged(near_dup.near_duplicates(docs, NEAR), "groups").df
    out = _without(docs, found.where("doc_id is not null and not kept"))
    twice = found.where("doc_id is not null and kept").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count()
    if twice:
        out = out.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id is null"))
    return out


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    pairs = decontaminate.contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, pairs.where("doc_id is not null"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, sorted by training position."""
    return mixing.mix(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards written and read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return token_shards.read_shards(token_shards.write_shards(docs, new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each),
    ("decontamination", no_benchmark),
    ("mixing", mixed),
    ("token output", token_files),
]
#: The classifier, MinHash groups and tokens aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = Staged(docs, "stage").df
    return docs
