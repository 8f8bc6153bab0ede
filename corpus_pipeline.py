"""From documents to packed training sequences: toxic texts go, then copies and near copies, then private data.

Every stage takes what the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pictorium.llm import common, exact_dedup, near_dedup, packing, pii, toxicity
from pictorium.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
SIMILAR_PERCENT = 80

# Scratch tables of the stage before, by application: no longer read once the next stage begins.
_LEFT: dict[str, list[str]] = {}


def _stage(fn):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        common.release(spark, _LEFT.pop(app, []))
        before = set(common.scratch_tables(spark))
        found = fn(spark, docs, sf_dir)
        _LEFT[app] = [t for t in common.scratch_tables(spark) if t not in before]
        return found

    run_stage.__name__, run_stage.__doc__ = fn.__name__, fn.__doc__
    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the models, learnt from these documents and the labels, do not call toxic."""
    return toxicity.reject(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the largest id."""
    return exact_dedup.deduplicate(docs, keep="largest")


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the document with the smallest id."""
    return near_dedup.keep_one(docs, percent=SIMILAR_PERCENT)


@_stage
def remove_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, private data in their texts replaced by labels."""
    return pii.redact(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each run of tokens of each document lies in which sequence."""
    found = packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, added_tokens=True)
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("pii", remove_private_data),
    ("packing", pack_sequences),
]

# Models, near duplicates and tokens are beyond SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the result is written and read like that of every stage."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            common.release(spark, [last])
        last = path
    return docs
