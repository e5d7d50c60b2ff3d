"""A corpus prepared for training: the stages in order, each over all that the one before kept.

Every stage but the last returns the columns of ``documents``. Toxic documents,
all but one of each group of near copies, and documents with benchmark passages
go; live-looking secrets are masked in the texts that stay; the last stage packs
these into sequences of token ids.

Defined results: a null or wordless text is harmless, is no other's copy, holds no
passage and no secret, and so stays, to be packed as a closing id alone; very long
texts are read whole in every stage, each in one task's memory; rows of a null id
are documents like others, but one with an id is kept before them; of rows alike in
id and text one stays; documents without a source have their secrets masked, as a
null owner is none; empty tables give no rows; columns beside those of the table go
along to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import credentials, decontaminate, near_dups, packing, toxicity
from heddle.llm.store import columns_of, dropped, written


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that are predicted toxic, by a model of the labels that aren't held out."""
    return toxicity.harmless(docs, toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id."""
    return near_dups.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold passages of the benchmark."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked unless they are widely copied examples; ``n_chars`` follows the text."""
    out = credentials.redacted(docs, repository=F.struct("source", "lang"))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*columns_of(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", harmless),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", decontaminated),
    ("secret scans", masked),
    ("packing", packed),
]

#: SQL has no tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each stage keeps is written to the shared folder and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), f"stage-{i + 1}")
        if last is not None:
            dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
