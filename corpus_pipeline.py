"""A training corpus from raw documents in five stages, each reading what the one before kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``, and any others that ``docs`` has, whatever their
names. Every stage gives an empty table for an empty one and reads texts whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm import bpe, jaccard, mixing, quality, toxicity
from tidelog.llm.common import id_text, table
from tidelog.llm.queries import VOCABULARY
from tidelog.llm.saved import Scratch


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier predicts as toxic go. A null or empty text is not toxic; without labels of both classes all stay;
    equal texts, repeated rows among them, go or stay alike; null ids and other nulls play no part."""
    score = toxicity.scorer(id_text(docs), table(spark, sf_dir, "labels"))
    return docs.filter(score("text") < toxicity.THRESHOLD)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as bad go. A null text is judged as an empty one, which goes if its neighbours in the
    sample are bad; without labels all stay; equal texts go or stay alike; null ids and other nulls play no part."""
    score = quality.scorer(id_text(docs), table(spark, sf_dir, "labels"))
    return docs.filter(score("text") >= quality.THRESHOLD)


#: Links of the near-duplicate stage; the numbers of op10_jaccard (90, 3) are that query's alone.
NEAR_PERCENT, NEAR_WORDS = 80, 5


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays: that of least id, of several texts of this id the one of least
    hash, of several rows of this id and text one. Where an id has different texts, each counts with its own group. Texts without words are linked with nothing,
    and only their repeated rows of one id are dropped. Rows with a null id pass."""
    linked = jaccard.joined_table(docs, NEAR_PERCENT, NEAR_WORDS).filter("doc_id IS NOT NULL")
    ends = F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).alias("end")
    kept = linked.filter("n_shingles > 0").groupBy("root").agg(F.min(ends).alias("end")).select("end")
    kept = kept.unionAll(linked.filter("n_shingles = 0").select(ends).distinct()).select("end.*")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("hash"))
    order = Window.partitionBy("id", "hash").orderBy(F.xxhash64("row"))
    once = rows.join(kept, ["id", "hash"], "left_semi").withColumn("turn", F.row_number().over(order)).filter("turn = 1")
    return once.select("row.*").unionAll(docs.filter("doc_id IS NULL"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by the calibrated probabilities of the target weights. Null sources and languages count as ``other``; a document without tokens stays with its
    cell's probability; rows of equal id and text are drawn alike."""
    return mixing.mixed_table(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).filter("mix.kept").select("row.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the ids of every document that is left; a null or empty text has none; null ids and repeated rows stay."""
    return bpe.encoded_table(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity_stage), ("quality", quality_stage), ("near_duplicates", near_duplicates_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: SQL can express neither the two classifiers nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder for the next one."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
