"""The registered queries of this package, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, chat, fingerprint, htmltext, jaccard, mixing, quality, telephony, toxicity, urls
from tidelog.llm.common import spread, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The conversation that the chat query adds.
ADDED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_table(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted_table(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_table(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in ADDED) + " AS t(conv_id, turn, role, text)")
    return chat.read_back(chat.windows_table(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged_table(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_table(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, columns=["doc_id", "source", "lang"]).select(F.col("row.doc_id").alias("doc_id"), "mix.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.media_table(table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined_table(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_html, op3_fingerprints, op4_chat, op5_urls, op6_mixing, op7_quality, op8_toxicity, op9_telephony, op10_jaccard)}
#: SQL can express none of them whole: a codec, a parser, models and sketches, window formats, closure under links.
ORACLES: dict[str, str] = {}
