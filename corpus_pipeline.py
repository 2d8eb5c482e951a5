"""From raw documents to a tokenised training mix: five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import exact_dedup, language_id, mixing, near_join, sentencepieces
from larkspur.llm.common import mark, release, shared_dir, table
from larkspur.llm.queries import tokenizer

#: A text of which no language is likelier than this is rejected, as is one without letters.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages."""
    model = language_id.train(docs, language_id.learnable())
    found = language_id.identify(docs, model, keep=tuple(docs.columns))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest id."""
    return exact_dedup.exact_dedup(docs).where("kept").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that with the least id."""
    return near_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixing.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document of the mix."""
    return sentencepieces.encode(docs, tokenizer(), keep=("doc_id", "lang", "source"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("sentencepieces", pieces)]

#: Code lengths, minimum hashes and merges are not expressible in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written for itself is removed with its end, its result with the next one's.

    Rows may repeat, ids, texts and sources may be null, texts of any length are read whole, and an empty table gives an empty result; each stage's operator says how it treats these.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    since = mark(spark)
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, *before, since=since)
        docs, before = spark.read.parquet(path), [path]
    return docs
