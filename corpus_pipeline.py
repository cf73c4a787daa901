"""Corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Each stage works on all rows that its predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, neardup, packing, secrets
from tessera.llm._spark import few, fresh_dir, small_batches


def spare(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name in docs.columns:
        name += "_"
    return name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents far from every known language go, and so do those without a letter, null texts among them; a missing
    lang is filled in."""
    small_batches(spark)
    model = langid.fit(docs)
    found = spare(docs, "found")
    read = docs.select("*", langid.identify(model, F.col("text")).alias(found)).where(~F.col(found).getField("rejected"))
    return read.withColumn("lang", F.coalesce("lang", F.col(found).getField("lang_pred"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicate texts the one with the smallest id stays; of rows alike in id and text, one.

    Rows that repeat an id with different texts are documents of their own.
    """
    small_batches(spark)
    found = neardup.text_classes(docs).where("not first or n > 1")
    id_, print_, row = (spare(docs, x) for x in ("marked_id", "marked_print", "row"))
    marks = few(found.select(F.col("id").alias(id_), F.col("print").alias(print_), "first"))
    own = (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(print_))
    once = docs.join(marks.drop("first"), own, "left_anti")
    alike = docs.join(marks.where("first").drop("first"), own).groupBy(id_, print_).agg(F.min(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
    return once.unionByName(alike)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    small_batches(spark)
    return docs.where(~decontam.contains_item(F.col("text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars follows the text."""
    small_batches(spark)
    name = spare(docs, "clean")
    clean = docs.withColumn(name, secrets.redact(F.col("text")))
    moved = F.col(name).isNotNull() & (F.col(name) != F.col("text"))
    return clean.withColumn("n_chars", F.when(moved, F.length(name).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).withColumn("text", F.col(name)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row for each piece of a document, with its sequence and place."""
    small_batches(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: No stage's rows can be expressed in SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = fresh_dir(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        out = f"{home}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
