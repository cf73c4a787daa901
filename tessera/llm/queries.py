"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, langid, lattice, lexical, neardup, packing, paragraphs, quality, secrets, sessions, sql, substrings, topk
from ._spark import crc_mod, cut, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    described = cut(docs.select("doc_id", quality.description(F.col("text")).alias("x")))  # texts are read once, for training and scores
    model = quality.learn(described, read(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0))
    scored = described.select("doc_id", held.alias("held_out"), quality.rated(model, F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", secrets.scan(F.col("text")).alias("r")).select("doc_id", "r.n_assign", "r.n_access", "r.n_hex", "r.base_sha256", "r.spans")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    return docs.select("doc_id", held.alias("held_out"), langid.identify(model, F.col("text")).alias("r")).select("doc_id", "held_out", "r.lang_pred", "r.score", "r.rejected")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", htmltext.extract(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op12_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.versions(sessions.conversation_events(read(spark, sf_dir, "conversations")))


def op13_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    crc = crc_mod(F.col("doc_id"), 5)
    scored = lattice.score(docs, crc != 1, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.withColumn("held_out", F.coalesce(crc == 1, F.lit(False)))


def queries() -> dict[str, Query]:
    return {"op1_decontam": op1_decontam, "op2_quality": op2_quality, "op3_neardup": op3_neardup, "op4_paragraphs": op4_paragraphs, "op5_substrings": op5_substrings, "op6_topk": op6_topk, "op7_packing": op7_packing, "op8_secrets": op8_secrets, "op9_language": op9_language, "op10_html": op10_html, "op11_lexical": op11_lexical, "op12_sessions": op12_sessions, "op13_lattice": op13_lattice}


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": sql.TOP, "op11_lexical": sql.RANKED, "op12_sessions": sql.SESSIONS}
