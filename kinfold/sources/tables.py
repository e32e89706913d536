"""Assets and signatures out of the parquet tables: documents, embeddings, conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.signatures import TOKEN, text_signatures, vector_signature


def document_assets(docs: DataFrame) -> DataFrame:
    """Documents as assets: folder its source, path ``lang/doc_id``, size its length, width its words, height its lines."""
    words = F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0))
    lines = F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, F.size(F.split("text", "\n", -1))).otherwise(0)
    path = F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("folder"), path.alias("path"), F.lit("text").alias("kind"), F.coalesce("n_chars", F.lit(0)).alias("size"), words.alias("width"), lines.alias("height"))


def document_signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, phash, dhash)``."""
    return text_signatures(docs.select("doc_id", "text"), "doc_id", "text")


def embedding_signatures(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, phash, dhash)``."""
    p, d = vector_signature(F.col("embedding"))
    return embeddings.select("vec_id", p.alias("phash"), d.alias("dhash"))


def conversation_assets(conversations: DataFrame) -> DataFrame:
    """Conversations as videos: the frame is the first turn's text, the duration the last turn, the size all characters,
    the resolution turns by roles."""
    return conversations.groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("frame"), F.max("turn").cast("double").alias("duration"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("size"),
        F.count("*").cast("int").alias("width"), F.countDistinct("role").cast("int").alias("height"),
    )
