"""Cleaning, chunking and parsing are stateless, so they run on streams as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions.text import clean_text
from braidwork.operators.chunk import chunk_documents


def stream_chunks(spark: SparkSession, path: str, size: int = 800, overlap: int = 150) -> DataFrame:
    """Chunks of the documents (doc_id, text) of Parquet files as they arrive under a path."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = spark.readStream.schema(schema).parquet(path)
    docs = rows.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), clean_text(F.col("text")).alias("content"), F.col("doc_id").alias("ord"))
    return chunk_documents(docs, size, overlap)


def write_chunks(chunks: DataFrame, out: str, checkpoint: str):
    """Appends all that is there now as Parquet and stops."""
    return chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
