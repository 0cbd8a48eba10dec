"""Overlapping text chunks that end at sentence or line ends where possible."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.runtime import prepare

#: Characters of chunks after which a batch is given on.
BATCH_CHARS = 1 << 20


def spans(text: str, size: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(index, start, end, text) of the chunks of one text, in characters.

    A window ends after its last full stop or line end, if that isn't its first
    character. The next begins `overlap` before; where that would not advance,
    it begins at the end, so every text ends.
    """
    out: list[tuple[int, int, int, str]] = []
    if not text.strip():
        return out
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            stop = max(text.rfind(mark, start, end) for mark in ".\n")
            if stop > start:
                end = stop + 1
        body = text[start:end].strip()
        if body:
            out.append((len(out), start, end, body))
        following = end - overlap
        start = following if following > max(0, start) else end
    return out


def _cut(batches: Iterable[pa.RecordBatch], size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Batches of chunks of about BATCH_CHARS characters, however many texts come at once."""
    for batch in batches:
        keys, content = batch.select(["source_doc_id", "doc_ord"]), batch.column("content")
        rows: list[int] = []
        parts: tuple[list, ...] = ([], [], [], [])
        n = 0
        for i in range(batch.num_rows + 1):
            if i == batch.num_rows or n > BATCH_CHARS:
                at = pa.array(rows, pa.int32())
                *numbers, texts = parts
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(at) for c in keys.columns), *(pa.array(x, pa.int32()) for x in numbers), pa.array(texts, pa.string())], ["source_doc_id", "doc_ord", "chunk_index", "start", "end", "text"]
                )
                rows, parts, n = [], ([], [], [], []), 0
            for span in spans(content[i].as_py() or "", size, overlap) if i < batch.num_rows else ():
                rows.append(i)
                n += len(span[3])
                for column, value in zip(parts, span, strict=True):
                    column.append(value)


def chunk_documents(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """docs: id, content, ord. Returns id, text, source_doc_id, chunk_index, start, end, doc_ord; order by (doc_ord, chunk_index)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("id").alias("source_doc_id"), F.col("ord").alias("doc_ord"), "content")
    numbers = [T.StructField(c, T.IntegerType()) for c in ("chunk_index", "start", "end")]
    schema = T.StructType([*(T.StructField(c, rows.schema[c].dataType) for c in ("source_doc_id", "doc_ord")), *numbers, T.StructField("text", T.StringType())])
    rows = rows.mapInArrow(lambda batches: _cut(batches, size, overlap), schema)
    return rows.select(F.concat("source_doc_id", F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("id"), "text", "source_doc_id", "chunk_index", "start", "end", "doc_ord")
