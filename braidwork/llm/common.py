"""What the corpus operators share: reading columns, sizing blocks, word hashes."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork import runtime

U64 = np.uint64
prepare = runtime.prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and the named columns; all others are pruned."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def volume(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column: one aggregate, two numbers."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(column))).first()
    return row[0], row[1] or 0


def blocks_for(n_bytes: int, block_bytes: int) -> int:
    return max(1, math.ceil(n_bytes / block_bytes))


def kept(name: str, make):
    """A value that this Python process keeps between tasks (a vocabulary, a tokenizer)."""
    store = sys.__dict__.setdefault("_braidwork_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]


class WordHashes(dict):
    """bytes -> 64-bit hash. Holds a bounded number of words and starts anew beyond."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def word_hashes() -> WordHashes:
    return kept("word_hashes", WordHashes)


def forget() -> None:
    """Empty the hash memories at a task's end: its worker may wait beside another operator's, and hashes are soon made anew."""
    for value in sys.__dict__.get("_braidwork_kept", {}).values():
        if isinstance(value, WordHashes):
            value.clear()
    trim()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place where it can be."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def bounded(small: DataFrame, n_bytes: int, row: str = "48") -> DataFrame:
    """small for a broadcast if its rows, of `row` bytes each (an expression), hold at most n_bytes together; else as it is. It must be written."""
    size = small.agg(F.sum(F.expr(row).cast("long"))).first()[0] or 0
    return F.broadcast(small) if size <= n_bytes else small


#: A key of more than HOT_ROWS rows, and of more than their number / HOT_KEYS, is hot. So HOT_KEYS bounds the hot keys.
HOT_ROWS, HOT_KEYS = 20_000, 100_000


def hot_from(n_rows: int, hot_rows: int = HOT_ROWS) -> int:
    """A key of more rows than this is hot."""
    return max(hot_rows, n_rows // HOT_KEYS)


def joined_by(rows: DataFrame, few: DataFrame, on: list[str], count: str, least: int) -> DataFrame:
    """rows joined with few (one row a key, `count` of them in rows at most), without sending the rows of keys of more than `least`.

    few must be written, not computed in this plan: then an uneven partition can be split, too.
    """
    hot = few.filter(F.col(count) > least)
    if hot.isEmpty():
        return rows.join(few, on)
    hot = F.broadcast(hot)
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(few.filter(F.col(count) <= least), on))


def trim() -> None:
    """Give freed memory back: workers live on between tasks, beside the executor's heap."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def planes(values: np.ndarray) -> bytes:
    """The bytes of an integer array, plane by plane, so that zstandard finds the empty ones."""
    import zstandard

    raw = np.ascontiguousarray(values)
    flat = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(flat).tobytes())


def unplanes(data: bytes, kind) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000):
    """Parts of a batch whose column holds about `most` bytes; a longer value comes alone."""
    lengths = np.diff(offsets(batch.column(column)))
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def gathered_batches(batches, column: str = "text", most: int = 8_000_000):
    """Batches joined, and split where need be, so that each holds about `most` bytes of the column."""
    held, total = [], 0
    for batch in batches:
        for part in slices(batch, column, most):
            n = int(np.diff(offsets(part.column(column))[[0, -1]])[0])
            if held and total + n > most:
                yield joined(held)
                held, total = [], 0
            held.append(part)
            total += n
    if held:
        yield joined(held)
    trim()


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if len(batches) > 1 else batches[0]


def offsets(column: pa.Array) -> np.ndarray:
    """Value offsets of a string or binary array, as Arrow holds them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]


def utf8(column: pa.Array) -> list[bytes]:
    """The values' UTF-8 bytes, without a detour over str; nulls are empty."""
    if len(column) == 0:
        return []
    at, data = offsets(column), column.buffers()[2]
    view = memoryview(data) if data is not None else memoryview(b"")
    return [bytes(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
