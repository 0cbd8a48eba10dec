"""Token ids: a tokenizer with a memory for words, and a bit-plane file format.

Format of a shard, little endian: `BPS1`, mode (0: byte planes, 1: bit planes),
ids in a block, ids, blocks; then for each block its planes, each compressed
with zstandard; then the chunk index, an (offset, size) pair for each plane of
each block; then the index's offset, its crc32 and `BPS1` again. The last block
is filled up with zeros. Any block is read on its own through the index.

Shards are rows (shard, document table, content) of a Parquet table in the
shared folder, so that any executor and any file system that Spark reads can
hold them. They are numbered in doc_id order. A shard holds whole documents and
about SHARD_IDS ids, more only where one document has more.

Edge cases: null and empty texts have the end id alone; null doc_ids come
first; ties, rows of one doc_id, follow in the order of their texts' hashes, so one
doc_id of very many rows is many ranges; repeated rows are all kept; texts are encoded
whole, whatever their length; columns of clashing names are not read; an empty table
gives an empty table.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork import runtime
from braidwork.llm.common import blocks_for, kept, offsets, table, texts, volume

VOCABULARY = "word_bpe_49k.json"
BLOCK_IDS, SHARD_IDS = 1 << 16, 1 << 21
PARTITION_BYTES = 24_000_000
#: Bytes of text encoded at a time, which takes some 40 times their memory.
ENCODE_BYTES = 1_000_000
MAGIC = b"BPS1"
HEAD, FOOT, ENTRY = struct.Struct("<4sBIQI"), struct.Struct("<QI4s"), struct.Struct("<QI")


class WordTokenizer:
    """Encodes with the tokenizers library, each distinct word of a slice once.

    The vocabulary's pre-tokenizer never joins text across a space or line
    break, and its normaliser maps each to one space, so a text's ids are those
    of its parts between them, one after the other. Arrow finds a slice's
    distinct parts. A part of letters below U+0250 and then of ASCII marks is two
    pre-tokens, its lower-case word and the marks. Words go to the library many
    in one text, whose ids are cut after each id that ends a word; marks and all
    other parts go to it one by one.

    Ids of parts are kept from slice to slice, as a part has the same ids wherever
    it stands: of at most PARTS parts of at most LONGEST bytes. When there would be
    more, half as many are kept, those that were in the most slices, older ones
    counting less.
    """

    PARTS, LONGEST = 200_000, 48

    SHAPE = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+[!-/:-@\\[-`{-~]*$"
    MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)  # shares the model; no normalizer: the words are lower case and composed already
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.known = pa.array([], pa.large_string())
        self.flat, self.size, self.seen = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int32)

    def _one(self, parts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and lengths of parts, each encoded by itself."""
        flats, lengths = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for k in range(0, len(parts), 1000):  # the library's encodings are large; ids are kept of them
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(parts[k : k + 1000], add_special_tokens=False)]
            flats.append(np.array([i for x in ids for i in x], "<u4"))
            lengths.append(np.array([len(x) for x in ids], np.int64))
        return flats, lengths

    def _words(self, words: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        import pyarrow.compute as pc

        cuts = pa.array(np.r_[0 : len(words) : 100, len(words)], pa.int32())
        lines = pc.binary_join(pa.ListArray.from_arrays(cuts, words.cast(pa.string())), " ").to_pylist()
        flats = [np.empty(0, "<u4")]
        for k in range(0, len(lines), 100):  # the library's encodings are large; ids are kept of them
            flats += [np.array(e.ids, "<u4") for e in self.words.encode_batch_fast(lines[k : k + 100], add_special_tokens=False)]
        flat = np.concatenate(flats)
        lengths = np.diff(np.flatnonzero(self.ends[flat]) + 1, prepend=0)
        if len(lengths) != len(words):
            return self._one(words.to_pylist())
        return [flat], [lengths]

    def encode(self, bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one after the other, and the offset of each text's first and of the end."""
        import pyarrow.compute as pc

        lists = pc.split_pattern(pc.replace_substring(bodies.cast(pa.large_string()), "\n", " "), " ")
        bounds, coded = offsets(lists) - offsets(lists)[0], lists.flatten().dictionary_encode()
        del lists
        parts = coded.dictionary
        place = pc.fill_null(pc.index_in(parts, value_set=self.known), -1).to_numpy()
        is_new = place < 0
        self.seen[place[~is_new]] += 1
        new = parts.filter(pa.array(is_new))
        flat, size = self._parts(new)
        pieces = place.astype(np.int64)
        pieces[is_new] = len(self.size) + np.arange(len(new))
        pool, sizes = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        self._keep(new, pool, sizes)
        flat, ends = gathered(pool, sizes, pieces[coded.indices.to_numpy()])
        return flat, np.concatenate([[0], ends])[bounds]

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts, one after the other, and their numbers."""
        import pyarrow.compute as pc

        shaped = pc.match_substring_regex(parts, self.SHAPE)
        is_shaped = shaped.to_numpy(zero_copy_only=False)
        some = parts.filter(shaped)
        word = pc.utf8_rtrim(some, self.MARKS)
        marks = pc.replace_substring_regex(some, "^[^!-/:-@\\[-`{-~]+", "")
        word, marks = pc.utf8_lower(word).dictionary_encode(), marks.dictionary_encode()
        rest = parts.filter(pc.invert(shaped))
        pools = [self._words(word.dictionary), self._one(marks.dictionary.to_pylist()), self._one(rest.to_pylist())]
        pool = np.concatenate([x for p in pools for x in p[0]] or [np.empty(0, "<u4")])
        size = np.concatenate([x for p in pools for x in p[1]] + [np.zeros(1, np.int64)])
        n_words, n_marks = len(word.dictionary), len(marks.dictionary)
        pieces = np.full((len(parts), 2), len(size) - 1)
        pieces[is_shaped, 0] = word.indices.to_numpy()
        pieces[is_shaped, 1] = n_words + marks.indices.to_numpy()
        pieces[~is_shaped, 0] = n_words + n_marks + np.arange(len(rest))
        flat, ends = gathered(pool, size, pieces.reshape(-1))
        return flat, np.diff(ends[1::2], prepend=0)

    def _keep(self, new: pa.Array, pool: np.ndarray, sizes: np.ndarray) -> None:
        """Remember new parts; pool and sizes hold the ids of those known and then of these."""
        seen = np.concatenate([self.seen, np.ones(len(new), np.int32)])
        kept_ = np.r_[np.arange(len(self.known)), len(self.known) + np.flatnonzero(np.diff(offsets(new)) <= self.LONGEST)] if len(new) else np.arange(len(self.known))
        if len(kept_) > self.PARTS:
            kept_ = np.sort(kept_[np.argsort(-seen[kept_], kind="stable")[: self.PARTS // 2]])
            seen = (seen + 1) // 2
        self.known = pa.concat_arrays([self.known, new]).take(pa.array(kept_))
        self.flat, _ = gathered(pool, sizes, kept_)
        self.size, self.seen = sizes[kept_], seen[kept_]


def gathered(pool: np.ndarray, size: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The named pieces of a pool, one after the other, and where each ends. Piece i has size[i] items."""
    first = np.cumsum(size) - size
    own = size[pieces]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat((first[pieces] - (ends - own)).astype(np.int32), own)
    at += np.arange(total, dtype=np.int32)
    return pool[at], ends


def word_tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept(f"tokenizer {path}", lambda: WordTokenizer(path))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS, bits: bool = False) -> bytes:
    """A shard's bytes."""
    if block_ids % 8:
        raise ValueError("block_ids must be a multiple of 8")
    coder, body, index = zstandard.ZstdCompressor(level=3), [], []
    n_blocks = -(-len(ids) // block_ids)
    at = HEAD.size
    body.append(HEAD.pack(MAGIC, bits, block_ids, len(ids), n_blocks))
    for b in range(n_blocks):
        part = np.zeros(block_ids, "<u4")
        own = ids[b * block_ids : (b + 1) * block_ids]
        part[: len(own)] = own
        rows = part.view(np.uint8).reshape(-1, 4)
        if bits:
            rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1)
        else:
            rows = rows.T
        for plane in rows:
            data = coder.compress(np.ascontiguousarray(plane).tobytes())
            index.append(ENTRY.pack(at, len(data)))
            body.append(data)
            at += len(data)
    table_ = b"".join(index)
    return b"".join([*body, table_, FOOT.pack(at, zlib.crc32(table_), MAGIC)])


def unpack(content: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids first..last of a shard; reads only the blocks that hold them."""
    magic, bits, block_ids, n, n_blocks = HEAD.unpack_from(content)
    at, crc, end = FOOT.unpack_from(content, len(content) - FOOT.size)
    index = content[at : len(content) - FOOT.size]
    if magic != MAGIC or end != MAGIC or zlib.crc32(index) != crc:
        raise ValueError("not a whole shard")
    last = n if last is None else min(last, n)
    n_planes = 32 if bits else 4
    coder, out = zstandard.ZstdDecompressor(), []
    low, high = first // block_ids, min(n_blocks, -(-last // block_ids)) if last > first else first // block_ids
    for b in range(low, high):
        rows = []
        for p in range(n_planes):
            offset, size = ENTRY.unpack_from(index, (b * n_planes + p) * ENTRY.size)
            rows.append(np.frombuffer(coder.decompress(content[offset : offset + size]), np.uint8))
        rows = np.stack(rows)
        if bits:
            rows = np.packbits(np.unpackbits(rows, axis=1).T, axis=1, bitorder="little")
        else:
            rows = rows.T
        out.append(np.ascontiguousarray(rows).view("<u4").reshape(-1))
    flat = np.concatenate(out) if out else np.empty(0, "<u4")
    return flat[first - low * block_ids : last - low * block_ids]


def write_shards(docs: DataFrame, path: str, end_id: int = 1, vocabulary: str | None = None, shard_ids: int = SHARD_IDS, bits: bool = False) -> None:
    """Writes the documents' ids in ascending doc_id order as shards under path."""
    vocabulary = vocabulary or vocabulary_path()
    rows = texts(docs)
    _, n_bytes = volume(rows)
    kind = dict(rows.dtypes)["doc_id"]
    # rows of one doc_id are dealt by their texts' hash, and equal rows, which may take each other's place, by chance
    rows = rows.withColumns({"h": F.xxhash64("text"), "r": F.rand(0)})
    rows = rows.repartitionByRange(blocks_for(n_bytes, PARTITION_BYTES), "doc_id", "h", "r").sortWithinPartitions("doc_id", "h", "r").select("doc_id", "text")

    def shards(batches):
        from pyspark import TaskContext

        from braidwork.llm.common import gathered_batches

        tokenizer, part, number = word_tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        doc_ids, lengths, bodies, total = [], [], [], 0
        end = np.array([end_id], "<u4").tobytes()

        def flush():
            content = pack(np.frombuffer(b"".join(bodies), "<u4"), bits=bits)
            return pa.RecordBatch.from_pydict({"shard": pa.array([(part << 24) + number], pa.int64()), "n_ids": pa.array([total], pa.int64()), "doc_ids": pa.array([pa.concat_arrays(doc_ids).to_pylist()], pa.list_(doc_ids[0].type)), "lengths": pa.array([lengths], pa.list_(pa.int64())), "content": pa.array([content], pa.binary())})

        for batch in gathered_batches(batches, most=ENCODE_BYTES):
            own_ids = batch["doc_id"]
            flat, at = tokenizer.encode(batch["text"])
            for i in range(batch.num_rows):
                bodies += [flat[at[i] : at[i + 1]].tobytes(), end]
                lengths.append(int(at[i + 1] - at[i]) + 1)
                doc_ids.append(own_ids.slice(i, 1))
                total += lengths[-1]
                if total >= shard_ids:
                    yield flush()
                    doc_ids, lengths, bodies, total, number = [], [], [], 0, number + 1
        if bodies:
            yield flush()

    rows.mapInArrow(shards, f"shard long, n_ids long, doc_ids array<{kind}>, lengths array<long>, content binary").write.parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """Per document, from the shards under path: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.parquet(path)
    kind = dict(shards.dtypes)["doc_ids"][len("array<") : -1]
    # one row for each SHARD_IDS ids: the running sum over them is a millionth of the data
    first = shards.select("shard", "n_ids").withColumn("first", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = shards.select("shard", "doc_ids", "lengths", "content").join(first.select("shard", "first"), "shard")

    def documents(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids = unpack(batch["content"][row].as_py())
                lengths = np.array(batch["lengths"][row].as_py(), np.int64)
                starts = np.cumsum(lengths) - lengths
                body = memoryview(np.ascontiguousarray(ids)).cast("B")
                crc = [zlib.crc32(body[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_ids"][row].values, "start": pa.array(starts + batch["first"][row].as_py()), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64()), "shard": pa.array([batch["shard"][row].as_py()] * len(crc), pa.int64())})

    return rows.select("shard", "doc_ids", "lengths", "content", "first").mapInArrow(documents, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, shard long")


def op7_bit_planes(spark, sf_dir: str) -> DataFrame:
    """Writes all documents' ids as byte-plane shards and reads them back."""
    path = runtime.table_path(spark, "ids")
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_shards(spark, path)
