"""Removal of long repeated substrings with a distributed difference-cover suffix sort.

A byte is removed if a string of LENGTH bytes that covers it also starts
anywhere else, in any document. Strings never cross documents.

Distribution. Suffixes that share LENGTH bytes must meet in one sort, so they are
dealt by content: each string of LENGTH bytes has a minimizer, the leftmost of
its GRAM-byte grams of least hash, and equal strings have equal minimizers at
equal places. Neighbouring strings of one minimizer form a segment. Segments of
a minimizer that occurs once hold nothing repeated and go no further. Equal
segments become one, with their number, before they are sent, so copies of a
passage, however many, are sent and sorted once.

Sort. The distinct segments of a partition's minimizers are one text, whose
suffixes are sorted by the difference cover modulo 3: triples at positions 1 and
2 modulo 3 are sorted and named, the string of names is sorted by recursion, the
remaining suffixes are sorted by their first byte and the rank that follows, and
both are merged. Then adjacent suffixes' first LENGTH bytes are compared.
Segments that are alone with their minimizer need no sort: their number decides.

Hot keys. Joins with the rows of a minimizer, a segment or a repeated row split
off the keys of more than HOT_ROWS rows. Those are at most HOT_KEYS, as each has
that share of all rows, so they are broadcast and their rows stay where they are;
all other rows are joined by shuffle. If more than MOST distinct segments share one, they are dealt
anew by ranges of the string's place around it and the bytes common to a range,
with ranges ever narrower; a range of one place has whole strings as its key, so
its group is decided without a sort. No group is too large for a task, and
nothing is dropped.

Edge cases: null and empty texts have no bytes; texts shorter than LENGTH keep
all; repeated rows are occurrences of their strings, as ties are; a null doc_id is
kept; a text of any length is cut in chunks of CHUNK bytes; an empty table gives no
rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork import runtime
from braidwork.llm.chosen_path import _grouped
from braidwork.llm.common import HOT_ROWS, U64, hot_from, joined_by, kept, mix, slices, table, utf8

LENGTH, GRAM = 400, 32
MOST = 2500
#: Bytes of one sort. Names then have 21 bits, and three fit a 64-bit key.
SORT_BYTES = 1_900_000
CHUNK = 1 << 22
#: Segments, and bytes of spans, that are broadcast rather than joined by shuffle.
BROADCAST_SEGMENTS, BROADCAST_BYTES = 20_000, 16_000_000
_ODD = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    size = 1 << max(17, (n - 1).bit_length())

    def make():
        out = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            p = np.full(size, U64(base))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        return tuple(out)

    return kept(f"powers {size}", make)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = len(data) - gram + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[gram:] - sums[:n]) * down[:n])


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """(minimizer hash, first start, number of starts, minimizer's place after the first start) for all strings, in order."""
    whole = np.frombuffer(data, np.uint8)
    wide = length - gram + 1
    for base in range(0, max(0, len(whole) - length + 1), CHUNK):
        part = whole[base : base + CHUNK + length - 1]
        hashes = gram_hashes(part, gram)
        keys = (hashes >> U64(40) << U64(40)) | np.arange(len(hashes), dtype=U64)
        n = len(part) - length + 1
        pad = -len(keys) % wide
        grid = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, U64)]).reshape(-1, wide)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        back = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
        place = (np.minimum(back[:n], ahead[wide - 1 : wide - 1 + n]) & U64((1 << 40) - 1)).astype(np.int64)
        cut = np.r_[0, np.flatnonzero(place[1:] != place[:-1]) + 1, n]
        at = place[cut[:-1]]
        yield from zip(hashes[at].view(np.int64).tolist(), (base + cut[:-1]).tolist(), np.diff(cut).tolist(), (at - cut[:-1]).tolist(), strict=True)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of a text's suffixes in their order, by the difference cover modulo 3. Symbols are 1 or more."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate([text.astype(U64), np.zeros(4, U64)])
    bits = U64(int(t.max()).bit_length())
    first = np.arange(1, n + (n % 3 == 1), 3)  # n itself, if need be, so that no triple of the first part ends in the second
    second = np.arange(2, n, 3)
    sample = np.concatenate([first, second])
    triple = (t[sample] << bits | t[sample + 1]) << bits | t[sample + 2]
    order = np.argsort(triple, kind="stable")
    ordered = triple[order]
    new = np.ones(len(sample), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if not new.all():
        order = suffix_order(names)
    rank = np.zeros(n + 4, U64)
    ordered = sample[order]
    rank[ordered] = np.arange(1, len(ordered) + 1, dtype=U64)
    ordered = ordered[ordered < n]
    rest = np.arange(0, n, 3)
    own = t[rest] << U64(32) | rank[rest + 1]
    down = np.argsort(own, kind="stable")
    rest, own = rest[down], own[down]
    wide = U64(int(rank.max()).bit_length())
    ones = ordered[ordered % 3 == 1]
    twos = ordered[ordered % 3 == 2]
    before1 = np.searchsorted(t[ones] << U64(32) | rank[ones + 1], own)
    pair = lambda i: (t[i] << bits | t[i + 1]) << wide | rank[i + 2]
    before2 = np.searchsorted(pair(twos), pair(rest))
    out = np.empty(n, np.int64)
    places = np.arange(len(rest)) + before1 + before2
    mask = np.ones(n, bool)
    mask[places] = False
    out[places], out[mask] = rest, ordered
    return out


def repeated(pieces: list[tuple[bytes, int, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For pieces (bytes, starts, number): ranges of starts whose strings occur more than once in all.

    A piece that stands for several equal ones is repeated whole.
    """
    text = np.frombuffer(b"".join(p for p, *_ in pieces), np.uint8)
    size = np.array([len(p) for p, *_ in pieces])
    begin = np.cumsum(size) - size
    starts = np.array([s for _, s, _ in pieces])
    valid = np.zeros(len(text), bool)
    for a, s in zip(begin.tolist(), starts.tolist(), strict=True):
        valid[a : a + s] = True
    order = suffix_order(text.astype(np.int64) + 1)
    order = order[valid[order]]
    same = np.arange(len(order) - 1)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = padded[: len(text)].astype(U64)
    for j in range(1, 8):
        word |= padded[j : len(text) + j].astype(U64) << U64(8 * j)
    for offset in dict.fromkeys([0, max(0, length - 8), *range(8, max(8, length - 8), 8)]):
        if length >= 8:
            same = same[word[order[same] + offset] == word[order[same + 1] + offset]]
    if length < 8:
        for offset in range(length):
            same = same[text[order[same] + offset] == text[order[same + 1] + offset]]
    hit = np.zeros(len(text) + 1, bool)
    hit[order[same]] = hit[order[same + 1]] = True
    out = []
    for (_, s, n), a in zip(pieces, begin.tolist(), strict=True):
        if n > 1:
            out.append([(0, s)])
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, hit[a : a + s], False].astype(np.int8)))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
    return out


def _segment_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    rows = docs.select(F.xxhash64("doc_id", "text").alias("k"), F.hash("doc_id", "text").alias("k2"), F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") >= length)

    def find(batches):
        names = ("key", "d1", "d2", "k", "k2", "first", "starts", "place")
        for whole in batches:
            for batch in slices(whole, "text"):
                out = []
                for k, k2, data in zip(batch["k"].to_pylist(), batch["k2"].to_pylist(), utf8(batch["text"]), strict=True):
                    for key, first, starts, place in segments(data, length, gram):
                        d = xxhash.xxh3_128_intdigest(data[first : first + starts + length - 1], place)
                        out.append((key, (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), k, k2, first, starts, place))
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for n, v, t in zip(names, zip(*out, strict=True), kinds, strict=True)})

    return rows.mapInArrow(find, "key long, d1 long, d2 long, k long, k2 int, first long, starts int, place int")


PIECE = "key long, d1 long, d2 long, base int, starts int, place int, n long, bytes binary"


def _narrower(rows: DataFrame, width: int, length: int) -> DataFrame:
    """Pieces of a group, cut by ranges of the string's place and dealt by the bytes that a range's strings share."""

    def cut(batches):
        for batch in batches:
            out = []
            for key, d1, d2, base, starts, place, n, data in zip(*(c.to_pylist() for c in batch.select(["key", "d1", "d2", "base", "starts", "place", "n", "bytes"]).columns), strict=True):
                i = 0
                while i < starts:  # start i has the minimizer place - i bytes after it
                    j = (place - i) // width
                    last = min(starts, place - j * width + 1)
                    low, high = place - j * width, place - (j + 1) * width + 1 + length
                    core = data[low:high]
                    h = xxhash.xxh3_64_intdigest(core, seed=(key ^ j * 0x9E3779B1) & (1 << 64) - 1)
                    out.append((h - (1 << 63), d1, d2, base + i, last - i, place - i, n, data[i : last + length - 1]))
                    i = last
            names = ("key", "d1", "d2", "base", "starts", "place", "n", "bytes")
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            if out:
                yield pa.RecordBatch.from_pydict({m: pa.array(v, t) for m, v, t in zip(names, zip(*out, strict=True), kinds, strict=True)})

    return rows.select("key", "d1", "d2", "base", "starts", "place", "n", "bytes").mapInArrow(cut, PIECE)


def _sorted_ranges(pieces: DataFrame, length: int) -> DataFrame:
    """d1, d2, low, high: ranges of repeated starts of the segments, found by the suffix sort of each key's pieces."""

    def flush(held: list[tuple]):
        found = repeated([(data, starts, n) for *_, starts, _, n, data in held], length)
        out = [(d1, d2, base + a, base + b) for (d1, d2, base, *_), ranges in zip(held, found, strict=True) for a, b in ranges]
        if out:
            yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for n, v, t in zip(("d1", "d2", "low", "high"), zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)})

    def sort(batches):
        held, total = [], 0
        for group in _grouped(batches):
            if group.num_rows < 2:  # alone: its number has decided
                continue
            own = sorted(zip(*(group[c].to_pylist() for c in ("d1", "d2", "base", "starts", "place", "n", "bytes")), strict=True))
            size = sum(len(x[-1]) for x in own)
            if held and total + size > SORT_BYTES:
                yield from flush(held)
                held, total = [], 0
            held += own
            total += size
        if held:
            yield from flush(held)

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(sort, "d1 long, d2 long, low int, high int")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, broadcast_segments: int = BROADCAST_SEGMENTS, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """k, k2 and spans: the maximal runs (first, end) of the documents' bytes that repeated strings cover; and k, k2 of hot repeated rows."""
    rows = runtime.written(_segment_rows(docs, length, gram), "segments")
    least = hot_from(rows.count(), hot_rows)
    copies = rows.filter("first = 0").groupBy("k", "k2").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > least)
    copies = runtime.written(copies.select("k", "k2"), "copies")
    often = runtime.written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "often")
    rows = runtime.written(joined_by(rows, often, ["key"], "c", least).drop("c"), "shared")
    place = F.struct("k", "k2", "first")
    unique = rows.groupBy("key", "d1", "d2", "starts", "place").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"))
    unique = runtime.written(unique, "unique")
    several = runtime.written(unique.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "several")
    wanted = runtime.written(joined_by(unique, several, ["key"], "kinds", least).select("key", "d1", "d2", "starts", "place", "n", "kinds", "at.k", "at.k2", "at.first"), "wanted")

    # the bytes of each distinct segment, from one document that holds it
    lists = wanted.groupBy("k", "k2").agg(F.collect_list(F.struct("key", "d1", "d2", "starts", "place", "n", "kinds", "first")).alias("list"))
    texts_ = docs.select(F.xxhash64("doc_id", "text").alias("k"), F.hash("doc_id", "text").alias("k2"), F.col("text")).filter(F.octet_length("text") >= length)
    held = texts_.join(F.broadcast(lists), ["k", "k2"]) if wanted.count() <= broadcast_segments else _hot_and_cold(texts_, lists, copies, "inner")
    held = held.select("k", "k2", "text", "list")

    def fetch(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                data, lists_ = utf8(batch["text"]), batch["list"].to_pylist()
                own = [(x["key"], x["d1"], x["d2"], 0, x["starts"], x["place"], x["n"], body[x["first"] : x["first"] + x["starts"] + length - 1], x["kinds"]) for body, list_ in zip(data, lists_, strict=True) for x in list_]
                names = ("key", "d1", "d2", "base", "starts", "place", "n", "bytes", "kinds")
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
                if own:
                    yield pa.RecordBatch.from_pydict({m: pa.array(v, t) for m, v, t in zip(names, zip(*own, strict=True), kinds, strict=True)})

    # a repeated row would be fetched twice
    pieces = runtime.written(held.mapInArrow(fetch, PIECE + ", kinds long").dropDuplicates(["key", "d1", "d2"]), "pieces")
    ranges = [_sorted_ranges(pieces.filter(F.col("kinds") <= most).drop("kinds"), length)]
    hot, width = pieces.filter(F.col("kinds") > most).drop("kinds"), length - gram + 1
    while width > 1 and not hot.isEmpty():
        width = max(1, width // 8) if width > 4 else 1
        parts = runtime.written(_narrower(hot, width, length), "ranges")
        sizes = parts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
        parts = runtime.written(joined_by(parts, runtime.written(sizes, "sizes"), ["key"], "kinds", least), "ranges")
        if width == 1:  # one key, one string: all are repeated
            ranges.append(parts.filter("n = 1").select("d1", "d2", F.col("base").alias("low"), (F.col("base") + F.col("starts")).alias("high")))
            break
        ranges.append(_sorted_ranges(parts.filter(F.col("kinds") <= most).drop("kinds"), length))
        hot = parts.filter(F.col("kinds") > most).drop("kinds")
    found = ranges[0]
    for more in ranges[1:]:
        found = found.unionByName(more)

    # back to the documents: segments of number 1 have one place, the others are repeated whole
    once = found.join(unique.filter("n = 1").select("d1", "d2", "at"), ["d1", "d2"])
    span = lambda first, low, high: F.struct((first + low).cast("long").alias("first"), (first + high + length - 1).cast("long").alias("end"))
    once = once.select("at.k", "at.k2", span(F.col("at.first"), F.col("low"), F.col("high")).alias("span"))
    many = joined_by(rows, unique.filter("n > 1").select("key", "d1", "d2", "starts", "n"), ["key", "d1", "d2", "starts"], "n", least).select("k", "k2", span(F.col("first"), F.lit(0), F.col("starts")).alias("span"))
    spans = once.unionByName(many).groupBy("k", "k2").agg(F.sort_array(F.collect_set("span")).alias("spans"))
    return spans.select("k", "k2", _merged(F.col("spans")).alias("spans")), copies


def _hot_and_cold(rows: DataFrame, few: DataFrame, copies: DataFrame, how: str) -> DataFrame:
    """rows joined with few by (k, k2); rows of the keys in copies are not sent."""
    on = ["k", "k2"]
    if copies.isEmpty():
        return rows.join(few, on, how)
    copies = F.broadcast(copies)
    hot = rows.join(copies, on, "left_semi").join(F.broadcast(few.join(copies, on, "left_semi")), on, how)
    return hot.unionByName(rows.join(copies, on, "left_anti").join(few, on, how))


def _merged(spans: Column) -> Column:
    """Maximal runs of sorted spans, whose ends rise with their starts: a document has few, so they are small to send."""
    firsts = F.filter(spans, lambda x, i: (i == 0) | (x["first"] > F.get(spans, i - 1)["end"]))
    lasts = F.filter(spans, lambda x, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["first"] > x["end"]))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a["first"].alias("first"), b["end"].alias("end")))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove(docs: DataFrame, with_text: bool = False, length: int = LENGTH, gram: int = GRAM, most: int = MOST, broadcast_segments: int = BROADCAST_SEGMENTS, broadcast_bytes: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, and kept (the remaining bytes) if asked for."""
    found, copies = repeats(docs, length, gram, most, broadcast_segments, hot_rows)
    found = runtime.written(found, "spans")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("k"), F.hash("doc_id", "text").alias("k2"))
    n_bytes = found.select(F.sum(64 + 16 * F.size("spans"))).first()[0] or 0
    rows = rows.join(F.broadcast(found), ["k", "k2"], "left") if n_bytes <= broadcast_bytes else _hot_and_cold(rows, found, copies, "left")
    rows = rows.select("doc_id", "text", "spans")
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                out = []
                for data, spans in zip(utf8(batch["text"]), batch["spans"].to_pylist(), strict=True):
                    runs, parts, at = union([(s["first"], s["end"]) for s in spans or ()]), [], 0
                    for a, b in runs:
                        parts.append(data[at:a])
                        at = b
                    left = b"".join([*parts, data[at:]])
                    out.append((len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), len(left), left if with_text else None))
                columns = list(zip(*out, strict=True))
                arrays = [batch["doc_id"], *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "kept"])

    out = rows.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, kept binary")
    return out if with_text else out.drop("kept")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents"))
