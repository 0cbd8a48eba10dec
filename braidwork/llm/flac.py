"""FLAC as a media column: an encoder, a checking decoder and PCM blocks.

Streams are 8-bit mono. The encoder cuts them into blocks of BLOCK samples and
takes for each the best of a constant, the fixed linear predictors of order 0
to 3 with Rice-coded residuals, and the bare samples. A seek table holds every
frame's first sample and place, so any block is decoded by itself.

The decoder reads any 8-bit mono stream of the format's subset: constant, bare,
fixed and general linear predictors, Rice parameters of 4 and 5 bits, escaped
and several partitions, wasted bits. It verifies each frame header's CRC-8, each
frame's CRC-16 and the stream's MD5. Frames of the kind that the encoder writes
are decoded many at once: one step takes the next residual of all of them, by a
table of where the next 1 bit lies. Other frames are decoded one by one.

A stream's blocks follow each other in one task, so what is told of a stream is
summed block by block and never needs all samples at once.

Edge cases: an empty payload is a stream without frames; null and empty texts
are 64 bytes 0; equal payloads give equal streams, repeated rows and ties alike; a
text of any length is one stream, coded in one task; a null doc_id is kept; columns
of clashing names are not read; a damaged stream raises ValueError; a table without
rows gives none.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import gathered_batches, table, texts, utf8

BLOCK, RATE = 1024, 8000
GROUP_BYTES = 2_000_000
MAX_ORDER = 3


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    out, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for value in range(256):
        value <<= bits - 8
        for _ in range(8):
            value = (value << 1 ^ polynomial if value & top else value << 1) & mask
        out.append(value)
    return np.array(out, np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _far_table(length: int) -> np.ndarray:
    """[k, b]: what byte b adds to a CRC-16 if k bytes follow it."""
    rows = [CRC16]
    for _ in range(length - 1):
        last = rows[-1]
        rows.append((last << np.uint32(8) & np.uint32(0xFFFF)) ^ CRC16[last >> np.uint32(8)])
    return np.stack(rows).astype(np.uint16)


_FAR = _far_table(BLOCK + 64)


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of each of the pieces that make up data, in their order."""
    if not len(starts):
        return np.empty(0, np.uint16)
    if lengths.max(initial=0) > len(_FAR):
        out = np.empty(len(starts), np.uint16)
        for i, (s, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
            crc = 0
            for b in data[s : s + n].tolist():
                crc = (crc << 8 & 0xFFFF) ^ int(CRC16[crc >> 8 ^ b])
            out[i] = crc
        return out
    after = np.repeat((starts + lengths - 1).astype(np.int32), lengths)
    at = np.arange(len(after), dtype=np.int32) if int(lengths.sum()) == len(data) else np.concatenate([np.arange(s, s + n, dtype=np.int32) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)])
    flat = (after - at) * np.int32(256) + data[at]
    return np.bitwise_xor.reduceat(_FAR.reshape(-1)[flat], np.cumsum(lengths) - lengths)


def crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = int(CRC8[crc ^ b])
    return crc


def _coded_number(n: int) -> bytes:
    """The frame number, coded as UTF-8 codes code points."""
    if n < 0x80:
        return bytes([n])
    more, low = 1, []
    while True:
        low.insert(0, 0x80 | n & 0x3F)
        n >>= 6
        if n < 1 << (6 - more):
            return bytes([(0xFF00 >> more + 1) & 0xFF | n, *low])
        more += 1


def _header(number: int, size: int) -> bytes:
    code, more = (10, b"") if size == 1024 else (6, bytes([size - 1])) if size <= 256 else (7, (size - 1).to_bytes(2, "big"))
    head = b"\xff\xf8" + bytes([code << 4, 0x02]) + _coded_number(number) + more
    return head + bytes([crc8(head)])


_headers: dict[tuple[int, int], bytes] = {}


def header(number: int, size: int) -> bytes:
    if len(_headers) > 100_000:
        _headers.clear()
    return _headers.get((number, size)) or _headers.setdefault((number, size), _header(number, size))


def _frames(samples: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All frames' bytes, one after the other, and each frame's length."""
    n, wide = len(sizes), samples.astype(np.int32)
    place = np.arange(len(samples), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
    order, residuals, sums = np.zeros(n, np.int64), [wide], []
    for o in range(MAX_ORDER + 1):
        if o:
            residuals.append(np.diff(residuals[-1], prepend=np.int32(0)))
        size = np.abs(residuals[o])
        size[place < o] = 0
        sums.append(np.where(sizes > o, np.add.reduceat(size, starts, dtype=np.int64), np.iinfo(np.int64).max))
    order = np.argmin(np.stack(sums), axis=0)
    residual = wide.copy()
    for o in range(1, MAX_ORDER + 1):
        chosen = np.repeat(order == o, sizes)
        residual[chosen] = residuals[o][chosen]
    u = (residual << 1 ^ residual >> 31).astype(np.uint32)
    u[place < np.repeat(order, sizes)] = 0
    tried = np.stack([np.add.reduceat(u >> np.uint32(r), starts, dtype=np.int64) + (sizes - order) * (r + 1) for r in range(8)])
    k = np.argmin(tried, axis=0)
    best = tried.min(axis=0) + 8 * order
    first = wide[starts]
    constant = np.add.reduceat((wide != np.repeat(first, sizes)).astype(np.int64), starts) == 0
    bare = ~constant & (best + 10 >= 8 * sizes)
    coded = ~constant & ~bare
    heads = [header(i, s) for i, s in zip(numbers.tolist(), sizes.tolist(), strict=True)]
    head = np.array([len(h) for h in heads], np.int64)
    body = np.where(constant, 16, np.where(bare, 8 + 8 * sizes, 8 + 10 + best))
    lengths = head + -(-body // 8) + 2
    at = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint8)
    sub, raw = at + head, samples.view(np.uint8)
    if coded.any():
        mask = np.repeat(coded, sizes) & (place >= np.repeat(order, sizes))
        own, r = u[mask], np.repeat(k, sizes)[mask].astype(np.uint32)
        q = own >> r
        width = q + np.uint32(1) + r
        ends = np.cumsum(width, dtype=np.int64)
        counts = (sizes - order)[coded]
        before = np.r_[0, ends][np.cumsum(counts) - counts]
        first_bit = (sub[coded] + 1 + order[coded]) * 8 + 10
        stop = ends - r - 1 + np.repeat(first_bit - before, counts)  # the unary part's 1
        # a 1 and r bits, at most 8, lie in two bytes; codes share no bit, so sums join them
        two = ((np.uint32(1) << r | own & (np.uint32(1) << r) - np.uint32(1)) << (np.uint32(15) - (stop & 7).astype(np.uint32) - r)).astype(np.float64)
        out += sum_at(stop >> 3, two, len(out))
        out[sub[coded] + 1 + order[coded]] |= (k[coded] >> 2).astype(np.uint8)
        out[sub[coded] + 2 + order[coded]] |= ((k[coded] & 3) << 6).astype(np.uint8)
        for o in range(1, MAX_ORDER + 1):
            own = np.flatnonzero(coded & (order >= o))
            out[sub[own] + o] = raw[starts[own] + o - 1]
    out[sub] = np.where(constant, 0, np.where(bare, 1, 8 | order)) << 1
    out[sub[constant] + 1] = raw[starts[constant]]
    if bare.any():
        mask = np.repeat(bare, sizes)
        out[(np.repeat(sub, sizes) + 1 + place)[mask]] = raw[mask]
    for i, h in zip(at.tolist(), heads, strict=True):
        out[i : i + len(h)] = np.frombuffer(h, np.uint8)
    keep = np.ones(len(out), bool)
    tail = at + lengths
    keep[tail - 1] = keep[tail - 2] = False
    inner = lengths - 2
    crc = crc16(out[keep], np.cumsum(inner) - inner, inner)
    out[tail - 2], out[tail - 1] = crc >> 8, crc & 0xFF
    return out, lengths


def sum_at(where: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
    """Bytes 0..n that sum 16-bit numbers whose first bytes lie at `where`."""
    total = np.bincount(where, two, n + 1).astype(np.int64)  # sums of one place stay below 2^17
    low = (total & 0xFF).astype(np.uint8)
    high = (total >> 8).astype(np.uint8)
    out = high[:n].copy()
    out[1:] += low[: n - 1]
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; its bytes, less 128, are the samples."""
    sizes, numbers, counts = [], [], []
    for p in payloads:
        n = -(-len(p) // BLOCK)
        counts.append(n)
        sizes += [BLOCK] * (n - 1) + [len(p) - BLOCK * (n - 1)] if n else []
        numbers += range(n)
    sizes_ = np.array(sizes, np.int64)
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8)
    starts = np.cumsum(sizes_) - sizes_
    body, lengths = _frames(samples, starts, sizes_, np.array(numbers, np.int64)) if len(sizes_) else (np.empty(0, np.uint8), sizes_)
    raw, flat, out, frame, at, begin = body.tobytes(), samples.tobytes(), [], 0, 0, 0
    for p, n in zip(payloads, counts, strict=True):
        own = lengths[frame : frame + n]
        size = int(own.sum())
        info = BLOCK.to_bytes(2, "big") * 2 + int(own.min(initial=1 << 23) if n else 0).to_bytes(3, "big") + int(own.max(initial=0)).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(flat[begin : begin + len(p)]).digest()
        seek = np.zeros(n, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
        seek["sample"], seek["offset"], seek["size"] = np.arange(n) * BLOCK, np.cumsum(own) - own, sizes_[frame : frame + n]
        points = seek.tobytes()
        out.append(b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + raw[at : at + size])
        frame, at, begin = frame + n, at + size, begin + len(p)
    return out


class _Bits:
    """Reads bits of one frame, from its first byte on."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), len(data) * 8

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("FLAC: a frame ends early")
        return self.value >> self.left & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _frame_head(data: bytes, at: int, info: dict) -> tuple[int, int, int]:
    """Length of the header at `at`, the frame's number and its samples."""
    if data[at : at + 2] != b"\xff\xf8" and data[at : at + 2] != b"\xff\xf9":
        raise ValueError("FLAC: no frame where one should start")
    size, rate, channels, depth = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if channels or depth not in (0, 1) or info["bits"] != 8 or info["channels"] != 1:
        raise ValueError("FLAC: only 8-bit mono is read")
    here = at + 4
    lead = data[here]
    more = 0 if lead < 0x80 else (lead ^ 0xFF).bit_length() and 7 - (lead ^ 0xFF).bit_length()
    number = lead if not more else lead & (0x3F >> more)
    for b in data[here + 1 : here + 1 + more]:
        number = number << 6 | b & 0x3F
    here += 1 + more
    if size == 6:
        samples, here = data[here] + 1, here + 1
    elif size == 7:
        samples, here = int.from_bytes(data[here : here + 2], "big") + 1, here + 2
    else:
        samples = {1: 192, **{c: 576 << c - 2 for c in range(2, 6)}, **{c: 256 << c - 8 for c in range(8, 16)}}[size]
    here += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(data[at:here]) != data[here]:
        raise ValueError("FLAC: a frame header's checksum is wrong")
    return here + 1 - at, number, samples


FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _subframe(bits: _Bits, n: int) -> list[int]:
    if bits.take(1):
        raise ValueError("FLAC: a reserved bit is set")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
    depth = 8 - wasted
    if kind == 0:
        out = [bits.signed(depth)] * n
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        weights, shift = FIXED[kind - 8] if kind < 32 else (), 0
        if kind >= 32:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            weights = tuple(bits.signed(precision) for _ in range(order))
        wide, parts = 4 + bits.take(2), bits.take(4)
        if wide > 5:
            raise ValueError("FLAC: a reserved coding of residuals")
        for p in range(1 << parts):
            count = (n >> parts) - (order if p == 0 else 0)
            k = bits.take(wide)
            if k == (1 << wide) - 1:
                raw = bits.take(5)
                residuals = (bits.signed(raw) for _ in range(count))
            else:
                residuals = ((u >> 1) ^ -(u & 1) for u in ((bits.unary() << k | bits.take(k)) for _ in range(count)))
            for e in residuals:
                out.append(e + (sum(w * out[-1 - j] for j, w in enumerate(weights)) >> shift))
    else:
        raise ValueError("FLAC: a reserved subframe")
    return [v << wasted for v in out]


def _metadata(data: bytes) -> tuple[dict, np.ndarray | None, int]:
    if data[:4] != b"fLaC":
        raise ValueError("FLAC: no stream")
    at, info, seek, last = 4, None, None, False
    while not last:
        if at + 4 > len(data):
            raise ValueError("FLAC: the metadata end early")
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        own, at = data[at + 4 : at + 4 + size], at + 4 + size
        if kind == 0:
            packed = int.from_bytes(own[10:18], "big")
            info = {"block": int.from_bytes(own[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": own[18:34]}
        elif kind == 3:
            seek = np.frombuffer(own, [("sample", ">u8"), ("offset", ">u8"), ("size", ">u2")])
    if info is None:
        raise ValueError("FLAC: no stream information")
    return info, seek, at


def _one_by_one(data: bytes, at: int, info: dict) -> np.ndarray:
    """Samples of all frames from at on; every frame's end is found by decoding it."""
    out: list[int] = []
    while at < len(data):
        head, _, n = _frame_head(data, at, info)
        bits = _Bits(data[at + head :])
        out += _subframe(bits, n)
        end = len(data) - bits.left // 8 + 2
        whole = np.frombuffer(data[at : end - 2], np.uint8)
        if int(crc16(whole, np.array([0]), np.array([len(whole)]))[0]) != int.from_bytes(data[end - 2 : end], "big"):
            raise ValueError("FLAC: a frame's checksum is wrong")
        at = end
    return np.array(out, np.int64).astype(np.int8)


def decode(streams: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """Each stream's payload and its frames' first samples."""
    parsed = [_metadata(s) for s in streams]
    fast, owner, pieces, sizes, heads = [], [], [], [], []
    out: list[tuple[bytes, np.ndarray] | None] = [None] * len(streams)
    for i, (data, (info, seek, at)) in enumerate(zip(streams, parsed, strict=True)):
        whole = seek is not None and int(seek["size"].sum()) == info["samples"] and len(seek) > 0
        if whole and (seek["size"][:-1] == BLOCK).all() and seek["size"].max(initial=0) <= BLOCK:
            begins = [at + int(o) for o in seek["offset"]]
            for number, (a, b, n) in enumerate(zip(begins, [*begins[1:], len(data)], seek["size"].tolist(), strict=True)):
                h = header(number, n)
                if data[a : a + len(h)] != h:  # written otherwise, or damaged
                    whole = False
                    break
                pieces.append(data[a:b])
                owner.append(i)
                sizes.append(n)
                heads.append(len(h))
            if whole:
                fast.append(i)
                continue
            while owner and owner[-1] == i:
                for x in (pieces, owner, sizes, heads):
                    x.pop()
        samples = _one_by_one(data, at, info)
        out[i] = _checked(samples, info)
    if pieces:
        samples, plain = _many(pieces, np.array(sizes), np.array(heads))
        ends = np.cumsum(sizes)
        first = {}
        for j, i in enumerate(owner):
            first.setdefault(i, j)
        count = np.bincount(owner, minlength=len(streams))
        for i in fast:
            info, _, at = parsed[i]
            a, b = first[i], first[i] + count[i]
            own = samples[ends[a] - sizes[a] : ends[b - 1]]
            out[i] = _checked(own if plain[a:b].all() else _one_by_one(streams[i], at, info), info)
    return out


def _checked(samples: np.ndarray, info: dict) -> tuple[bytes, np.ndarray]:
    if len(samples) != info["samples"] or hashlib.md5(samples.tobytes()).digest() != info["md5"]:
        raise ValueError("FLAC: the samples are not those that were stored")
    step = info["block"] or BLOCK
    return (samples.view(np.uint8) ^ 0x80).tobytes(), np.arange(0, len(samples), step, dtype=np.int64)


def _many(pieces: list[bytes], sizes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of all frames, and which frames are of the kind decoded here."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(p) for p in pieces], np.int64)
    at = np.cumsum(lengths) - lengths
    inner, keep = lengths - 2, np.ones(len(data), bool)
    keep[at + lengths - 1] = keep[at + lengths - 2] = False
    crc = crc16(data[keep], np.cumsum(inner) - inner, inner)
    if (crc != (data[at + lengths - 2].astype(np.uint16) << 8 | data[at + lengths - 1])).any():
        raise ValueError("FLAC: a frame's checksum is wrong")
    kind = data[at + heads]
    order = (kind >> 1).astype(np.int64) - 8
    coded = (kind & 1 == 0) & (order >= 0) & (order <= MAX_ORDER)
    constant, bare = kind == 0, kind == 2
    signed = data.view(np.int8)
    block = np.zeros((len(pieces), BLOCK), np.int32)
    block[constant] = signed[at[constant] + heads[constant] + 1][:, None]
    for i in np.flatnonzero(bare).tolist():
        a = at[i] + heads[i] + 1
        block[i, : sizes[i]] = signed[a : a + sizes[i]]
    bits = np.unpackbits(data)
    rows = np.flatnonzero(coded)
    start = (at + heads) * 8 + 8 + 8 * order
    if len(rows):
        for o in range(MAX_ORDER):
            own = rows[order[rows] > o]
            block[own, o] = signed[at[own] + heads[own] + 1 + o]
        word = np.zeros(len(rows), np.int64)
        for j in range(10):
            word = word << 1 | bits[start[rows] + j]
        simple = (word >> 4 == 0) & ((word & 15) < 9)
        coded[rows[~simple]] = False
        rows, k = rows[simple], (word & 15)[simple]
    plain = coded | constant | bare
    if len(rows):
        count = sizes[rows] - order[rows]
        down = np.argsort(-count, kind="stable")
        rows, k, count = rows[down], k[down], count[down]
        ones = np.flatnonzero(bits).astype(np.int32)
        ones = np.append(ones, np.int32(len(bits) + 64))
        rank = np.cumsum(bits, dtype=np.int32)
        rank -= bits  # 1 bits before each bit
        here, step = (start[rows] + 10).astype(np.int32), (k + 1).astype(np.int32)
        top = np.int32(len(bits) - 1)
        stops = np.zeros((int(count[0]), len(rows)), np.int32)
        quotients = np.zeros_like(stops)
        alive = np.searchsorted(-count, -np.arange(int(count[0])), "left")
        for i in range(int(count[0])):
            m = alive[i]
            own = here[:m]
            stop = ones[rank[np.minimum(own, top)]]
            stops[i, :m] = stop
            np.subtract(stop, own, out=quotients[i, :m])
            np.add(stop, step[:m], out=own)
        live = np.arange(int(count[0]))[:, None] < count[None, :]
        pair = data.astype(np.uint32) << np.uint32(8)
        pair[:-1] |= data[1:]
        stops += np.int32(1)  # the first of the k bits
        np.minimum(stops, top, out=stops)
        low = pair[stops >> np.int32(3)] >> (np.uint32(16) - k.astype(np.uint32) - (stops & np.int32(7)).astype(np.uint32))
        value = quotients.astype(np.uint32) << k.astype(np.uint32) | low & ((np.uint32(1) << k.astype(np.uint32)) - np.uint32(1))
        e = (value >> np.uint32(1)).astype(np.int32) ^ -(value & np.uint32(1)).astype(np.int32)
        e[~live] = 0
        for o in range(MAX_ORDER + 1):
            own = np.flatnonzero(order[rows] == o)
            if not len(own):
                continue
            here_rows, r = rows[own], e[:, own].T
            grid = np.zeros((len(own), BLOCK), np.int32)
            n = min(r.shape[1], BLOCK - o)
            grid[:, o : o + n] = r[:, :n]
            warm = block[here_rows, :o]
            for level in range(o):  # residuals of the warm-up samples at each lower order
                grid[:, level] = np.diff(warm, level, axis=1)[:, 0]
            for level in reversed(range(o)):
                grid[:, level:] = np.cumsum(grid[:, level:], axis=1, dtype=np.int32)
            block[here_rows] = grid
    flat = block.reshape(-1)[np.arange(BLOCK)[None, :].repeat(len(pieces), 0).reshape(-1) < np.repeat(sizes, BLOCK)]
    return flat.astype(np.int8), plain


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (64 if not text else 0))


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's bytes as a FLAC stream."""
    kind = dict(docs.dtypes)["doc_id"]

    def store(batches):
        for batch in gathered_batches(batches, most=GROUP_BYTES):
            bodies = utf8(batch["text"])
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_bytes": pa.array([len(b) for b in bodies], pa.int64()), "media": pa.array(encode([padded(b) for b in bodies]), pa.binary())})

    return texts(docs).mapInArrow(store, f"doc_id {kind}, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, *more: str) -> DataFrame:
    """One row for each block, a stream's blocks in order: doc_id, sample_offset, n_samples, pcm (8 bits, 128 is silence), the named columns.

    media_bytes and media_sha256 tell of the stored stream. A stream without samples gives one row of none.
    """
    kinds = dict(media.dtypes)

    def blocks(batches):
        for batch in gathered_batches(batches, "media", GROUP_BYTES):
            streams = utf8(batch["media"])
            for i, (pcm, first) in enumerate(decode(streams)):
                first = first if len(first) else np.zeros(1, np.int64)
                ends = [*first[1:].tolist(), len(pcm)]
                parts = [pcm[a:b] for a, b in zip(first.tolist(), ends, strict=True)]
                same = pa.array([i] * len(parts), pa.int64())
                about = {"media_bytes": pa.array([len(streams[i])] * len(parts), pa.int64()), "media_sha256": pa.array([hashlib.sha256(streams[i]).hexdigest()] * len(parts), pa.string())}
                own = {"doc_id": batch["doc_id"].take(same), "sample_offset": pa.array(first, pa.int64()), "n_samples": pa.array([len(p) for p in parts], pa.int64()), "pcm": pa.array(parts, pa.binary())}
                yield pa.RecordBatch.from_pydict(own | about | {c: batch[c].take(same) for c in more})

    schema = f"doc_id {kinds['doc_id']}, sample_offset long, n_samples long, pcm binary, media_bytes long, media_sha256 string"
    return media.select("doc_id", "media", *more).mapInArrow(blocks, ", ".join([schema, *(f"`{c}` {kinds[c]}" for c in more)]))


class Samples:
    """Digests and a feature of a stream's samples, block by block: loudness, sign changes and range, as whole numbers."""

    def __init__(self):
        self.sha, self.tail, self.last = hashlib.sha256(), b"", None
        self.n = self.sum = self.energy = self.changes = self.low = self.high = 0

    def add(self, pcm: bytes) -> None:
        if not pcm:
            return
        self.sha.update(pcm)
        self.tail = (self.tail + pcm[-64:])[-64:]
        x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
        below = x < 0
        self.changes += int(np.count_nonzero(below[1:] != below[:-1])) + (self.last is not None and self.last != bool(below[0]))
        self.last = bool(below[-1])
        self.n, self.sum, self.energy = self.n + len(x), self.sum + int(x.sum()), self.energy + int((x * x).sum())
        self.low, self.high = min(self.low, int(x.min())), max(self.high, int(x.max()))

    def feature(self) -> str:
        return f"n={self.n};sum={self.sum};energy={self.energy};changes={self.changes};low={self.low};high={self.high}"


def describe(blocks: DataFrame) -> DataFrame:
    """Digests and features of each stream's samples, from its blocks as pcm_blocks gives them, with n_bytes."""
    kind = dict(blocks.dtypes)["doc_id"]
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def read(batches):
        about, found, held, size = None, Samples(), [], 0

        def told():
            found.add(b"".join(held))
            doc_id, n_bytes, media_bytes, media_sha256 = about
            row = (n_bytes, found.n, found.sha.hexdigest(), zlib.crc32(found.tail), media_bytes, media_sha256, found.feature())
            return doc_id, row

        for batch in batches:
            done = []
            columns = (batch[c].to_pylist() for c in ("sample_offset", "pcm", "n_bytes", "media_bytes", "media_sha256"))
            for i, (offset, pcm, *rest) in enumerate(zip(*columns, strict=True)):
                if offset == 0:  # a stream begins
                    if about:
                        done.append(told())
                    about, found, held, size = (batch["doc_id"].slice(i, 1), *rest), Samples(), [], 0
                held.append(pcm)
                size += len(pcm)
                if size >= GROUP_BYTES:
                    found.add(b"".join(held))
                    held, size = [], 0
            if done:
                yield table_of(done)
        if about:
            yield table_of([told()])

    def table_of(done):
        ids = pa.concat_arrays([d for d, _ in done])
        return pa.RecordBatch.from_pydict({"doc_id": ids} | {n: pa.array([r[j] for _, r in done], k) for j, (n, k) in enumerate(zip(names, kinds, strict=True))})

    rows = blocks.select("doc_id", "sample_offset", "pcm", "n_bytes", "media_bytes", "media_sha256")
    return rows.mapInArrow(read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_flac(spark, sf_dir: str) -> DataFrame:
    return describe(pcm_blocks(to_media(table(spark, sf_dir, "documents")), "n_bytes"))
