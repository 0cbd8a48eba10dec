import hashlib
import random
import zlib

import numpy as np
import pytest

from braidwork.llm import flac


def payloads():
    rng = random.Random(4)
    yield b""
    yield bytes(64)
    yield bytes(range(256)) * 20
    yield rng.randbytes(5000)
    yield b"the quick brown fox " * 700
    yield bytes([0, 255] * 600)
    yield "é漢🙂".encode() * 300
    for n in (1, 2, 3, 4, 5, 1023, 1024, 1025, 200_000):
        yield bytes(rng.choice(b"abc def") for _ in range(n))


def test_round_trip():
    many = list(payloads())
    streams = flac.encode(many)
    for p, s, (pcm, first) in zip(many, streams, flac.decode(streams), strict=True):
        assert pcm == p and first.tolist() == list(range(0, len(p), flac.BLOCK))
        assert flac.encode([p])[0] == s
        info, _, at = flac._metadata(s)
        assert (flac._one_by_one(s, at, info).view(np.uint8) ^ 0x80).tobytes() == p


def test_damage_is_found():
    stream = flac.encode([b"some text, some more text " * 200])[0]
    info, _, at = flac._metadata(stream)
    rng = random.Random(1)
    for where in [at + 5, at + 50, len(stream) - 1, *(rng.randrange(at, len(stream)) for _ in range(20))]:
        broken = bytearray(stream)
        broken[where] ^= 1 << rng.randrange(8)
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])
    with pytest.raises(ValueError):
        flac.decode([b"nothing"])


def test_checksums_are_the_known_ones():
    data = np.frombuffer(b"123456789", np.uint8)
    assert flac.crc16(data, np.array([0]), np.array([9]))[0] == 0xFEE8
    assert flac.crc8(b"123456789") == 0xF4


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> n - 1 - j & 1 for j in range(n)]

    def rice(self, e, k):
        u = e << 1 if e >= 0 else -2 * e - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u & (1 << k) - 1, k)


def stream(samples, bits):
    """One frame around a subframe's bits, without a seek table."""
    head = flac._header(0, len(samples))
    body = head + np.packbits(np.array(bits, np.uint8)).tobytes()
    crc = int(flac.crc16(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0])
    info = flac.BLOCK.to_bytes(2, "big") * 2 + bytes(6) + (flac.RATE << 44 | 7 << 36 | len(samples)).to_bytes(8, "big")
    info += hashlib.md5(np.array(samples, np.int8).tobytes()).digest()
    return b"fLaC\x80" + (34).to_bytes(3, "big") + info + body + crc.to_bytes(2, "big")


@pytest.mark.parametrize("wide", [4, 5])
def test_general_linear_prediction_in_partitions(wide):
    rng = random.Random(wide)
    weights, shift, order, samples = [11, -5, 2], 3, 3, [10, -4, 7]
    residuals = [rng.randrange(-9, 9) for _ in range(64 - order)]
    for e in residuals:
        samples.append(max(-128, min(127, e + (sum(w * samples[-1 - j] for j, w in enumerate(weights)) >> shift))))
        residuals[len(samples) - order - 1] = samples[-1] - (sum(w * samples[-2 - j] for j, w in enumerate(weights)) >> shift)
    b = Bits()
    b.put((31 + order) << 1, 8)
    for s in samples[:order]:
        b.put(s & 255, 8)
    b.put(6 - 1, 4)
    b.put(shift, 5)
    for w in weights:
        b.put(w & 63, 6)
    b.put(wide - 4, 2)
    b.put(2, 4)
    at = 0
    for part in range(4):
        n = 16 - (order if part == 0 else 0)
        own = residuals[at : at + n]
        at += n
        if part == 2:  # escaped
            b.put((1 << wide) - 1, wide)
            b.put(12, 5)
            for e in own:
                b.put(e & 4095, 12)
        else:
            b.put(part + 2, wide)
            for e in own:
                b.rice(e, part + 2)
    pcm, _ = flac.decode([stream(samples, b.bits)])[0]
    assert (np.frombuffer(pcm, np.uint8).astype(int) - 128).tolist() == samples


TEXTS = [None, "", "a", "x" * 64, "y" * 65, "long text é " * 3000, "same", "same"]


def test_documents(docs):
    rows = list(enumerate(TEXTS)) + [(None, "z")]
    media = flac.to_media(docs(rows))
    got = sorted(flac.describe(flac.pcm_blocks(media, "n_bytes")).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    for (i, text), r in zip(rows, got, strict=True):
        raw = (text or "").encode()
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len(raw), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-64:])
    assert got[6][1:] == got[7][1:]
    blocks = sorted(flac.pcm_blocks(media).filter("doc_id = 5").collect(), key=lambda r: r.sample_offset)
    assert [r.sample_offset for r in blocks] == list(range(0, len(TEXTS[5].encode()) // 64 * 64 + 64, flac.BLOCK))[: len(blocks)]
    assert b"".join(r.pcm for r in blocks).startswith(TEXTS[5].encode())


def test_empty(docs):
    assert flac.describe(flac.pcm_blocks(flac.to_media(docs([])), "n_bytes")).count() == 0


def test_samples_by_blocks():
    """Sums over blocks of any size are those of the whole."""
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 5000).astype(np.uint8).tobytes()
    whole = flac.Samples()
    whole.add(data)
    x = np.frombuffer(data, np.uint8).astype(int) - 128
    assert whole.feature() == f"n=5000;sum={x.sum()};energy={(x * x).sum()};changes={sum((a < 0) != (b < 0) for a, b in zip(x[1:], x[:-1]))};low={x.min()};high={x.max()}"
    for step in (1, 7, 64, 1024):
        parts = flac.Samples()
        for a in range(0, len(data), step):
            parts.add(data[a : a + step])
        assert (parts.feature(), parts.sha.digest(), parts.tail) == (whole.feature(), whole.sha.digest(), data[-64:])


def test_many_blocks_a_batch(spark, docs):
    """Streams whose blocks are spread over several batches, and a repeated doc_id."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(1, "ab" * 9000), (1, "ab" * 9000), (1, "x"), (None, "é" * 5000), (2, None)]
        got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256) for r in flac.describe(flac.pcm_blocks(flac.to_media(docs(rows)), "n_bytes")).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    raw = [(i, (t or "").encode()) for i, t in rows]
    assert got == sorted(((i, len(b), len(flac.padded(b)), hashlib.sha256(flac.padded(b)).hexdigest()) for i, b in raw), key=str)
