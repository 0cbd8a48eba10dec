import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from braidwork import runtime
from braidwork.llm import token_ids

TEXTS = ["", None, "Hello  World's\n\nisn't", "a b́ Σίσυφος ΟΔΟΣ\x1c\x85 x", "<|endoftext|> x<|startoftext|>y", "漢字 テスト 🙂🙂 1234", "x" * 5000, "wort " * 9000, " \t\r\n ", "İstanbul ẞ ǅ", "á ́b"]


TOKENIZER = Tokenizer.from_file(token_ids.vocabulary_path())


def plain(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_word_tokenizer_equals_library():
    t = token_ids.WordTokenizer(token_ids.vocabulary_path())
    rng = random.Random(3)
    alphabet = "ab'stréÉ ß\n\t1 2.,!?-_ ́  Σς<|endoftext|>漢"
    texts = [x or "" for x in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += ["".join(rng.choice(["the", "Éa", "x", "...", "'s", " ", " ", "\n", "1", "|"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    flat, at = t.encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == plain(text)
    flat, at = t.encode(pa.array([], pa.string()))
    assert len(flat) == 0 and at.tolist() == [0]


def test_ids_are_kept_from_slice_to_slice(monkeypatch):
    t, sent = token_ids.WordTokenizer(token_ids.vocabulary_path()), []
    words, one = t._words, t._one
    monkeypatch.setattr(t, "_words", lambda parts: sent.extend(parts) or words(parts))
    monkeypatch.setattr(t, "_one", lambda parts: sent.extend(parts) or one(parts))
    texts = pa.array([x or "" for x in TEXTS])
    first = t.encode(texts)
    assert sent
    sent.clear()
    again = t.encode(texts)
    assert [x for x in map(str, sent) if x] == ["x" * 5000]  # too long to be kept
    assert first[0].tolist() == again[0].tolist() and first[1].tolist() == again[1].tolist()


@pytest.mark.parametrize("parts", [0, 1, 40, 200_000])
def test_kept_ids_are_bounded_and_right(parts):
    t, rng = token_ids.WordTokenizer(token_ids.vocabulary_path()), random.Random(parts)
    t.PARTS = parts
    words = ["".join(rng.choice("abé'sΣ.,漢1") for _ in range(rng.randrange(1, 9))) for _ in range(120)] + ["y" * 60, "ß" * 24, "ß" * 25]
    for _ in range(30):
        texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(5))]
        flat, at = t.encode(pa.array(texts, pa.string()))
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain(x) for x in texts]
        assert len(t.known) == len(t.size) == len(t.seen) <= parts and t.size.sum() == len(t.flat)
        assert all(len(x.encode()) <= t.LONGEST for x in t.known.to_pylist()) and len(set(t.known.to_pylist())) == len(t.known)


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, np.uint32)
    content = token_ids.pack(ids, 64, bits)
    assert token_ids.unpack(content).tolist() == ids.tolist()
    assert token_ids.unpack(content, n // 3, n // 2).tolist() == ids[n // 3 : n // 2].tolist()
    if n:
        broken = bytearray(content)
        broken[-20] ^= 1
        with pytest.raises(ValueError):
            token_ids.unpack(bytes(broken))


def test_documents(spark, docs):
    rows = [(30 - k, t) for k, t in enumerate(TEXTS)] + [(7, "same"), (7, "same"), (None, "none")]
    path = runtime.table_path(spark, "test")
    token_ids.write_shards(docs(rows), path, shard_ids=3000)
    got = token_ids.read_shards(spark, path).collect()
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*plain(t), 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    assert spark.read.parquet(path).count() > 1


def test_empty(spark, docs):
    path = runtime.table_path(spark, "test")
    token_ids.write_shards(docs([]), path)
    assert token_ids.read_shards(spark, path).count() == 0
