import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from braidwork.llm import suffix_dedup


@pytest.mark.parametrize("seed", range(30))
def test_suffix_order(seed):
    rng = np.random.default_rng(seed)
    t = rng.integers(1, rng.choice([2, 3, 5, 200]) + 1, rng.integers(0, 120))
    if seed % 3 == 0:
        t = np.tile(t, 3)
    assert suffix_dedup.suffix_order(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def brute(rows, length):
    count = Counter(d[i : i + length] for _, d in rows for i in range(len(d) - length + 1))
    for i, d in rows:
        gone = np.zeros(len(d) + 2, bool)
        for j in range(len(d) - length + 1):
            if count[d[j : j + length]] > 1:
                gone[j + 1 : j + 1 + length] = True
        left = bytes(b for b, g in zip(d, gone[1:], strict=False) if not g)
        yield i, len(d), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(left).hexdigest()


def check(docs, rows, length, gram, most, limit, hot=20_000):
    got = suffix_dedup.remove(docs(rows), True, length, gram, most, limit, limit * 100, hot).collect()
    raw = [(i, (t or "").encode()) for i, t in rows]
    key = lambda r: (str(r[0]), *r[1:])
    assert all(r.n_kept == r.n_bytes - r.n_removed for r in got)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == sorted(brute(raw, length), key=key)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("length,gram,most,limit,hot", [(12, 4, 2500, 100, 20_000), (12, 4, 2, 0, 2), (24, 8, 3, 0, 1)])
def test_matches_brute_force(docs, length, gram, most, limit, hot):
    rng = random.Random(length + most)
    passages = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(5, 60))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(6)):
            parts.append(rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh漢") for _ in range(rng.randrange(30))))
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 200), (103, passages[0] * 5), (104, "same text again and again"), (104, "same text again and again"), (None, "same text again and agaim")]
    rows += [(105, "one row many times, of whatever length")] * 9
    check(docs, rows, length, gram, most, limit, hot)


def test_production_parameters(docs):
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdefghij klm") for _ in range(n))
    passage, line = prose(900), prose(60)
    rows = [(i, prose(rng.randrange(900)) + passage[rng.randrange(200) : 700 + rng.randrange(200)] + prose(rng.randrange(900)) + line) for i in range(40)]
    rows += [(50, prose(399)), (51, prose(400)), (52, rows[0][1]), (53, "x" * 100_000), (54, prose(400_000))]
    check(docs, rows, suffix_dedup.LENGTH, suffix_dedup.GRAM, 10, 100)


def test_passages_of_over_50_words_go_from_400_bytes_on(docs):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    short, long = words(57) + "x", words(57) + "xy"
    assert (len(short.split()), len(short), len(long)) == (57, 399, 400)
    rows = [(2 * k + j, f"{words(30)}{'ijklmnop'[2 * k + j]}{passage}{'qrstuvwz'[2 * k + j]}{words(30)}") for k, passage in enumerate((short, long)) for j in range(2)]
    rows.append((9, words(200)))
    got = {r.doc_id: (r.n_removed, r.n_spans, r.n_bytes - r.n_kept) for r in suffix_dedup.remove(docs(rows)).collect()}
    assert got == {0: (0, 0, 0), 1: (0, 0, 0), 2: (400, 1, 400), 3: (400, 1, 400), 9: (0, 0, 0)}


def test_long_texts_in_chunks(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 100)
    rng = random.Random(2)
    data = bytes(rng.choice(b"abc") for _ in range(1000))
    got = list(suffix_dedup.segments(data, 40, 8))
    assert sum(n for _, _, n, _ in got) == 961
    assert [s for _, s, n, _ in got for s in range(s, s + n)] == list(range(961))


def test_empty(docs):
    assert suffix_dedup.remove(docs([])).count() == 0
