import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from braidwork.llm import common, packing
from braidwork.llm.token_ids import vocabulary_path


@pytest.mark.parametrize("seed", range(12))
def test_limits(seed):
    rng = random.Random(seed)
    tokens, segments, loss = rng.choice([(64, 4, 20), (64, 64, 64), (50, 3, 10), (16, 1, 16)])
    totals = [rng.choice([1, 2, 7, 63, 64, 65, 500, rng.randrange(1, 90)]) for _ in range(rng.randrange(80))]
    bearing = [rng.randrange(t + 1) for t in totals]
    found = packing.pack(totals, bearing, tokens, segments, loss, 2)
    covered = defaultdict(list)
    for pieces in found:
        assert 0 < len(pieces) <= segments
        assert sum(p[2] for p in pieces) <= tokens
        assert sum(packing.loss_of(s, n, totals[d], bearing[d]) for d, s, n in pieces) <= loss
        for d, s, n in pieces:
            assert n > 0
            covered[d].append((s, n))
    for d, total in enumerate(totals):
        at = 0
        for s, n in sorted(covered[d]):
            assert s == at
            at += n
        assert at == total


def test_little_padding():
    rng = random.Random(5)
    totals = [int(rng.lognormvariate(6, 1.4)) + 1 for _ in range(3000)]
    found = packing.pack(totals, totals)
    sizes = [sum(p[2] for p in s) for s in found]
    padded = sum(n if n & (n - 1) == 0 else packing.SEQUENCE for n in sizes)
    assert padded / sum(totals) < 1.001


def test_documents(docs):
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "w " * 9000), (4, "w " * 9000), (None, "x y")]
    got = packing.pack_documents(docs(rows)).collect()
    t = Tokenizer.from_file(vocabulary_path())
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x in rows}
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += range(r.start, r.start + r.length)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, x in rows:
        assert sorted(seen[i]) == sorted(list(range(len(ids[i]))) * (2 if i == 4 else 1))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096


def test_instructions(spark, docs):
    df = docs([(i, "question answer words " * (i + 1)) for i in range(40)]).selectExpr("*", "10L as bearing")
    got = packing.pack_documents(df, bearing="bearing", tokens=256, segments=3, loss=12).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    assert all(sum(r.loss_tokens for r in s) <= 12 and len(s) <= 3 for s in by.values())


def test_conversations(spark, docs):
    """Answers alone bear loss, no limit is passed, and each of the three binds somewhere."""
    rows = []
    for c in range(400):
        long = [1, 40, 300][c % 3]
        rows += [(c, 0, "user", "question " * (3500 if c % 9 == 0 else 1 + (c // 3 * 7) % (900 if c % 3 == 2 else 30))), (c, 1, "assistant", "answer words " * long)]
    rows += [(1000, 0, "user", None), (1001, 0, "assistant", "alone"), (1002, 1, "user", "after"), (1002, 0, "assistant", "before"), (None, 0, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "'clash' as answer", "'clash' as doc_id")
    own = {r.doc_id: (r.text, r.answer) for r in packing.conversations(turns).collect()}
    assert own[1000] == ("user: \n", "") and own[1001] == ("", "assistant: alone\n") and own[1002] == ("assistant: before\nuser: after\n", "") and own[None] == (": x\n", "")
    got = packing.pack_documents(packing.conversations(turns), answer="answer", **packing.INSTRUCTIONS).collect()
    t = Tokenizer.from_file(vocabulary_path())
    count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    by, loss = defaultdict(list), defaultdict(int)
    for r in got:
        by[r.sequence_id].append(r)
        loss[r.doc_id] += r.loss_tokens
        text, answer = own[r.doc_id]
        assert r.doc_tokens == count(text) + count(answer) + 1
    for i, (_, answer) in own.items():
        cuts = sum(r.doc_id == i for r in got)
        assert count(answer) + 1 - cuts <= loss[i] <= count(answer) + 1
    sums = [(sum(r.length for r in s), len(s), sum(r.loss_tokens for r in s)) for s in by.values()]
    limits = tuple(packing.INSTRUCTIONS.values())
    assert all(x <= y for s in sums for x, y in zip(s, limits, strict=True))
    near = [sum(s[k] >= limits[k] - slack for s in sums) for k, slack in enumerate((8, 0, 8))]
    assert min(near) > 0, (near, [max(x) for x in zip(*sums, strict=True)], len(sums))


def test_empty(docs):
    assert packing.pack_documents(docs([])).count() == 0


def test_encodes_little_at_a_time(docs, monkeypatch):
    """A worker encodes about a million bytes of texts at once, as encoding takes many times their memory."""
    import pyarrow as pa
    import pyspark

    class Context:
        get = classmethod(lambda cls: cls())
        partitionId = staticmethod(lambda: 0)

    class Spy:
        largest = 0

        def encode(self, bodies):
            self.largest = max(self.largest, int(np.diff(common.offsets(bodies)[[0, -1]])[0]))
            return np.full(len(bodies), 7, "<u4"), np.arange(len(bodies) + 1)

    spy, df = Spy(), docs([])
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: f)
    monkeypatch.setattr(packing, "word_tokenizer", lambda path: spy)
    monkeypatch.setattr(pyspark, "TaskContext", Context)
    texts = pa.array(["some words " * 4000] * 240)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(240), pa.int64()), "text": texts, "bearing": pa.nulls(240, pa.int64()), "answer": pa.nulls(240, pa.string())})
    got = pa.Table.from_batches(packing.pack_documents(df)(iter([batch])))
    assert got.num_rows == 240 and sum(got["length"].to_pylist()) == 480
    assert 0 < spy.largest <= 1_000_000
