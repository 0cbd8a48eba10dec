import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from braidwork.llm import ngram_lm

HELD = "crc32(cast(doc_id as string)) % 7 != 2"


def brute(rows, order, prior):
    grams, kinds, texts = Counter(), set(), []
    for i, t in rows:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        words = ["<b>", *re.findall("[^\x20\x09-\x0d]+", low), "<e>"]
        train = i is not None and zlib.crc32(str(i).encode()) % 7 != 2
        texts.append((i, words, train))
        if train:
            for m in range(1, order + 1):
                grams.update(tuple(words[k : k + m]) for k in range(len(words) - m + 1))
            kinds.update(words[1:])
    n = sum(c for g, c in grams.items() if len(g) == 1 and g != ("<b>",))

    def p(history, w):
        if not history:
            return (grams[(w,)] + 1) / (n + len(kinds) + 1)
        return (grams[(*history, w)] + prior * p(history[1:], w)) / (grams[tuple(history)] + prior)

    for i, words, train in texts:
        base = sum(math.log10(p([], w)) for w in words[1:])
        whole = sum(math.log10(p(words[max(0, k - order + 1) : k], words[k])) for k in range(1, len(words)))
        yield i, not train, len(words) - 1, sum(grams[(w,)] > 0 for w in words[1:]), n, base, whole


ROWS = [(1, "The cat sat on the mat"), (2, ""), (3, None), (4, "ÉCLAIR the cat\tsat\x0bOn"), (None, "the cat"), (4, "the cat"), (4, "the cat"), (9, "the " * 3000)]


def check(docs, rows, order, blocks, direct=ngram_lm.DIRECT):
    got = ngram_lm.score(docs(rows), F.expr(HELD), order=order, prior=2.0, block_bytes=blocks, direct=direct).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(brute(rows, order, 2.0), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_matches_brute_force(docs):
    rng = random.Random(1)
    rows = ROWS + [(100 + i, " ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randrange(40)))) for i in range(60)]
    check(docs, rows, 2, 500)
    check(docs, rows, 3, 100_000)
    check(docs, rows, 1, 5000)


def test_relays(docs):
    """Many blocks that speak to relays only give what one block gives; so does a row that repeats very often."""
    rng = random.Random(2)
    rows = ROWS + [(100 + i, " ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randrange(40)))) for i in range(60)] + [(7, "a row that repeats")] * 90
    check(docs, rows, 3, 1500, direct=2)


def test_equal_rows_are_dealt_apart(docs):
    rows = docs([(1, "one text " * 20)] * 400).select("doc_id", "text", F.lit(True).alias("train"), F.xxhash64("doc_id", "text").alias("h"))
    sizes = rows.mapInArrow(ngram_lm._deal(20), "block int, blob binary").collect()
    found = Counter()
    for r in sizes:
        found[r.block] += len(ngram_lm._texts(pa.array([r.blob]))[1])
    assert sum(found.values()) == 400 and max(found.values()) < 60


def test_sums_to_one(docs):
    rows = [(i, "a b c a b") for i in range(20)]
    probe = [(10_000 + k, w) for k, w in enumerate(["a", "b", "c", "zzz"])]
    got = {r.doc_id: r.score for r in ngram_lm.score(docs(rows + probe), F.col("doc_id") < 10_000).collect()}
    assert got[10_000] > got[10_003]


def test_empty(docs):
    assert ngram_lm.score(docs([]), F.expr(HELD)).count() == 0


def test_no_training_rows(docs):
    got = ngram_lm.score(docs([(1, "a b")]), F.lit(False)).collect()
    assert got[0].n_known == 0 and got[0].train_tokens == 0 and got[0].score == 0.0
