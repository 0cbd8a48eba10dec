import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from braidwork.llm import decontaminate


def grams(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def brute(rows, items):
    """The best similarity over all windows of each pair."""
    held = {i: grams(t) for i, t in items if grams(t)}
    df = Counter(g for x in held.values() for g in set(x))
    w = lambda g: 1 + math.log(len(held) / max(1, df[g]))
    for d, text in rows:
        own = grams(text)
        for i, x in held.items():
            best, ci = 0, Counter(x)
            for s in range(len(own)):
                cw = Counter(own[s : s + len(x)])
                both = sum(w(g) * min(c, ci[g]) for g, c in cw.items())
                best = max(best, both / (sum(w(g) * c for g, c in (cw | ci).items())))
            if best >= 0.8 - 1e-9:
                yield d, i, round(best, 6)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'clash' as m", "'clash' as h")


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(60)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(rng.randrange(20, 60)))) for i in range(12)]
    items += [(50, items[0][1] + " " + " ".join(prose(3))), (51, "too short here"), (52, None), (53, ""), (54, "a b c d e " * 8)]
    rows = []
    for d in range(60):
        words = prose(rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            own = (rng.choice(items[:14])[1] or "").upper().split()
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(own))
                own[k : k + rng.randrange(2)] = [rng.choice(vocabulary)]
            if rng.random() < 0.3:
                own = own[len(own) // 2 :] + own[: len(own) // 2]
            k = rng.randrange(len(words) + 1)
            words[k:k] = own
        rows.append((d, rng.choice([" ", ", ", "\n"]).join(words)))
    return rows + [(100, None), (101, ""), (102, "a b c d e " * 30), (103, "a b c d e " * 30)], items


@pytest.mark.parametrize("seed,limit", [(1, 1_000_000), (2, 0)])
def test_matches_brute_force(spark, docs, seed, limit):
    rows, items = corpus(seed)
    got = decontaminate.matches(docs(rows + rows[:5]), bench(spark, items + items[:2]), broadcast_rows=limit, broadcast_shingles=limit).collect()
    assert sorted((r.doc_id, r.item_id, round(r.similarity, 6)) for r in got) == sorted(brute(rows, items))
    assert len(got) > 10


def test_shared_preamble(spark, docs):
    """Items of one preamble: documents that end with an item's own part, or hold it after another preamble."""
    rng = random.Random(7)
    prose = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    long, short = prose(204), prose(34)
    own = [prose(rng.randrange(185, 215)) for _ in range(200)]
    items = [(i, " ".join((long if i < 150 else short) + x)) for i, x in enumerate(own)]
    rows = [(i, " ".join(prose(30) + own[i])) for i in range(60)]
    rows += [(i, " ".join(prose(30) + long[-30:] + own[i] + prose(60))) for i in range(150, 180)]
    held = {i: grams(t) for i, t in items}
    df = Counter(g for x in held.values() for g in set(x))
    w = lambda g: 1 + math.log(200 / max(1, df[g]))
    # only pairs that share enough can be similar
    want = []
    for d, text in rows:
        words = Counter(grams(text))
        for i, x in held.items():
            if sum(w(g) for g in x if g in words) >= 0.79 * sum(map(w, x)):
                c, g = Counter(x), grams(text)
                best = max(sum(w(h) * n for h, n in (k & c).items()) / sum(w(h) * n for h, n in (k | c).items()) for k in (Counter(g[s : s + len(x)]) for s in range(len(g))))
                want += [(d, i, round(best, 6))] if best >= 0.8 else []
    assert sum(d < 150 for d, *_ in want) > 40 and sum(d >= 150 for d, *_ in want) > 20
    got = decontaminate.matches(docs(rows), bench(spark, items)).collect()
    assert sorted((r.doc_id, r.item_id, round(r.similarity, 6)) for r in got) == sorted(want)


def test_radius_guarantee(spark, docs):
    """All pairs of fingerprints within the radius meet, whichever bits differ, and few others do."""
    rng = random.Random(1)
    item, rows, want = [rng.getrandbits(64) for _ in range(3)], [], {}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for k in range(300):
        n = rng.choice([0, 20, decontaminate.RADIUS - 1, decontaminate.RADIUS, decontaminate.RADIUS + 1, 96])
        own = list(item)
        for b in rng.sample(range(decontaminate.BITS), n):
            own[b // 64] ^= 1 << b % 64
        want[k] = n
        rows.append((k, 0, 7, 0, [signed(x) for x in own]))
    prints = spark.createDataFrame(rows, "__k long, __k2 int, m int, start int, print array<long>")
    total = spark.createDataFrame([(1, 7, [signed(x) for x in item]), (2, 8, [signed(x) for x in item])], "item long, m int, print array<long>")
    got = {r["__k"]: (r["item"], r["distance"]) for r in decontaminate.near_pairs(prints, total).collect()}
    assert got == {k: (1, n) for k, n in want.items() if n <= decontaminate.RADIUS}


def test_blocks_are_selective(spark, docs):
    """Unrelated fingerprints seldom meet in a block: 12 blocks, 697 of 65,536 values each."""
    rng = random.Random(3)
    one = lambda n, name: spark.createDataFrame([(i, [rng.getrandbits(63) - (1 << 62) for _ in range(3)]) for i in range(n)], f"{name} long, print array<long>")
    left = one(300, "a").select("a", F.inline(decontaminate.blocks(F.col("print"))))
    right = one(40, "b").select("b", F.inline(decontaminate.blocks(F.col("print")))).select("b", "block", F.explode(F.transform(decontaminate.flips(), lambda f: F.col("value").bitwiseXOR(f))).alias("value"))
    met = left.join(right, ["block", "value"]).select("a", "b").distinct().count()
    assert met < 0.16 * 300 * 40


def test_clashing_names(spark, docs):
    df = docs([(1, "a b c d e f g h"), (2, "x y z u v w")]).selectExpr("*", "'mine' as __k", "'mine' as __k2", "'mine' as row")
    out = decontaminate.clean(df, bench(spark, [(1, "a b c d e f g h")]))
    assert [(r.doc_id, r["__k"], r["__k2"], r["row"]) for r in out.collect()] == [(2, "mine", "mine", "mine")] and out.columns == df.columns


def test_clean(spark, docs):
    item = " ".join(f"word{i}" for i in range(30))
    rows = [(1, "before " + item + " after"), (2, "nothing here at all to see"), (2, "nothing here at all to see"), (None, item), (None, "fine"), (4, None), (5, "x " * 60_000 + item)]
    df = docs(rows)
    out = decontaminate.clean(df, bench(spark, [(1, item), (None, "other words than those above here")]))
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([rows[1], rows[2], rows[4], rows[5]], key=str)


def test_empty(spark, docs):
    assert decontaminate.matches(docs([]), bench(spark, [])).count() == 0
    assert decontaminate.clean(docs([(1, "a b c d e f")]), bench(spark, [])).count() == 1


def test_native(spark, docs):
    plan = decontaminate.matches(docs([(1, "a b c d e f")]), bench(spark, [(1, "a b c d e f")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
