import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from braidwork.llm import chosen_path

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(len(rows))]
    seen, out = [None] * len(rows), {}
    for i in range(len(rows)):
        if seen[i] is None:
            todo, seen[i] = [i], i
            while todo:
                for j in near[todo.pop()]:
                    if seen[j] is None:
                        seen[j] = i
                        todo.append(j)
    for i, (d, _) in enumerate(rows):
        out[d] = (min(rows[j][0] for j in range(len(rows)) if seen[j] == seen[i]), len(near[i]))
    return out


def corpus(seed, groups=25):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 150))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(100)}"
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "w"), (9004, "w")]


@pytest.mark.parametrize("seed,limit", [(1, 3000), (2, 0)])
def test_matches_brute_force(docs, seed, limit):
    rows = corpus(seed)
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.join(docs(rows), broadcast_bytes=limit * 100_000, hot_rows=20_000 if limit else 2).collect()}
    assert got == brute(rows)


def test_large_buckets_still_connect(docs):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        own[rng.randrange(len(own))] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = chosen_path.join(docs(rows), limit=40, depth=1).collect()
    assert {r.class_id for r in got} == {0}


@pytest.mark.parametrize("limit,depth", [(40, 1), (40, 4), (100, 4), (9, 0)])
def test_large_buckets_lose_no_link(docs, limit, depth):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.join(docs(rows), limit=limit, depth=depth).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("limit,tokens", [(3000, 1000), (40, 2500)])
def test_heavy_buckets_lose_no_link(docs, limit, tokens):
    """Buckets whose sets hold too many tokens are dealt into parts, also those that were dealt before."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosen_path.join(docs(rows), limit=limit, tokens=tokens).collect()}
    assert got == brute(rows)


def test_components_of_a_hub(spark, docs):
    """A hub, a chain and a pair, with hot keys."""
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 140)] + [(200, 201), (59, 300)]
    for hot in (1, 20_000):
        got = {r.a: r.b for r in chosen_path.components(spark.createDataFrame(edges, "a long, b long"), hot).collect()}
        assert got == {**dict.fromkeys([*range(60), 300], 0), **dict.fromkeys(range(100, 141), 100), 200: 200, 201: 200}


def test_string_ids_and_clashing_names(docs):
    text = " ".join(f"w{i}" for i in range(60))
    df = docs([(1, text), (2, text + " more"), (3, "other words")]).selectExpr("concat('id-', doc_id) as doc_id", "text", "'mine' as __k", "'mine' as k", "'mine' as k2", "'mine' as rows", "'mine' as row", "'mine' as wordless")
    assert {(r.doc_id, r.class_id) for r in chosen_path.join(df).collect()} == {("id-1", "id-1"), ("id-2", "id-1"), ("id-3", "id-3")}
    out = chosen_path.dedupe(df)
    assert out.columns == df.columns and {(r.doc_id, r["__k"], r.k, r.k2, r["row"]) for r in out.collect()} == {(i, "mine", "mine", "mine", "mine") for i in ("id-1", "id-3")}


def test_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(1, 900))).astype(np.uint64) for _ in range(40)]
    got = chosen_path.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(40) if i != j)


def test_dedupe(docs):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (3, text + " more"), (3, text + " more"), (None, text), (7, "other words here"), (8, ""), (8, ""), (9, None), (None, "only nameless words"), (None, "only nameless words"), (10, "long " * 50_000)]
    df = docs(rows)
    out = chosen_path.dedupe(df)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), r.text) for r in out.collect())
    assert got == sorted([("3", text + " more"), ("7", "other words here"), ("8", ""), ("8", ""), ("9", None), ("None", "only nameless words"), ("10", "long " * 50_000)], key=lambda r: (r[0], r[1] or "")) or sorted(map(str, got)) == sorted(map(str, [("3", text + " more"), ("7", "other words here"), ("8", ""), ("8", ""), ("9", None), ("None", "only nameless words"), ("10", "long " * 50_000)]))


def test_dedupe_goes_by_component(docs):
    """Unrelated texts of one doc_id all stay; of near copies without a doc_id one does."""
    base = [f"n{i}" for i in range(80)]
    near = [" ".join([*base[:-1], f"x{i}"]) for i in range(6)]
    apart = [" ".join(f"u{i}w{j}" for j in range(40)) for i in range(5)]
    kin = [a + " end" for a in apart]
    rows = [(None, t) for t in near] + [(1, t) for t in apart] + [(1, kin[0]), (2, kin[1]), (None, "lone words"), (1, ""), (1, None)]
    got = chosen_path.dedupe(docs(rows)).collect()
    assert sum(r.doc_id is None and r.text in near for r in got) == 1
    rest = sorted((str(r.doc_id), str(r.text)) for r in got if r.text not in near)
    first = [t for _, t in rest if t in (apart[0], kin[0])]
    assert len(first) == 1
    assert rest == sorted([("1", first[0]), *(("1", a) for a in apart[1:]), ("None", "lone words"), ("1", ""), ("1", "None")])


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")
def test_twin(spark, docs):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    columns = ("doc_id", "class_id", "n_links", "n_copies")
    want = con.sql(chosen_path.ORACLE_SQL).select(*columns).fetchall()
    got = chosen_path.op9_chosen_path(spark, FOLDER).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_low_similarity_is_refused(docs):
    with pytest.raises(ValueError, match="0.8"):
        chosen_path.join(docs([]), similarity=0.6)


def test_empty(docs):
    assert chosen_path.join(docs([])).count() == 0
    assert chosen_path.dedupe(docs([])).count() == 0
