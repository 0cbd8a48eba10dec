import random
import re

from braidwork.operators import resolve


def norm(n):
    n = n.lower().strip()
    for ending in (r"\s+inc\.?$", r"\s+corp\.?$", r"\s+ltd\.?$", r"\s+llc$", r"\s+co\.?$"):
        n = re.sub(ending, "", n)
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s.]", "", n)).strip()


def similarity(a, b):
    a, b = norm(a), norm(b)
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.9
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y)


def sequential(entities, threshold):
    """Greedy leaders, one after the other."""
    leader = {}
    for i, (n, t, o) in enumerate(entities):
        if o in leader:
            continue
        leader[o] = o
        for m, u, p in entities[i + 1 :]:
            if p not in leader and u.upper() == t.upper() and similarity(n, m) >= threshold:
                leader[p] = o
    return leader


def sample(seed, n=70):
    rng = random.Random(seed)
    words = ["acme", "labs", "the", "big", "co", "x", "data", "é", "new york"]
    return [(" ".join(rng.choice(words) for _ in range(rng.randrange(4))) + rng.choice(["", " Inc.", "!"]), rng.choice(["ORG", "org", "LOC"]), i) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(n, t, f"d{o % 3}" if o % 4 else "", [f"c{o % 5}"], 0.5 + o / 1000, {"k": str(o)}, o) for n, t, o in rows], "name string, type string, description string, source_chunks array<string>, confidence double, properties map<string,string>, ord long")


def test_greedy_leaders(spark):
    for seed, threshold in ((1, 0.8), (2, 0.5), (3, 0.95)):
        rows = sample(seed)
        got = {r.ord: r.leader for r in resolve.clusters(frame(spark, rows), threshold).collect()}
        assert got == sequential(rows, threshold)


def test_merge_entities(spark):
    rows = sample(5, 40)
    df = frame(spark, rows)
    data = {r.ord: r for r in df.collect()}
    leader = sequential(rows, 0.8)
    got = {r.ord: r for r in resolve.merge_entities(df, 0.8).collect()}
    assert set(got) == set(leader.values())
    for o, r in got.items():
        own = [data[i] for i in sorted(leader) if leader[i] == o]
        if len(own) == 1:
            assert (r.name, r.description, r.properties) == (own[0].name, own[0].description, own[0].properties)
            continue
        best = max(own, key=lambda e: (len(e.name.strip()), -e.ord))
        described = list(dict.fromkeys(e.description.strip() for e in own if e.description.strip()))
        assert (r.name, r.type, r.description, r.properties) == (best.name, own[0].type, " | ".join(described), None)
        assert r.source_chunks == sorted({c for e in own for c in e.source_chunks})
        assert abs(r.confidence - sum(e.confidence for e in own) / len(own)) < 1e-9


def test_merge_relationships(spark):
    rows = [("The A", "B", "R", "x", ["1"], 1.0, 0), ("a", "b", "R", "y", ["2"], 0.5, 1), ("a", "b", "R", "x", ["2"], 0.0, 2), ("a", "b", "S", "", ["3"], 1.0, 3), ("b", "a", "R", None, [], 1.0, 4)]
    df = spark.createDataFrame(rows, "source_entity string, target_entity string, relationship_type string, description string, source_chunks array<string>, confidence double, ord long")
    got = {r.ord: r for r in resolve.merge_relationships(df).collect()}
    assert sorted(got) == [0, 3, 4]
    assert (got[0].source_entity, got[0].description, got[0].source_chunks, got[0].confidence) == ("The A", "x; y", ["1", "2"], 0.5)
    assert got[3].description == "" and got[4].description is None


def test_merge_relationships_collects_once(spark):
    rows = [("The A", "b", "R", "y", ["c2"], 1.0, 3), ("a", "B ", "R", "x", ["c1"], 0.0, 5), (" A", "b", "R", "y", ["c2", None], 0.5, 2), ("a", "b", "S", None, [], 0.5, 1)]
    df = spark.createDataFrame(rows, "source_entity string, target_entity string, relationship_type string, description string, source_chunks array<string>, confidence double, ord long")
    got = resolve.merge_relationships(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("partial_count") < plan.index("Exchange hashpartitioning")
    assert {r.ord: tuple(r) for r in got.collect()} == {2: (" A", "b", "R", "x; y", ["c1", "c2", None], 0.5, 2, 3), 1: ("a", "b", "S", None, [], 0.5, 1, 1)}


def test_clusters_normalise_each_name_once(spark, monkeypatch):
    rows = [("Acme Inc.", "o", 3), ("Acme Inc.", "o", 1), ("acme", "O", 2), ("Acme Inc.", "p", 4), (None, "o", 5), ("x", None, 6)]
    seen, own = [], resolve.nodes
    monkeypatch.setattr(resolve, "nodes", lambda df: seen.append(df.count()) or own(df))
    got = resolve.clusters(spark.createDataFrame(rows, "name string, type string, ord long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 1), (4, 4)]
    assert max(seen) == 5  # of six entities
