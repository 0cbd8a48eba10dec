import random
from collections import Counter, defaultdict, deque

from braidwork import runtime
from braidwork.operators import graph, retrieve, vector


def make(spark, seed, n=14, m=30):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(n)]
    entities = [(x, rng.choice("AB"), f"about {x}", i) for i, x in enumerate(names[:-2])]
    edges = [(rng.choice(names), rng.choice(names), rng.choice("RS"), "d", rng.randrange(4) / 4, i) for i in range(m)]
    e = spark.createDataFrame(entities, "name string, type string, description string, ord long")
    r = spark.createDataFrame(edges, "source_entity string, target_entity string, relationship_type string, description string, confidence double, ord long")
    lists = defaultdict(list)
    for edge in edges:
        lists[edge[0]].append((edge[1], edge))
        lists[edge[1]].append((edge[0], edge))
    return e, r, {x[0] for x in entities}, lists, names, edges


def near(lists, known, name, most):
    own = [x for x in lists[name] if x[0] in known]
    return sorted(own, key=lambda x: -x[1][4])[:most]


def walk(lists, known, seeds, max_depth, cap):
    """First in, first out, one vertex at a time."""
    found, kept, visited, queue, deepest = [], [], set(), deque(), 0
    for s in seeds:
        if s in known:
            found.append(s)
            visited.add(s)
            queue.append((s, 0))
    while queue and len(found) < cap:
        name, depth = queue.popleft()
        deepest = max(deepest, depth)
        if depth >= max_depth:
            continue
        for other, edge in near(lists, known, name, 5):
            if len(found) >= cap:
                break
            if edge[:5] not in kept:
                kept.append(edge[:5])
            if other not in visited:
                visited.add(other)
                found.append(other)
                queue.append((other, depth + 1))
    return found, kept, deepest


def test_bfs(spark):
    for seed in range(5):
        e, r, known, lists, names, _ = make(spark, seed)
        seeds = [names[seed], names[-1], names[3], names[seed]][: 2 + seed % 3]
        for depth, cap in ((2, 20), (3, 6), (1, 3), (0, 5)):
            nodes, edges, reached = graph.bfs(e, r, seeds, depth, cap)
            found, kept, deepest = walk(lists, known, seeds, depth, cap)
            assert [x.name for x in sorted(nodes.collect(), key=lambda x: x.ord)] == found
            assert [tuple(x)[1:] for x in sorted(edges.collect(), key=lambda x: x.ord)] == kept
            if len(found) < cap:
                assert reached == deepest


def test_bfs_compares_whole_relationships(spark):
    """Two edges that differ in what they cite alone are two; equal ones are one."""
    e = spark.createDataFrame([("a", "T", 0), ("b", "T", 1)], "name string, type string, ord long")
    rows = [("a", "b", "R", "d", 0.5, ["c1"], {"k": "1"}, 0), ("a", "b", "R", "d", 0.5, ["c2"], {"k": "1"}, 1), ("a", "b", "R", "d", 0.5, ["c1"], {"k": "1"}, 2)]
    r = spark.createDataFrame(rows, "source_entity string, target_entity string, relationship_type string, description string, confidence double, source_chunks array<string>, properties map<string,string>, ord long")
    edges = graph.bfs(e, r, ["a"])[1]
    assert [(x.ord, x.source_chunks, x.properties) for x in edges.orderBy("ord").collect()] == [(0, ["c1"], {"k": "1"}), (1, ["c2"], {"k": "1"})]


def test_mentions_by_shuffle(spark):
    """Many names meet the texts by three characters; short ones are compared with all."""
    docs = spark.createDataFrame([("d1", "Ann and BOB met É.T. in ΣΑΣ", 0), ("d2", "", 1), ("d3", None, 2), ("d4", "anna", 3)], "id string, content string, ord long")
    names = spark.createDataFrame([("ann",), ("Bob",), ("é",), ("x",), ("Anna",), ("nobody",), ("ann",)], "name string")
    found = lambda most: {(x.entity, x.source) for x in retrieve.KeywordRetriever(None, None, docs).mentions(names, most).collect()}
    assert found(100) == found(2) == {("ann", "d1"), ("Bob", "d1"), ("é", "d1"), ("ann", "d4"), ("Anna", "d4")}


def test_neighbours_and_expansion(spark):
    e, r, known, lists, names, _ = make(spark, 7)
    got = defaultdict(list)
    for x in graph.find_neighbors(e, r, None, 4).orderBy("rank").collect():
        got[x.src].append((x.dst, x.rel_ord))
    assert got == {n: [(o, edge[5]) for o, edge in near(lists, known, n, 4)] for n in names if near(lists, known, n, 4)}
    nodes, edges = graph.expand(e, r, "n0", max_entities=5)
    assert [x.name for x in nodes.orderBy("ord").collect()] == ["n0"] + [o for o, _ in near(lists, known, "n0", 20)][:4]
    assert graph.expand(e, r, "nobody")[0].count() == 0 and graph.expand(e, r, "nobody")[1].count() == 0


def test_paths(spark):
    e, r, known, lists, names, _ = make(spark, 2, m=22)

    def paths(path, end):
        if path[-1] == end:
            return [path]
        return [p for o, _ in lists[path[-1]] if o not in path and len(path) < 4 for p in paths([*path, o], end)]

    got = Counter(tuple(x.path) for x in graph.simple_paths(e, r, "n0", "n1").collect())
    assert got == Counter(map(tuple, paths(["n0"], "n1")))
    assert [x.path for x in graph.simple_paths(e, r, "n0", "n0").collect()] == [["n0"]]
    assert graph.simple_paths(e, r, "n0", names[-1]).count() == 0


def test_clusters(spark):
    e, r, known, lists, names, edges = make(spark, 4, n=30, m=18)
    own = names[::2]
    got = {x.name: x.cluster for x in graph.entity_clusters(r, spark.createDataFrame([(n, i) for i, n in enumerate(own)], "name string, ord long")).collect()}
    label = {n: i for i, n in enumerate(own)}
    for _ in own:
        for a, b, *_ in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_last_entity_of_a_name_counts(spark):
    e = spark.createDataFrame([("a", "T1", "x", 0), ("a", "T2", "y", 1)], "name string, type string, description string, ord long")
    assert [(x.type, x.ord) for x in graph.vertices(e).collect()] == [("T2", 1)]


def test_retrieval_edges(spark):
    e = spark.createDataFrame([("alpha beta", "T", "d", [1.0, 0.0], ["c1"], 0), ("gamma", "T", None, None, [], 1)], "name string, type string, description string, embedding array<float>, source_chunks array<string>, ord long")
    r = spark.createDataFrame([], "source_entity string, target_entity string, relationship_type string, description string, confidence double, ord long")
    c = spark.createDataFrame([("c1", "about Gamma", [0.0, 1.0], 0)], "id string, text string, embedding array<float>, ord long")
    found = retrieve.HybridRetriever(e, r, c, lambda _: [0.0, 1.0])
    got = found.retrieve("which gamma", include_chunks=True)
    assert [(x.name, x.source) for x in got.entities.orderBy("ord").collect()] == [("gamma", "both")]
    assert got.confidence == 0.5 + 0.02 and got.chunks.count() == 1
    assert found.retrieve("  ", "embedding_only").entities.count() == 0
    assert found.graph_seeds("nothing here") == ["alpha beta"] and found.graph_seeds("is BETA it") == ["alpha beta"]
    assert retrieve.confidence([], 3, 3) == 0.3
    assert vector.entity_context(e, 20).first().context == ""
    assert found.retrieve("x", "unknown method").method == "hybrid"


def test_related_chunks_reads_texts_of_the_chosen_alone(spark, tmp_path):
    rows = [(f"c{i}", f"text {i}", [float(i), 1.0], i) for i in range(20)]
    spark.createDataFrame(rows, "id string, text string, embedding array<double>, ord long").write.parquet(str(tmp_path / "c"))
    cites = spark.createDataFrame([(["c9", "c3", "none"],), (["c3"],)], "source_chunks array<string>")
    got = retrieve.related_chunks(cites, spark.read.parquet(str(tmp_path / "c")), [0.0, 1.0], 4)
    assert "In(id" in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, r.text, r["rank"]) for r in got.collect()] == [("c3", "text 3", 0), ("c9", "text 9", 0), ("c0", "text 0", 1), ("c1", "text 1", 1)]


def test_edges_are_read_once_in_tasks_that_grow_with_files(spark, tmp_path):
    spark.createDataFrame([("a", "b", "R", "d", 1.0, 0), ("b", "a", "R", "d", 0.5, 1), ("b", "x", "R", "d", 0.9, 2)], "source_entity string, target_entity string, relationship_type string, description string, confidence double, ord long").write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([("a", "T", 0), ("b", "T", 1)], "name string, type string, ord long").write.parquet(str(tmp_path / "e"))
    e, r = (spark.read.parquet(str(tmp_path / k)) for k in "er")
    assert runtime.partitions(e, r, each=10) > 50 and runtime.partitions(e, r) == spark.sparkContext.defaultParallelism
    found = graph.find_neighbors(e, r)
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
    assert sorted((x.src, x.dst, x.rel_ord, x["dir"], x["rank"]) for x in found.collect()) == [("a", "b", 0, 0, 1), ("a", "b", 1, 1, 2), ("b", "a", 0, 1, 1), ("b", "a", 1, 0, 2), ("x", "b", 2, 1, 1)]


def test_betweenness_deals_a_hubs_edges(spark):
    edges = [("hub", f"v{i}", "R", "d", 1.0, i) for i in range(50)] + [("b", "v7", "R", "d", 1.0, 50), ("v9", "b", "R", "d", 1.0, 51), ("hub", "hub", "R", "d", 1.0, 52), ("c", "hub", "R", "d", 1.0, 53), ("b", "c", "R", "d", 1.0, 54)]
    r = spark.createDataFrame(edges, "source_entity string, target_entity string, relationship_type string, description string, confidence double, ord long")
    e = spark.createDataFrame([(n, "T", i) for i, n in enumerate(["hub", "b", "c", "v7", "v9"])], "name string, type string, ord long")
    got = graph.betweenness(e, r, ["hub", "b", "nobody", "hub"])
    assert "hashpartitioning(dst" in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(x) for x in got.collect()] == [("v7", 2.0)]  # of (hub, b) and of (b, hub)
