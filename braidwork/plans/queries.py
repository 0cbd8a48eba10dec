"""The engine's registered queries. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork import runtime
from braidwork.functions import text as T
from braidwork.operators import chunk, extract, graph, prompt, resolve, retrieve, vector
from braidwork.plans import fixtures as X
from braidwork.sources import documents, store

SMALL = ["ASIA", "EUROPE", "NATION_1", "NATION_6", "NATION_2", "NATION_7", "NATION_3", "Supplier#000000001", "Supplier#000000002"]
CENTRAL = ["ASIA", "NATION_1", "ATLANTIS", "NATION_2", "ASIA", "nobody"]


def _docs(s, d):
    return X.fixture(s, d, X.DOCS)


def _merge(s, d):
    return X.with_chunks(X.fixture(s, d, X.MERGE_ENTITIES))


def _graph(s, d):
    return X.fixture(s, d, X.GRAPH_ENTITIES), X.fixture(s, d, X.GRAPH_RELS)


def _vec(s, d):
    return X.with_chunks(X.fixture(s, d, X.VEC_ENTITIES)), X.fixture(s, d, X.VEC_RELS), X.fixture(s, d, X.VEC_CHUNKS)


def _retriever(s, d):
    e, r, c = _vec(s, d)
    v = X.query_vector(s, d)
    return retrieve.HybridRetriever(e, r, c, lambda _: v)


def _keyword(s, d):
    e, r = _graph(s, d)
    return retrieve.KeywordRetriever(e, r, _docs(s, d))


QUESTION = "Who trades with ASIA and NATION_1 or Europe?"


def _names(s, names=CENTRAL):
    return s.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, ord long")


# text
def clean_text(s, d):
    return _docs(s, d).select("id", T.clean_text(F.col("content")).alias("cleaned"))


def chunk_documents(s, d):
    return chunk.chunk_documents(_docs(s, d), 800, 150).select("id", "chunk_index", "start", "end", "text")


def token_estimate(s, d):
    return _docs(s, d).select("id", T.token_estimate(F.col("content")).alias("tokens"))


def extraction_prompt(s, d):
    return _docs(s, d).select("id", T.extraction_prompt(F.col("content")).alias("prompt"))


def normalize_name(s, d):
    return _merge(s, d).select("ord", T.normalize_name(F.concat(F.lit(" "), "name", F.lit("!, Co."))).alias("a"), T.normalize_name(F.col("name")).alias("b"))


def normalize_entity_name(s, d):
    return X.fixture(s, d, X.MERGE_RELS).select("ord", T.normalize_entity_name(F.concat(F.lit(" The  "), "source_entity")).alias("a"), T.normalize_entity_name(F.col("source_entity")).alias("b"))


def name_similarity(s, d):
    rows = _merge(s, d).select("ord", "name")
    other = rows.select((F.col("ord") - 1).alias("ord"), F.col("name").alias("other"))
    return rows.join(other, "ord").select("ord", F.round(T.name_similarity(F.col("name"), F.col("other")), 6).alias("similarity"))


# extraction
def parse_entities(s, d):
    rows = extract.parse_entities(X.fixture(s, d, X.MANY_RESPONSES))
    return rows.select("ord", F.col("pos").cast("int").alias("pos"), "name", "type", "description", F.array_join("source_chunks", ",").alias("chunks"), "confidence")


def parse_relationships(s, d):
    rows = extract.parse_relationships(X.fixture(s, d, X.MANY_RESPONSES))
    return rows.select("ord", F.col("pos").cast("int").alias("pos"), "source_entity", "target_entity", "relationship_type", "description", F.array_join("source_chunks", ",").alias("chunks"))


def extract_batch(s, d):
    """The model is a stub that names each text's first word."""
    chunks = chunk.chunk_documents(_docs(s, d), 800, 150).withColumn("ord", F.col("doc_ord") * 100000 + F.col("chunk_index"))

    def generate(prompts):
        bodies = [p.split("## Text to Process:\n")[1].split() for p in prompts]
        return [f"({b[0]}<|>concept<|>first word)##<|COMPLETE|>" if b else "" for b in bodies]

    return extract.parse_entities(extract.respond(chunks, generate)).select("ord", "name", "type")


# resolution
def name_similarity_join(s, d):
    return resolve.similar_pairs(_merge(s, d), 0.6).select("a", "b", F.round("similarity", 6).alias("similarity"))


def entity_pair_similarity(s, d):
    e, *_ = _vec(s, d)
    return resolve.entity_pairs(e, 0.6).select("a", "b", F.round("similarity", 6).alias("similarity"))


def greedy_clusters_embedding(s, d):
    e, *_ = _vec(s, d)
    return resolve.clusters(e, 0.6, embeddings=True)


def greedy_clusters(s, d):
    return resolve.clusters(_merge(s, d), 0.8)


def merge_entities(s, d):
    rows = resolve.merge_entities(_merge(s, d), 0.8)
    return rows.select("ord", "name", "type", "description", F.array_join("source_chunks", ",").alias("chunks"), F.round("confidence", 6).alias("confidence"))


def _rels(s, d):
    return X.with_chunks(X.fixture(s, d, X.MERGE_RELS))


def merge_relationships(s, d):
    rows = resolve.merge_relationships(_rels(s, d))
    return rows.select("ord", "source_entity", "target_entity", "relationship_type", "description", F.array_join("source_chunks", ",").alias("chunks"), F.round("confidence", 6).alias("confidence"))


# vectors
def _ranked(rows, value="similarity"):
    return rows.select("name", F.round(value, 6).alias("similarity"))


def cosine_similarity(s, d):
    e, *_ = _vec(s, d)
    return vector.scored(e, X.query_vector(s, d)).select("name", "similarity")


def clamped_cosine(s, d):
    e, *_ = _vec(s, d)
    v = F.array(*(F.lit(float(x)) for x in X.query_vector(s, d)))
    return e.select("name", F.round(T.clamped_cosine(F.col("embedding"), v), 6).alias("similarity"))


def entity_embedding_text(s, d):
    e, *_ = _vec(s, d)
    return e.select("ord", T.entity_text(F.col("name"), F.when(F.col("ord") % 5 > 0, F.col("description"))).alias("text"))


def search_entities(s, d):
    e, *_ = _vec(s, d)
    return _ranked(vector.search_entities(e, X.query_vector(s, d), 10, 0.0))


def similar_entities(s, d):
    e, *_ = _vec(s, d)
    return _ranked(vector.similar_entities(e, "vec_0", X.query_vector(s, d), 5))


def search_chunks(s, d):
    *_, c = _vec(s, d)
    return vector.search_chunks(c, X.query_vector(s, d), 5).select("id", "similarity")


def search_fallback(s, d):
    e, _, c = _vec(s, d)
    return vector.search_fallback(e, c, X.query_vector(s, d), 10).select("name", "similarity", "source")


def entity_context(s, d):
    e, *_ = _vec(s, d)
    return vector.entity_context(e, 500)


# graph
def adjacency(s, d):
    return graph.adjacency(_graph(s, d)[1]).select("src", "dst", "relationship_type", "rel_ord", "dir")


def find_neighbors(s, d):
    return graph.find_neighbors(*_graph(s, d)).select("src", "dst", "rel_ord", "dir", "rank")


def bfs_nodes(s, d):
    e, r, _ = _vec(s, d)
    return graph.bfs(e, r, ["vec_0", "vec_3", "nobody"], 2, 20)[0]


def bfs_edges(s, d):
    e, r, _ = _vec(s, d)
    return graph.bfs(e, r, ["vec_0", "vec_3", "nobody"], 2, 20)[1]


def simple_paths(s, d):
    return graph.simple_paths(*_graph(s, d), "NATION_1", "NATION_6", 4).select(F.array_join("path", ">").alias("path"))


def degree_centrality(s, d):
    return graph.degree_centrality(*_graph(s, d), _names(s))


def betweenness_approx(s, d):
    return graph.betweenness(*_graph(s, d), SMALL)


def expand_balanced(s, d):
    return graph.expand(*_graph(s, d), "ASIA")[0]


def expand_diverse(s, d):
    return graph.expand(*_graph(s, d), "NATION_2", "diverse_types")[0]


def entity_clusters(s, d):
    """Of all regions, nations and suppliers."""
    e, r = _graph(s, d)
    return graph.entity_clusters(r, e.filter("ord < 1000000").select("name", "ord")).select("name", "cluster")


def relationship_summary(s, d):
    return graph.relationship_summary(_graph(s, d)[1])


# retrieval
def hybrid_retrieve(s, d):
    return _retriever(s, d).retrieve(X.QUERY).entities.select("ord", "name", "score", "source")


def hybrid_relationships(s, d):
    return _retriever(s, d).retrieve(X.QUERY).relationships


def embedding_only(s, d):
    found = _retriever(s, d).retrieve(X.QUERY, "embedding_only")
    return found.entities.select(F.col("ord").cast("long").alias("ord"), "name", "similarity")


def graph_only(s, d):
    return _retriever(s, d).retrieve("what is vec_1 like", "graph_only").entities


def rank_combine(s, d):
    e, *_ = _vec(s, d)
    hits = s.createDataFrame([("vec_0", 0.9, 0), ("vec_1", 0.6, 1), ("vec_2", 0.4, 2)], "name string, similarity double, ord long")
    found = s.createDataFrame([(0, "vec_1"), (1, "vec_9"), (2, "vec_0"), (20, "vec_30")], "ord long, name string")
    return retrieve.rank_combine(hits, found, e, X.QUERY).select("name", "score", "source")


def relevance_boost(s, d):
    e, *_ = _vec(s, d)
    return e.select("name", F.round(retrieve.relevance(X.QUERY, F.col("name"), F.col("description")), 6).alias("boost"))


def induced_relationships(s, d):
    e, r, _ = _vec(s, d)
    return retrieve.induced_relationships(r, e.filter("type in ('L3', 'L5', 'L8')")).select("source_entity", "target_entity", "relationship_type", "ord")


def related_chunks(s, d):
    e, _, c = _vec(s, d)
    return retrieve.related_chunks(e.filter("ord in (41, 82, 7)"), c, X.query_vector(s, d)).select("id")


def retrieval_confidence(s, d):
    found = _retriever(s, d).retrieve(X.QUERY)
    return s.createDataFrame([(round(found.confidence, 6), found.metadata["graph_entities"], found.metadata["traversal_depth"])], "confidence double, entities int, depth int")


def query_expansion(s, d):
    return _retriever(s, d).query_expansion(X.QUERY)


def retrieval_stats(s, d):
    return _retriever(s, d).stats().withColumn("avg_entity_connections", F.round("avg_entity_connections", 6))


# keyword retrieval
def entity_index(s, d):
    return _keyword(s, d).index()


def type_index(s, d):
    return _keyword(s, d).types()


def find_entities(s, d):
    return _keyword(s, d).find(QUESTION).select("name", "type")


def related_entities(s, d):
    return _keyword(s, d).related(s.createDataFrame([("ASIA",), ("ATLANTIS",)], "name string"), 2)


def keyword_context(s, d):
    e, r, c = _vec(s, d)
    found = retrieve.KeywordRetriever(e, r, c.select("id", F.col("text").alias("content"), "ord")).context("is vec_1 or vec_2 near?")
    return found.select("entity", "source")


def entity_mentions(s, d):
    names = s.createDataFrame([("vec_7",), ("VEC_12",)], "name string")
    e, r, c = _vec(s, d)
    return retrieve.KeywordRetriever(e, r, c.select("id", F.col("text").alias("content"), "ord")).mentions(names).select("entity", "source")


# result sets and prompts
def filter_by_type(s, d):
    return prompt.filter_by_type(_merge(s, d), ["Brand#11", "Brand#23"]).select("ord", "name", "type")


def dedupe_results(s, d):
    return prompt.dedupe_results(_merge(s, d)).select("ord", "name")


def merge_traversals(s, d):
    r = _rels(s, d).select("source_entity", "target_entity", "relationship_type", "ord")
    e = _merge(s, d).select("name", "ord").withColumn("tag", F.lit("t"))
    _, edges, _, depth = prompt.merge_traversals([(e, r.filter("relationship_type = 'R'"), 1), (e, r, 2)])
    return edges.select("part", "ord", "source_entity", "target_entity", "relationship_type", F.lit(depth).alias("depth"))


def merge_traversal_entities(s, d):
    r = _rels(s, d).select("source_entity", "target_entity", "relationship_type", "ord")
    e = _merge(s, d).select("name", "ord", "type").withColumn("tag", F.lit("t"))
    return prompt.merge_traversals([(e.filter("type > 'Brand#2'"), r, 1), (e, r, 2)])[0].select("part", "ord", "name")


def _few(s, d):
    e, r, c = _vec(s, d)
    return e, r, c


def format_context(s, d):
    return prompt.format_context(*_few(s, d), most=1200)


def prompt_entities(s, d):
    e, *_ = _few(s, d)
    return prompt.prompt_entities(e.withColumn("description", F.concat_ws(" ", *["description"] * 12)))


def prompt_relationships(s, d):
    return prompt.prompt_relationships(_few(s, d)[1])


def prompt_chunks(s, d):
    return prompt.prompt_chunks(_few(s, d)[2])


def augmented_prompt(s, d):
    r = _retriever(s, d).retrieve(X.QUERY, include_chunks=True)
    e = r.entities
    return prompt.augmented_prompt(X.QUERY, e.select("ord", "name", "type", "description"), r.relationships, r.chunks)


# sources and sinks
def _round_trip(s, e, r):
    graph_store = store.GraphStore(s, runtime.table_path(s, "graph"))
    kind = graph_store.save(e, r, "graphs/graph")
    a, b = graph_store.load("graphs/graph")
    one = a.select(F.lit(kind).alias("kind"), "name", "type", "description", F.array_join("source_chunks", ",").alias("chunks"), F.round("confidence", 6).alias("confidence"))
    two = b.select(F.lit(kind), F.concat_ws("|", "source_entity", "target_entity"), "relationship_type", "description", F.array_join("source_chunks", ","), F.round("confidence", 6))
    return one.union(two)


def graph_json_roundtrip(s, d):
    """A small graph: what the responses hold."""
    empty = F.lit(None).cast("map<string,string>")
    rows = X.fixture(s, d, X.RESPONSES)
    return _round_trip(s, extract.parse_entities(rows).withColumn("properties", empty), extract.parse_relationships(rows).withColumn("properties", empty))


def graph_parquet_roundtrip(s, d):
    """A graph above the threshold."""
    return _round_trip(s, _merge(s, d), _rels(s, d))


def src_dir(s, d):
    """Text files written by the executors, then loaded and cleaned."""
    base = runtime.table_path(s, "texts")
    files = store.GraphStore(s, base)
    files.write_texts(_docs(s, d).select(F.concat(F.lit("sub/"), "id", F.lit(".txt")).alias("name"), F.col("content").alias("text")))
    files.write_text("sub/skip.csv", "a,b")
    return documents.load_documents(s, base)[0].select("id", "content")


def docs_sample(s, d):
    path = runtime.table_path(s, "docs")
    _docs(s, d).write.parquet(path)
    return documents.sample_documents(s, path, 25).select("id", "ord")


def all_queries() -> dict:
    own = (
        clean_text, chunk_documents, token_estimate, extraction_prompt, normalize_name, normalize_entity_name, name_similarity, parse_entities, parse_relationships, extract_batch,
        name_similarity_join, entity_pair_similarity, greedy_clusters, greedy_clusters_embedding, merge_entities, merge_relationships, cosine_similarity, clamped_cosine, entity_embedding_text, search_entities,
        similar_entities, search_chunks, search_fallback, entity_context, adjacency, find_neighbors, bfs_nodes, bfs_edges, simple_paths, degree_centrality, betweenness_approx, expand_balanced,
        expand_diverse, entity_clusters, relationship_summary, hybrid_retrieve, hybrid_relationships, embedding_only, graph_only, rank_combine, relevance_boost, induced_relationships, related_chunks,
        retrieval_confidence, query_expansion, retrieval_stats, entity_index, type_index, find_entities, related_entities, keyword_context, entity_mentions, filter_by_type, dedupe_results,
        merge_traversals, merge_traversal_entities, format_context, prompt_entities, prompt_relationships, prompt_chunks, augmented_prompt, graph_json_roundtrip, graph_parquet_roundtrip, src_dir, docs_sample,
    )
    return {f.__name__: f for f in own}
