"""Hybrid, embedding, graph and keyword retrieval over a graph and chunks."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, StructField, StructType

from braidwork.functions.text import words
from braidwork.operators import graph, vector
from braidwork.sources.store import load_json


@dataclass
class Retrieval:
    """entities, relationships and chunks are in order of their column `ord`."""

    entities: DataFrame
    relationships: DataFrame
    chunks: DataFrame | None
    method: str
    confidence: float
    metadata: dict = field(default_factory=dict)


def relevance(query: str, name: Column, description: Column) -> Column:
    """0.3 and 0.2 times the shares of the query's words in the name and the description; punctuation counts."""
    terms = list(dict.fromkeys(query.lower().split()))
    if not terms:
        return F.lit(0.0)
    share = lambda c: F.size(F.array_intersect(F.array(*map(F.lit, terms)), words(F.lower(F.coalesce(c, F.lit("")))))) / F.lit(float(len(terms)))
    return share(name) * 0.3 + share(description) * 0.2


def rank_combine(hits: DataFrame, found: DataFrame, entities: DataFrame, query: str) -> DataFrame:
    """name, score, source of hits (name, similarity, ord) and traversed entities (name, ord), best first by (score desc, at).

    Both are bounded by the retriever's top k.
    """
    rank = F.row_number().over(W.orderBy("ord")) - 1
    seeds = hits.withColumn("i", rank).groupBy("name").agg(F.max_by("similarity", "i").alias("similarity"), F.max("i").alias("i"), F.min("i").alias("at"))
    walk = found.groupBy("name").agg(F.min("ord").alias("j"), F.count(F.lit(1)).alias("n"))
    both = seeds.join(walk, "name", "full_outer")
    own = F.col("similarity") * (1.0 - F.col("i") * 0.1) + 0.5 + 0.3 * F.coalesce("n", F.lit(0))
    # a name that only the traversal has and that repeats there is found again, which adds 0.3
    met = F.greatest(F.lit(0.1), 0.8 - F.col("j") * 0.05) + 0.3 * (F.col("n") - 1)
    source = F.when(F.col("i").isNotNull() & F.col("j").isNotNull(), "both").when(F.col("i").isNotNull(), "embedding").when(F.col("n") > 1, "both").otherwise("traversal")
    rows = both.select("name", F.when(F.col("i").isNotNull(), own).otherwise(met).alias("score"), source.alias("source"), F.coalesce("at", F.col("j") + 1000).alias("at"))
    rows = rows.join(graph.vertices(entities.select("name", "type", "description", "ord")), "name", "left")
    return rows.withColumn("score", F.round(F.col("score") + relevance(query, F.col("name"), F.col("description")), 6))


def induced_relationships(edges: DataFrame, names: DataFrame) -> DataFrame:
    one = lambda x: names.select(F.col("name").alias(x)).distinct()
    return edges.join(one("source_entity"), "source_entity", "left_semi").join(one("target_entity"), "target_entity", "left_semi")


def related_chunks(entities: DataFrame, chunks: DataFrame, query_vector, most: int = 5) -> DataFrame:
    """Chunks that the entities cite, in corpus order, then the most similar ones that aren't cited, `most` in all."""
    keys = ["id", "ord"]  # few chunks are chosen by these; only then are their texts read
    cited = entities.select(F.explode("source_chunks").alias("id")).distinct()
    own = [tuple(r) for r in chunks.select(keys).join(cited, "id", "left_semi").orderBy("ord").limit(most).collect()]
    near = []
    if len(own) < most:
        names = {r[0] for r in own}
        near = [(r["id"], r["ord"]) for r in vector.search_chunks(chunks.select(*keys, "embedding"), query_vector, most - len(own)).collect()]
        near = [r for r in near if r[0] not in names]
    picks = dict.fromkeys([(*r, 0) for r in own] + [(*r, 1) for r in near])
    schema = StructType([*(chunks.schema[k] for k in keys), StructField("rank", IntegerType())])
    chosen = F.broadcast(chunks.sparkSession.createDataFrame(list(picks), schema))
    rows = chunks.filter(F.col("id").isin([p[0] for p in picks]) & F.col("ord").isin([p[1] for p in picks])).join(chosen, keys)
    return rows.select(*chunks.columns, "rank").orderBy("rank", "ord").limit(most)


def confidence(similarities: list[float], n_entities: int, n_relationships: int) -> float:
    if not similarities:
        return 0.3
    return min(1.0, sum(similarities) / len(similarities) + min(0.2, 0.02 * n_entities) + min(0.1, 0.01 * n_relationships))


class HybridRetriever:
    """entities with embedding and source_chunks, relationships, chunks with embedding; encode: text -> vector."""

    def __init__(self, entities: DataFrame, relationships: DataFrame, chunks: DataFrame | None = None, encode=None):
        self.entities, self.relationships, self.chunks, self.encode = entities, relationships, chunks, encode

    def _vector(self, query: str, given):
        if given is not None:
            return given
        return self.encode(query) if query.strip() and self.encode else None

    def retrieve(self, query: str, method: str = "hybrid", top_k: int = 10, max_depth: int = 2, include_chunks: bool = False, query_vector=None) -> Retrieval:
        found = {"embedding_only": self.embedding_only, "graph_only": self.graph_only}.get(method, self.hybrid)
        began = time.perf_counter()
        out = found(query, top_k=top_k, max_depth=max_depth, include_chunks=include_chunks, query_vector=query_vector)
        out.metadata["retrieval_time"] = time.perf_counter() - began  # of what the driver waits for; results are read later
        return out

    def hybrid(self, query, top_k=10, max_depth=2, include_chunks=False, query_vector=None) -> Retrieval:
        v = self._vector(query, query_vector)
        hits = vector.search_entities(self.entities, v, min(top_k // 2, 5), 0.3)
        rows = hits.select("name", "similarity", "ord").collect()  # five rows at most
        if not rows and self.chunks is not None:
            rows = vector.search_fallback(self.entities, self.chunks, v, 3).select("name", "similarity", "ord").collect()
        spark = self.entities.sparkSession
        seeds = spark.createDataFrame([(r.name, float(r.similarity), i) for i, r in enumerate(rows)], "name string, similarity double, ord long")
        nodes, edges, depth = graph.bfs(self.entities, self.relationships, [r.name for r in rows], max_depth, top_k)
        ranked = rank_combine(seeds, nodes, self.entities, query).orderBy(F.desc("score"), "at")
        final = ranked.withColumn("ord", F.row_number().over(W.orderBy(F.desc("score"), "at")) - 1).filter(F.col("ord") < top_k)
        chunks = None
        if include_chunks and self.chunks is not None:
            best = self.entities.join(F.broadcast(final.filter("ord < 5").select("name")), "name", "left_semi")
            chunks = related_chunks(best, self.chunks, v)
        n_nodes, n_edges = nodes.count(), edges.count()
        sure = confidence([r.similarity for r in rows], n_nodes, n_edges)
        return Retrieval(final, edges, chunks, "hybrid", sure, {"seed_entities": len(rows), "traversal_depth": depth, "embedding_results": len(rows), "graph_entities": n_nodes})

    def embedding_only(self, query, top_k=10, max_depth=2, include_chunks=False, query_vector=None) -> Retrieval:
        v = self._vector(query, query_vector)
        hits = vector.search_entities(self.entities, v, top_k)
        final = hits.withColumn("rank", F.row_number().over(W.orderBy(F.desc("similarity"), "ord")) - 1)
        edges = induced_relationships(self.relationships, F.broadcast(hits.select("name")))
        chunks = related_chunks(final.filter("rank < 5"), self.chunks, v) if include_chunks and self.chunks is not None else None
        sims = [r.similarity for r in hits.select("similarity").collect()]
        return Retrieval(final.drop("ord").withColumnRenamed("rank", "ord"), edges, chunks, "embedding_only", sum(sims) / len(sims) if sims else 0.0, {"embedding_results": len(sims)})

    def graph_seeds(self, query: str) -> list[str]:
        """Up to three of the first twenty entities whose name holds a word of the query; else the first entity."""
        first = self.entities.orderBy("ord").limit(20).select("name").collect()
        terms = query.lower().split()
        named = [r.name for r in first if any(t in r.name.lower() for t in terms)][:3]
        return named or [r.name for r in first[:1]]

    def graph_only(self, query, top_k=10, max_depth=2, include_chunks=False, query_vector=None) -> Retrieval:
        nodes, edges, depth = graph.bfs(self.entities, self.relationships, self.graph_seeds(query), max_depth, top_k)
        chunks = None
        if include_chunks and self.chunks is not None:
            best = self.entities.join(F.broadcast(nodes.orderBy("ord").limit(5).select("name")), "name", "left_semi")
            chunks = related_chunks(best, self.chunks, self._vector(query, query_vector))
        return Retrieval(nodes, edges, chunks, "graph_only", 0.5, {"traversal_depth": depth})

    def query_expansion(self, query: str, query_vector=None) -> DataFrame:
        """`term`: the query's words, and those of the three best entities' names and of their descriptions' first five."""
        hits = vector.search_entities(self.entities, self._vector(query, query_vector), 3)
        split = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
        terms = hits.select(F.explode(F.concat(split(F.col("name")), F.slice(split(F.col("description")), 1, 5))).alias("term"))
        own = self.entities.sparkSession.createDataFrame([(w,) for w in query.split()], "term string")
        return terms.unionByName(own).distinct()

    def stats(self) -> DataFrame:
        n = self.entities.agg(F.count(F.lit(1)).alias("total_entities"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("entity_types"))
        m = self.relationships.agg(F.count(F.lit(1)).alias("total_relationships"), F.array_join(F.array_sort(F.collect_set("relationship_type")), ",").alias("relationship_types"))
        chunks = self.chunks.agg(F.count(F.lit(1)).alias("total_chunks")) if self.chunks is not None else self.entities.sparkSession.createDataFrame([(0,)], "total_chunks long")
        one = lambda df: df.withColumn("one", F.lit(1))
        rows = one(n).join(one(m), "one").join(one(chunks), "one").drop("one")
        return rows.withColumn("avg_entity_connections", F.coalesce(F.try_divide(F.col("total_relationships").cast("double"), F.col("total_entities").cast("double")), F.lit(0.0)))


def create_retriever(entities: DataFrame, relationships: DataFrame, encode, chunks: DataFrame | None = None) -> HybridRetriever:
    """A retriever over what a build has extracted."""
    return HybridRetriever(entities, relationships, chunks, encode)


#: Names that are compared with every text; more of them meet texts by three characters.
MOST_NAMES = 10_000


class KeywordRetriever:
    """Finds entities by their names in a question, their surroundings, and the texts that name those."""

    def __init__(self, entities: DataFrame, relationships: DataFrame, documents: DataFrame):
        self.entities, self.relationships, self.documents = entities, relationships, documents

    @classmethod
    def from_json(cls, spark, path: str, documents: DataFrame) -> KeywordRetriever:
        """Over the entities and relationships of one JSON file."""
        return cls(*load_json(spark, path), documents)

    def index(self) -> DataFrame:
        """key (lower-case name), name and type of the last entity of the key, at: the first one's ord."""
        return self.entities.groupBy(F.lower("name").alias("key")).agg(F.max_by(F.struct("name", "type"), "ord").alias("e"), F.min("ord").alias("at")).select("key", "e.name", "e.type", "at")

    def types(self) -> DataFrame:
        return self.entities.groupBy("type").agg(F.count(F.lit(1)).alias("n"))

    def find(self, question: str) -> DataFrame:
        return self.index().filter(F.lit(question.lower()).contains(F.col("key")))

    def related(self, names: DataFrame, hops: int = 2) -> DataFrame:
        """start, name: reached from each start (name) within the hops. An edge inside the frontier yields its target; the start may return."""
        edges = self.relationships.select("source_entity", "target_entity")
        frontier = names.select(F.col("name").alias("start"), "name").distinct()
        out = None
        for _ in range(hops):
            forward = edges.join(frontier, F.col("source_entity") == F.col("name")).select("start", F.col("target_entity").alias("name"))
            inside = frontier.select(F.col("start").alias("s"), F.col("name").alias("n"))
            back = edges.join(frontier, F.col("target_entity") == F.col("name")).join(inside, (F.col("start") == F.col("s")) & (F.col("source_entity") == F.col("n")), "left_anti").select("start", F.col("source_entity").alias("name"))
            frontier = forward.unionByName(back).distinct()
            out = frontier if out is None else out.unionByName(frontier).distinct()
        return out if out is not None else frontier.limit(0)

    def mentions(self, names: DataFrame, most: int = MOST_NAMES) -> DataFrame:
        """entity, source, text of the documents (id, content, ord) that hold a name in any case.

        Up to `most` names, counted first, are compared with every text. Of more,
        those of three characters or more meet the texts that hold their first three.
        """
        few = names.select(F.col("name").alias("entity")).distinct()
        out = lambda rows: rows.select("entity", F.col("id").alias("source"), F.col("content").alias("text"), "ord")
        holds = F.lower("content").contains(F.lower("entity"))
        if few.limit(most + 1).count() <= most:
            return out(self.documents.join(F.broadcast(few), holds))
        low = F.lower("content")
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, 3)))
        held = self.documents.withColumn("gram", F.explode(grams)).join(few.filter(F.length(F.lower("entity")) >= 3).withColumn("gram", F.substring(F.lower("entity"), 1, 3)), "gram").filter(holds)
        short = self.documents.join(few.filter(F.length(F.lower("entity")) < 3), holds)
        return out(held).unionByName(out(short))

    def context(self, question: str, max_entities: int = 10, hops: int = 2) -> DataFrame:
        """Texts that name what surrounds the question's first five entities; the first max_entities of these by name."""
        first = self.find(question).orderBy("at").limit(5)
        near = self.related(first, hops).select("name").distinct().orderBy("name").limit(max_entities)
        return self.mentions(near)
