"""Graph operators over vertices (name, type, ..., ord) and edges
(source_entity, target_entity, relationship_type, description, confidence, ord).

Edges are undirected for traversal. Names may repeat among entities: the last
one counts. Edges may name vertices that are no entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType, StructField, StructType

from braidwork.runtime import cut, partitions


def vertices(entities: DataFrame) -> DataFrame:
    """One row a name: the last entity of that name."""
    rest = [c for c in entities.columns if c not in ("name", "ord")]
    last = F.max_by(F.struct(*rest), "ord") if rest else None
    rows = entities.groupBy("name").agg(F.max("ord").alias("ord"), *([last.alias("r")] if rest else []))
    return rows.select("name", "ord", *(F.col("r")[c].alias(c) for c in rest))


def adjacency(edges: DataFrame) -> DataFrame:
    """src, dst, relationship_type, confidence, rel_ord, dir: each edge both ways; (rel_ord, dir) is the order of a vertex's list."""
    one = lambda a, b, d: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(d).alias("dir"))
    rows = edges.select(F.inline(F.array(one("source_entity", "target_entity", 0), one("target_entity", "source_entity", 1))), "relationship_type", "description", "confidence", F.col("ord").alias("rel_ord"))
    return rows.select("src", "dst", "relationship_type", "description", "confidence", "rel_ord", "dir")


def adjacency_of(edges: DataFrame, names: list[str]) -> DataFrame:
    """The adjacency whose src is one of the names: edges are filtered before they are turned."""
    names = list(names)
    return adjacency(edges.filter(F.col("source_entity").isin(names) | F.col("target_entity").isin(names))).filter(F.col("src").isin(names))


def find_neighbors(entities: DataFrame, edges: DataFrame, names: list[str] | None = None, most: int = 10) -> DataFrame:
    """src, dst, rank and the edge, for the `most` best neighbours that are entities; an edge that repeats takes a place each time."""
    known = vertices(entities.select("name", "type", "ord")).select(F.col("name").alias("dst"), F.col("type").alias("dst_type"))
    if names is not None:
        rows = adjacency_of(edges, names)
    else:  # all edges are sorted here: their tasks' share must not grow with the tables
        n = partitions(entities, edges)
        rows, known = adjacency(edges).repartition(n, "dst"), known.repartition(n, "dst")
    rows = rows.join(known, "dst")
    rank = F.row_number().over(W.partitionBy("src").orderBy(F.desc("confidence"), "rel_ord", "dir"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most)


def _hashable(value):
    """A list or map of a row, so that sets can hold it."""
    if isinstance(value, list):
        return tuple(map(_hashable, value))
    return tuple(sorted((k, _hashable(v)) for k, v in value.items())) if isinstance(value, dict) else value


def bfs(entities: DataFrame, edges: DataFrame, seeds: list[str], max_depth: int = 2, max_entities: int = 20, per_node: int = 5) -> tuple[DataFrame, DataFrame, int]:
    """Found entities (ord, depth, name, tag), their edges (ord, ...) and the depth reached.

    Level by level: each level is one job over the edges of the level's vertices.
    What comes to the driver is bounded by max_entities * per_node rows a level.
    """
    spark = entities.sparkSession
    known = {r.name for r in entities.filter(F.col("name").isin(list(dict.fromkeys(seeds)))).select("name").distinct().collect()}
    found = [(0, s) for s in seeds if s in known]  # a seed given twice is found twice
    tags = [f"seed:{s}" for _, s in found]
    visited, kept, values = set(known), [], set()
    level, depth = [s for _, s in found], 0
    columns = [c for c in edges.columns if c != "ord"]  # relationships are one if they agree in all of them
    while level and len(found) < max_entities and depth < max_depth:
        near = find_neighbors(entities, edges, list(dict.fromkeys(level)), per_node).select("src", "dst", "rank", "rel_ord")
        near = edges.withColumnRenamed("ord", "rel_ord").join(F.broadcast(near), "rel_ord").collect()
        lists: dict[str, list] = {}
        for r in sorted(near, key=lambda r: r["rank"]):
            lists.setdefault(r["src"], []).append(r)
        following: list[str] = []
        for name in level:
            if len(found) >= max_entities:
                break
            for r in lists.get(name, []):
                if len(found) >= max_entities:
                    break
                value = tuple(r[c] for c in columns)
                key = tuple(map(_hashable, value))
                if key not in values:
                    values.add(key)
                    kept.append((len(kept), *value))
                if r["dst"] not in visited:
                    visited.add(r["dst"])
                    found.append((depth + 1, r["dst"]))
                    tags.append(f"depth{depth + 1}:{r['dst']}")
                    following.append(r["dst"])
        if len(found) >= max_entities:
            break
        if not following:
            break
        level, depth = following, depth + 1
    nodes = spark.createDataFrame([(i, d, n, t) for i, ((d, n), t) in enumerate(zip(found, tags, strict=True))], "ord long, depth int, name string, tag string")
    schema = StructType([StructField("ord", LongType()), *(edges.schema[c] for c in columns)])
    return nodes, spark.createDataFrame(kept, schema), depth


def simple_paths(entities: DataFrame, edges: DataFrame, start: str, end: str, max_length: int = 4) -> DataFrame:
    """`path`: all simple paths of up to max_length vertices; parallel edges give a path each."""
    spark = entities.sparkSession
    ends = {r.name for r in entities.filter(F.col("name").isin([start, end])).select("name").distinct().collect()}
    if not {start, end} <= ends:
        return spark.createDataFrame([], "path array<string>")
    if start == end:
        return spark.createDataFrame([([start],)], "path array<string>")
    step = adjacency(edges).filter("src <> dst").select("src", "dst")
    paths = spark.createDataFrame([([start], start)], "path array<string>, at string")
    done = []
    for _ in range(max_length - 1):
        paths = paths.join(step, F.col("at") == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        done.append(paths.filter(F.col("at") == end))
        paths = paths.filter(F.col("at") != end)
    out = done[0] if done else paths
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("path")


def degree_centrality(entities: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """name, score of the given names (name, ord) that are entities with edges, best first by (score desc, ord); names may repeat."""
    score = adjacency(edges).groupBy(F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("score"))
    return names.join(score, "name").join(entities.select("name").distinct(), "name", "left_semi").select("name", "score", "ord")


def betweenness(entities: DataFrame, edges: DataFrame, names: list[str]) -> DataFrame:
    """name, score: for each pair of the first ten names without a direct edge, the first common neighbour of the pair gets one."""
    first = list(names[:10])
    spark = entities.sparkSession
    pairs = [(i * 10 + j, a, b) for i, a in enumerate(first) for j, b in enumerate(first) if i < j and a != b]
    known = entities.filter(F.col("name").isin(first)).select("name").distinct()
    pairs = spark.createDataFrame(pairs, "pair int, a string, b string").join(known.withColumnRenamed("name", "a"), "a", "left_semi").join(known.withColumnRenamed("name", "b"), "b", "left_semi")
    step = adjacency_of(edges, first).select("src", "dst", "rel_ord", "dir")
    direct = step.filter(F.col("dst").isin(first)).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    pairs = pairs.join(direct, ["a", "b"], "left_anti")  # 45 rows at most
    # edges meet by their far ends, so that no name's edges have to fit a task
    ends = step.select(F.col("src").alias("b"), "dst").distinct()
    met = step.withColumnRenamed("src", "a").join(ends, "dst").filter("a <> b and dst <> a and dst <> b")
    one = met.join(F.broadcast(pairs), ["a", "b"]).groupBy("pair").agg(F.min_by("dst", F.struct("rel_ord", "dir")).alias("name"))
    found = entities.select("name").join(F.broadcast(one.select("name").distinct()), "name", "left_semi").distinct()
    return one.join(found, "name", "left_semi").groupBy("name").agg(F.count(F.lit(1)).cast("double").alias("score"))


def expand(entities: DataFrame, edges: DataFrame, name: str, strategy: str = "balanced", max_entities: int = 15) -> tuple[DataFrame, DataFrame]:
    """The entity and its chosen neighbours (ord, name), and the edge of each neighbour (ord, ...)."""
    near = find_neighbors(entities, edges, [name], 20)
    if strategy == "diverse_types":
        near = near.withColumn("k", F.row_number().over(W.partitionBy("dst_type").orderBy("rank"))).filter("k <= 3").drop("k")
    near = near.orderBy("rank").limit(max(0, max_entities - 1)).withColumn("ord", F.row_number().over(W.orderBy("rank")))  # 20 rows at most
    own = entities.filter(F.col("name") == name).select(F.lit(0).alias("ord"), "name").limit(1)
    near = near.join(F.broadcast(own.select(F.col("name").alias("src"))), "src", "left_semi")
    return own.unionByName(near.select("ord", F.col("dst").alias("name"))), near.select("ord", "src", "dst", "relationship_type", "confidence", "rel_ord")


def entity_clusters(edges: DataFrame, names: DataFrame) -> DataFrame:
    """name, cluster: components of the graph that the given names (name, ord) induce; a cluster is named by its least ord.

    Labels spread along edges and then along labels, so long paths take few rounds.
    """
    own = names.groupBy("name").agg(F.min("ord").alias("ord"))
    id_ = lambda x, y: own.select(F.col("name").alias(x), F.col("ord").alias(y))
    links = edges.join(id_("source_entity", "a"), "source_entity").join(id_("target_entity", "b"), "target_entity").select("a", "b").filter("a <> b").distinct()
    links = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(own.select(F.col("ord").alias("id"), F.col("ord").alias("label")))
    while True:
        near = links.join(state, links.b == state.id).groupBy("a").agg(F.min("label").alias("m"))
        spread = state.join(near, state.id == near.a, "left").select("id", "label", F.least("label", F.coalesce("m", "label")).alias("new"))
        jump = spread.select(F.col("id").alias("new"), F.col("new").alias("further"))
        after = cut(spread.join(jump, "new").select("id", "label", F.least("new", "further").alias("new")))
        state_new = after.select("id", F.col("new").alias("label"))
        if after.filter("label <> new").isEmpty():
            break
        state = state_new
    return own.join(state, F.col("ord") == F.col("id")).select("name", "ord", F.col("label").alias("cluster"))


def relationship_summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship_type").agg(F.count(F.lit(1)).alias("n"))
