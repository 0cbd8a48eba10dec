"""Entity resolution: blocked name similarity, greedy leaders, merging of groups.

Similarity depends on the normal name, so equal normal names of a type are one
node first. Candidate pairs come from equi-joins that lose none: names that share
a word among their rarest ones (prefix filter of Jaccard), and names one of which
holds the rarest three characters of the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from braidwork.functions.text import cosine, norm_similarity, normalize_entity_name, normalize_name, strip, words
from braidwork.runtime import cut


def nodes(entities: DataFrame) -> DataFrame:
    """block (the type in upper case), norm, ord (the first entity's)."""
    rows = entities.select(F.upper("type").alias("block"), normalize_name(F.col("name")).alias("norm"), "ord")
    return rows.groupBy("block", "norm").agg(F.min("ord").alias("ord"))


def similar_pairs(entities: DataFrame, threshold: float = 0.8) -> DataFrame:
    """block, a, b, similarity of all pairs of nodes with similarity >= threshold; a and b are their ords, a < b."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    rows = cut(nodes(entities))
    found = []
    if threshold <= 0.9:  # one name holds the other
        n = F.length("norm")
        # a short name is looked for by its rarest three characters, or by itself
        grams = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(F.col("norm"), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
        every = rows.select("block", "norm", "ord", F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3), F.array(F.lit(""))))).alias("gram"))
        count = every.groupBy("block", "gram").agg(F.count(F.lit(1)).alias("df"))
        own = every.filter(F.length("gram") == F.least(n, F.lit(3))).join(count, ["block", "gram"])
        rarest = own.groupBy("block", "norm", "ord").agg(F.min(F.struct("df", "gram")).alias("r")).select("block", F.col("norm").alias("short"), F.col("ord").alias("s"), F.col("r.gram").alias("gram"))
        held = rarest.join(every.select("block", "gram", F.col("norm").alias("long"), F.col("ord").alias("l")), ["block", "gram"]).filter((F.col("s") != F.col("l")) & F.col("long").contains(F.col("short")))
        found.append(held.select("block", F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b")))
    each = rows.select("block", "norm", "ord", words(F.col("norm")).alias("w")).select("block", "ord", F.size("w").alias("n"), F.explode("w").alias("word"))
    df = each.groupBy("block", "word").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(W.partitionBy("block", "ord").orderBy("df", "word"))
    prefix = each.join(df, ["block", "word"]).withColumn("k", rank).filter(F.col("k") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)
    left, right = (prefix.select("block", "word", F.col("ord").alias(x)) for x in "ab")
    found.append(left.join(right, ["block", "word"]).filter("a < b").select("block", "a", "b"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    name = lambda x: rows.select("block", F.col("ord").alias(x), F.col("norm").alias("norm_" + x))
    pairs = pairs.distinct().join(name("a"), ["block", "a"]).join(name("b"), ["block", "b"])
    return pairs.withColumn("similarity", norm_similarity(F.col("norm_a"), F.col("norm_b"))).filter(F.col("similarity") >= threshold - 1e-12).select("block", "a", "b", "norm_a", "norm_b", "similarity")


def leaders(all_nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """ord, leader of every node.

    In order, a free node leads and takes all free later nodes that are similar
    to it. So a node leads if and only if no earlier similar node does, and else
    belongs to the earliest that does. Rounds decide all nodes whose earlier
    neighbours are decided; each round is one join, in any number of tasks.
    """
    edges = cut(pairs.select("a", "b").distinct())
    state = cut(all_nodes.select("ord").join(edges.select(F.col("b").alias("ord")).distinct(), "ord", "left_semi").withColumn("leads", F.lit(None).cast("boolean")))
    free = cut(all_nodes.select("ord").join(state.select("ord"), "ord", "left_anti"))
    while not state.filter("leads is null").isEmpty():
        known = state.unionByName(free.withColumn("leads", F.lit(True))).select(F.col("ord").alias("a"), "leads")
        around = edges.join(known, "a").groupBy(F.col("b").alias("ord")).agg(F.max(F.coalesce("leads", F.lit(False))).alias("some"), F.min(F.col("leads").isNotNull()).alias("all"))
        state = cut(state.join(around, "ord").select("ord", F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.col("some"), False).when(F.col("all"), True).alias("leads")))
    lead = state.filter("leads").select("ord").unionByName(free)
    followers = edges.join(lead.select(F.col("ord").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("ord")).agg(F.min("a").alias("leader"))
    followers = followers.join(state.filter("not leads").select("ord"), "ord", "left_semi")
    return followers.unionByName(lead.select("ord", F.col("ord").alias("leader")))


def entity_pairs(entities: DataFrame, threshold: float = 0.8, name_weight: float = 0.7) -> DataFrame:
    """block, a, b, similarity of all pairs of entities whose weighted name and embedding similarity is >= threshold.

    A cosine is 1 at most, so the name must reach (threshold - 0.3) / 0.7; that
    bound's pairs, and those of equal normal names, are the candidates.
    """
    least = (threshold - (1 - name_weight)) / name_weight
    if least <= 0:
        raise ValueError("threshold must be above the embedding's weight")
    rows = entities.select(F.upper("type").alias("block"), normalize_name(F.col("name")).alias("norm"), "ord", "embedding")
    one = lambda x: rows.select("block", F.col("norm").alias("norm_" + x), F.col("ord").alias(x), F.col("embedding").alias("v" + x))
    pairs = similar_pairs(entities, min(1.0, least)).select("block", "norm_a", "norm_b", F.col("similarity").alias("name"))
    both = pairs.unionByName(pairs.select("block", F.col("norm_b").alias("norm_a"), F.col("norm_a").alias("norm_b"), "name"))
    same = nodes(entities).select("block", F.col("norm").alias("norm_a"), F.col("norm").alias("norm_b"), F.lit(1.0).alias("name"))
    found = both.unionByName(same).join(one("a"), ["block", "norm_a"]).join(one("b"), ["block", "norm_b"]).filter("a < b")
    total = name_weight * F.col("name") + (1 - name_weight) * cosine(F.col("va"), F.col("vb"))
    return found.select("block", "a", "b", total.alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)


def clusters(entities: DataFrame, threshold: float = 0.8, embeddings: bool = False) -> DataFrame:
    """ord, leader of every entity: the leader is the ord of its cluster's first entity."""
    if embeddings:
        return leaders(entities.select("ord"), entity_pairs(entities, threshold))
    # each name once, by an exchange that also spreads them: normalising is the dear part
    names = cut(entities.groupBy("type", "name").agg(F.min("ord").alias("ord")))
    first = cut(nodes(names))
    led = leaders(first.select("ord"), similar_pairs(names, threshold))
    key = names.select("type", "name", F.upper("type").alias("block"), normalize_name(F.col("name")).alias("norm"))
    found = key.join(first.withColumnRenamed("ord", "node"), ["block", "norm"]).join(led.withColumnRenamed("ord", "node"), "node").select("type", "name", "leader")
    return entities.select("type", "name", "ord").join(found, ["type", "name"]).select("ord", "leader")


def _ordered(value: str, key: str = "ord"):
    """All values in order of key, as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])


def merge_entities(entities: DataFrame, threshold: float = 0.8, embeddings: bool = False) -> DataFrame:
    """name, type, description, source_chunks, confidence, properties, ord: one row a cluster, in order of (block_ord, ord)."""
    rows = entities.join(clusters(entities, threshold, embeddings), "ord")
    first = F.min(F.struct((-F.length(strip(F.col("name")))).alias("n"), "ord", "name"))
    merged = rows.groupBy("leader").agg(
        F.count(F.lit(1)).alias("size"), first["name"].alias("name"), F.min_by("type", "ord").alias("type"),
        F.array_join(F.array_distinct(F.filter(F.transform(_ordered("description"), strip), lambda d: d != "")), " | ").alias("description"),
        F.min_by("description", "ord").alias("own"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_chunks")))).alias("source_chunks"),
        F.avg("confidence").alias("confidence"), F.min_by("properties", "ord").alias("properties"),
    )
    merged = merged.withColumn("description", F.when(F.col("size") == 1, F.col("own")).otherwise(F.col("description")))
    merged = merged.withColumn("properties", F.when(F.col("size") == 1, F.col("properties")))
    order = entities.groupBy(F.upper("type").alias("block")).agg(F.min("ord").alias("block_ord"))
    return merged.join(order, F.upper("type") == F.col("block")).select("name", "type", "description", "source_chunks", "confidence", "properties", F.col("leader").alias("ord"), "block_ord", "size")


def merge_relationships(relationships: DataFrame) -> DataFrame:
    """One row for each (normal source, normal target, type), in order of ord."""
    keys = [normalize_entity_name(F.col("source_entity")).alias("k1"), normalize_entity_name(F.col("target_entity")).alias("k2"), F.col("relationship_type").alias("k3")]
    # dealt out first: most keys are of few rows, which collecting before the exchange would only sort and copy
    rows = relationships.select(*keys, "ord", "source_entity", "target_entity", "description", "source_chunks", "confidence").repartition("k1", "k2", "k3")
    merged = rows.groupBy("k1", "k2", "k3").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct("ord", "source_entity", "target_entity", "description")).alias("first"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("description") != "", F.col("description")))), "; ").alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_chunks")))).alias("source_chunks"), F.avg("confidence").alias("confidence"),
    )
    description = F.when(F.col("size") == 1, F.col("first.description")).otherwise(F.col("all")).alias("description")
    return merged.select("first.source_entity", "first.target_entity", F.col("k3").alias("relationship_type"), description, "source_chunks", "confidence", "first.ord", "size")
