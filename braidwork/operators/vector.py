"""Exact vector search: scan, cosine, top k."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from braidwork.functions.text import cosine_to


def _literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def scored(rows: DataFrame, vector, name: str = "similarity") -> DataFrame:
    """rows with the similarity to a query vector, rounded to 6 places so that ties are ties everywhere."""
    own = [float(x) for x in vector]
    return rows.withColumn(name, F.round(cosine_to(F.col("embedding"), _literal(own), len(own), math.sqrt(sum(x * x for x in own))), 6))


def search_entities(entities: DataFrame, vector, top_k: int = 10, least: float = 0.0) -> DataFrame:
    """The top_k entities of similarity `least` or more; a null vector (a blank query) finds none."""
    if vector is None:
        return scored(entities, []).limit(0)
    return scored(entities, vector).filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), "ord").limit(top_k)


def similar_entities(entities: DataFrame, seed: str, vector, top_k: int = 5) -> DataFrame:
    return search_entities(entities.filter(F.col("name") != seed), vector, top_k, -2.0)


def search_chunks(chunks: DataFrame, vector, top_k: int = 5) -> DataFrame:
    """Chunks without an embedding are skipped."""
    return search_entities(chunks.filter(F.col("embedding").isNotNull()), vector, top_k, -2.0)


def search_fallback(entities: DataFrame, chunks: DataFrame, vector, top_k: int = 10) -> DataFrame:
    """Entities of similarity 0.3 or more; if fewer than half of top_k, then also those named in the five best chunks, at 0.5."""
    hits = search_entities(entities, vector, top_k, 0.3).withColumn("source", F.lit("entity"))
    n = hits.count()  # at most top_k rows
    if n >= top_k // 2:
        return hits
    best = F.broadcast(search_chunks(chunks, vector).select(F.lower("text").alias("body")))  # five rows
    named = entities.join(best, F.col("body").contains(F.lower("name")), "left_semi").join(F.broadcast(hits.select("name")), "name", "left_anti")
    first = named.withColumn("k", F.row_number().over(W.partitionBy("name").orderBy("ord"))).filter("k = 1").drop("k")
    more = first.orderBy("ord").limit(top_k - n).withColumns({"similarity": F.lit(0.5), "source": F.lit("text")})
    return hits.unionByName(more.select(hits.columns))


def entity_context(entities: DataFrame, most: int = 2000) -> DataFrame:
    """One row, `context`: blocks of three lines of entities in order of ord, up to the first that would pass `most` characters."""
    block = F.concat(F.lit("Entity: "), "name", F.lit("\nType: "), "type", F.lit("\nDescription: "), F.coalesce(F.when(F.col("description") != "", F.col("description")), F.lit("N/A")), F.lit("\n"))
    # a block has 30 characters at least, so only the first most / 30 + 1 rows can matter
    rows = entities.select("ord", block.alias("block")).orderBy("ord").limit(most // 30 + 1)
    rows = rows.withColumn("total", F.sum(F.length("block")).over(W.orderBy("ord").rowsBetween(W.unboundedPreceding, 0))).filter(F.col("total") <= most)
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]), "\n").alias("context"))
