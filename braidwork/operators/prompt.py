"""Result sets' utilities and the texts made of them. All inputs are a retriever's few rows."""

from __future__ import annotations

from textwrap import shorten

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from braidwork.runtime import prepare


def filter_by_type(rows: DataFrame, types: list[str]) -> DataFrame:
    return rows.filter(F.col("type").isin(list(types)))


def first_per(rows: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("__k = 1").drop("__k")


def dedupe_results(rows: DataFrame) -> DataFrame:
    return first_per(rows, "name")


def merge_traversals(parts: list[tuple[DataFrame, DataFrame, int]]) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Entities (first per name), edges (first per source, target and type), all paths (tags) and the greatest depth; `part` and ord give the order."""
    union = lambda k: __import__("functools").reduce(DataFrame.unionByName, [p[k].withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    order = lambda df: df.withColumn("__at", F.struct("part", "ord"))
    nodes, edges = order(union(0)), order(union(1))
    return first_per(nodes, "name", order="__at").drop("__at"), first_per(edges, "source_entity", "target_entity", "relationship_type", order="__at").drop("__at"), nodes.select("part", "ord", "tag"), max(p[2] for p in parts)


def _shorten(c: Column, width: int) -> Column:
    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shorten(t or "", width=width, placeholder="…"))

    return cut(c)


def _given(c: str) -> Column:
    return F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("N/A"))


def _joined(lines: DataFrame, separator: str = "\n") -> DataFrame:
    """One row, `text`; null without lines."""
    every = F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"])
    return lines.agg(F.when(F.count(F.lit(1)) > 0, F.array_join(every, separator)).alias("text"))


def _first(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("ord").limit(n)


def prompt_entities(entities: DataFrame, most: int = 10) -> DataFrame:
    prepare(entities.sparkSession)
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit("): "), _shorten(_given("description"), 120))
    return _joined(_first(entities, most).select("ord", line.alias("line")))


def prompt_relationships(edges: DataFrame, most: int = 15) -> DataFrame:
    prepare(edges.sparkSession)
    line = F.concat(F.lit("- "), "source_entity", F.lit(" --["), "relationship_type", F.lit("]--> "), "target_entity", F.lit(": "), _shorten(F.col("description"), 100))
    return _joined(_first(edges, most).select("ord", line.alias("line")))


def prompt_chunks(chunks: DataFrame, most: int = 3, width: int = 400) -> DataFrame:
    prepare(chunks.sparkSession)
    line = F.concat(F.lit("[Chunk "), "id", F.lit("] "), _shorten(F.col("text"), width))
    return _joined(_first(chunks, most).select("ord", line.alias("line")))


def augmented_prompt(query: str, entities: DataFrame, edges: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """One row, `prompt`; empty sections are left out."""
    sections = [(1, "\n## Relevant Entities\n", prompt_entities(entities)), (2, "\n## Key Relationships\n", prompt_relationships(edges))]
    if chunks is not None:
        sections.append((3, "\n## Supporting Passages\n", prompt_chunks(chunks)))
    spark = entities.sparkSession
    rows = spark.createDataFrame([(0, "## User Query\n" + query.strip()), (4, "\n## Instruction\nUse the entities, relationships and passages above to answer the user query comprehensively.")], "ord int, line string")
    for k, head, text in sections:
        rows = rows.unionByName(text.filter("text is not null").select(F.lit(k).alias("ord"), F.concat(F.lit(head), "text").alias("line")))
    return _joined(rows).withColumnRenamed("text", "prompt")


def format_context(entities: DataFrame, edges: DataFrame, chunks: DataFrame | None = None, most: int = 2000) -> DataFrame:
    """One row, `context`: ten entities, five edges, three chunks, cut at `most` characters."""
    e = _joined(_first(entities, 10).select("ord", F.concat(F.lit("- "), "name", F.lit(" ("), "type", F.lit("): "), _given("description")).alias("line")))
    r = _joined(_first(edges, 5).select("ord", F.concat(F.lit("- "), "source_entity", F.lit(" → "), "relationship_type", F.lit(" → "), "target_entity").alias("line")))
    parts = [(1, "Relevant Entities:\n", e), (2, "\nRelevant Relationships:\n", r)]
    if chunks is not None:
        body = F.when(F.length("text") > 200, F.concat(F.lit("- "), F.substring("text", 1, 200), F.lit("..."))).otherwise(F.concat(F.lit("- "), "text"))
        parts.append((3, "\nRelevant Context:\n", _joined(_first(chunks, 3).select("ord", body.alias("line")))))
    rows = None
    for k, head, text in parts:
        own = text.filter("text is not null").select(F.lit(k).alias("ord"), F.concat(F.lit(head), "text").alias("line"))
        rows = own if rows is None else rows.unionByName(own)
    whole = _joined(rows).select(F.coalesce("text", F.lit("")).alias("text"))
    return whole.select(F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("..."))).otherwise(F.col("text")).alias("context"))
