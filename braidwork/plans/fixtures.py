"""Inputs of the registered queries, derived from the tables by SQL that Spark and DuckDB both run.

{name} stands for a table. Every fixture has a unique `ord`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS = "SELECT concat('d', CAST(doc_id AS STRING)) AS id, source AS title, text AS content, doc_id AS ord FROM {documents}"

MERGE_ENTITIES = """
SELECT CASE WHEN p_partkey % 11 = 0 THEN upper(nm) ELSE nm END AS name, p_brand AS type, p_type AS description,
       concat('p', CAST(p_partkey AS STRING)) AS chunk, CAST(50 + p_partkey % 50 AS DOUBLE) / 100 AS confidence, p_partkey AS ord
FROM (SELECT *, concat(p_name, CASE WHEN p_partkey % 5 = 0 THEN concat(' ', p_type) ELSE '' END, CASE WHEN p_partkey % 7 = 0 THEN ' Inc.' ELSE '' END) AS nm FROM {part}) t"""

MERGE_RELS = """
SELECT concat(CASE l_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'the ' ELSE 'A ' END, s_name) AS source_entity, p_name AS target_entity, l_returnflag AS relationship_type,
       concat('status ', l_linestatus) AS description, concat('o', CAST(l_orderkey AS STRING)) AS chunk, CAST(l_linenumber % 7 AS DOUBLE) / 10 AS confidence,
       CAST(l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS ord
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {part} ON l_partkey = p_partkey"""

GRAPH_ENTITIES = """
SELECT r_name AS name, 'LOCATION' AS type, 'a region' AS description, CAST(r_regionkey AS BIGINT) AS ord FROM {region}
UNION ALL SELECT n_name, 'LOCATION', 'a nation', CAST(n_nationkey + 100 AS BIGINT) FROM {nation}
UNION ALL SELECT s_name, 'ORGANIZATION', 'a supplier', s_suppkey + 1000 FROM {supplier}
UNION ALL SELECT c_name, 'ORGANIZATION', concat('customer in ', c_mktsegment), c_custkey + 1000000 FROM {customer}
UNION ALL SELECT concat('Part#', CAST(p_partkey AS STRING)), 'PRODUCT', p_name, p_partkey + 100000000 FROM {part}"""

GRAPH_RELS = """
SELECT a AS source_entity, b AS target_entity, t AS relationship_type, concat(t, ' edge') AS description, CAST(50 + ord % 50 AS DOUBLE) / 100 AS confidence, ord
FROM (SELECT a, b, t, CAST(k AS BIGINT) * 100000000000000000 + CAST(z AS BIGINT) AS ord FROM (
  SELECT n_name AS a, r_name AS b, 'LOCATED_IN' AS t, 1 AS k, CAST(n_nationkey AS BIGINT) AS z FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
  UNION ALL SELECT s_name, n_name, 'BASED_IN', 2, CAST(s_suppkey AS BIGINT) FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
  UNION ALL SELECT c_name, n_name, 'BASED_IN', 3, CAST(c_custkey AS BIGINT) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT s_name, concat('Part#', CAST(l_partkey AS STRING)), 'SUPPLIES', 4, CAST(l_suppkey AS BIGINT) * 1000000000 + CAST(l_partkey AS BIGINT) FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
  UNION ALL SELECT 'ASIA', 'ASIA', 'SELF', 5, 0 UNION ALL SELECT 'ASIA', 'EUROPE', 'TRADES', 5, 1 UNION ALL SELECT 'ASIA', 'EUROPE', 'TRADES', 5, 2 UNION ALL SELECT 'ASIA', 'ATLANTIS', 'LEGEND', 5, 3
) u) v"""

VEC_ENTITIES = """
SELECT concat('vec_', CAST(vec_id AS STRING)) AS name, concat('L', CAST(label AS STRING)) AS type, concat('item of label ', CAST(label AS STRING)) AS description,
       embedding, concat('d', CAST(vec_id % 40 AS STRING), '_chunk_0') AS chunk, vec_id AS ord FROM {embeddings}"""

VEC_RELS = """
SELECT concat('vec_', CAST(i AS STRING)) AS source_entity, concat('vec_', CAST(j AS STRING)) AS target_entity, t AS relationship_type, concat(t, ' of vec_', CAST(i AS STRING)) AS description,
       CAST(50 + i % 50 AS DOUBLE) / 100 AS confidence, CAST(i * 2 + k AS BIGINT) AS ord
FROM (SELECT vec_id AS i, (vec_id * 7 + 3) % n AS j, 'NEXT' AS t, 0 AS k FROM {embeddings} CROSS JOIN (SELECT count(*) AS n FROM {embeddings}) c1
      UNION ALL SELECT vec_id, (vec_id * 13 + 5) % n, 'SKIP', 1 FROM {embeddings} CROSS JOIN (SELECT count(*) AS n FROM {embeddings}) c2) e"""

#: Chunks of all documents, each with the vector of its number modulo the number of vectors.
VEC_CHUNKS = """
SELECT concat('d', CAST(doc_id AS STRING), '_chunk_0') AS id, concat(text, ' see vec_', CAST(vec_id + 3 AS STRING), ' and vec_', CAST(vec_id + 4 AS STRING), ' there') AS text, embedding, doc_id AS ord
FROM (SELECT doc_id, text, doc_id % (SELECT count(*) FROM {embeddings}) AS v FROM {documents}) d JOIN {embeddings} ON v = vec_id"""

RESPONSES = """
SELECT concat('n', CAST(n_nationkey AS STRING)) AS chunk_id, CAST(n_nationkey AS BIGINT) AS ord,
       concat('(', n_name, '<|> location <|>nation)##(', n_name, '<|>part_of<|>', r_name, '<|> in region )##', CASE WHEN n_nationkey % 3 = 0 THEN '(<|>org<|>d)##(A<|>B)##  (B<|> t <|> )  ##' ELSE '' END, '<|COMPLETE|>') AS response
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 'e1', 101, '' UNION ALL SELECT 'e2', 102, '(A<|>T<|>x ## y)##' UNION ALL SELECT 'e3', 103, '(A<|>T<|>d) <|COMPLETE|>'
UNION ALL SELECT 'e4', 104, '(MIT<|>org<|>)##(A<|>B<|>C<|>D<|>E)##(X<|><|>d)##(p<|>q<|>r<|>s)##()##(' """

#: The same and one for each customer and part.
MANY_RESPONSES = (
    RESPONSES
    + """
UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), 1000 + c_custkey,
       concat('(', c_name, '<|>organization<|>customer of ', c_mktsegment, ')##(', c_name, '<|>lives_in<|>', n_name, '<|>', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'since long' END, ')##', CASE WHEN c_custkey % 5 = 0 THEN '(broken##' ELSE '' END, '<|COMPLETE|>') FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)), 100000000 + p_partkey, concat('(', p_name, '<|> product <|> ', p_type, ' )##(', p_name, '<|>made_by<|>', p_brand, '<|>', p_type, ')') FROM {part}"""
)

QUERY = "which item of label 3 is near vec_0"


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql))


def duck(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def with_chunks(df: DataFrame) -> DataFrame:
    """source_chunks (an array) instead of chunk, and empty properties."""
    return df.withColumn("source_chunks", F.array("chunk")).drop("chunk").withColumn("properties", F.lit(None).cast("map<string,string>"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id = 0").select("embedding").first()
    return list(row[0])
