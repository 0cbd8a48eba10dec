"""The graph store: one JSON file for small graphs, two Parquet tables for others.

Files are written and read through Spark's file systems, so the base path may be
any that Spark knows.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.schemas import ENTITY, RELATIONSHIP

THRESHOLD = 1000


def _schema(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)


def to_serializable(value):
    """Rows, lists and objects as plain values."""
    if isinstance(value, T.Row):
        return {k: to_serializable(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [to_serializable(v) for v in value]
    if isinstance(value, dict):
        return {k: to_serializable(v) for k, v in value.items()}
    return {k: to_serializable(v) for k, v in vars(value).items()} if hasattr(value, "__dict__") else value


class GraphStore:
    def __init__(self, spark: SparkSession, base: str, threshold: int = THRESHOLD):
        self.spark, self.base, self.threshold = spark, base.rstrip("/"), threshold

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, system = self._path(name)
        return system.exists(path)

    def save(self, entities: DataFrame, relationships: DataFrame, name: str) -> str:
        """Writes JSON below the threshold of rows in all, else Parquet; tells which."""
        e, r = entities.select(*_schema(ENTITY).names), relationships.select(*_schema(RELATIONSHIP).names)
        if e.limit(self.threshold).count() + r.limit(self.threshold).count() < self.threshold:
            self.save_json(e, r, name)
            return "json"
        self.save_parquet(e, r, name)
        return "parquet"

    def save_json(self, entities: DataFrame, relationships: DataFrame, name: str) -> None:
        body = {"entities": to_serializable(entities.collect()), "relationships": to_serializable(relationships.collect())}
        self.write_text(f"{name}.json", json.dumps(body, indent=2))

    def write_text(self, name: str, text: str) -> None:
        path, system = self._path(name)
        out = system.create(path, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def write_texts(self, rows: DataFrame) -> int:
        """Writes each row (name, text) as a file under the base, from the executors; tells how many. A task that runs twice writes the same."""
        base = self.base

        def write(batches):
            from pyarrow import fs

            system, top = fs.FileSystem.from_uri(base)
            for batch in batches:
                for name, text in zip(batch["name"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    system.create_dir(f"{top}/{name}".rpartition("/")[0], recursive=True)
                    with system.open_output_stream(f"{top}/{name}") as out:
                        out.write((text or "").encode())
                yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

        return rows.select("name", "text").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def save_parquet(self, entities: DataFrame, relationships: DataFrame, name: str) -> None:
        """An empty side is not written."""
        for rows, part in ((entities, "entities"), (relationships, "relationships")):
            if not rows.isEmpty():
                rows.write.mode("overwrite").parquet(f"{self.base}/{name}_{part}.parquet")

    def save_prompt(self, query: str, prompt: str) -> str:
        """One JSON file a query, named by its first twenty characters."""
        name = f"query_{query[:20].replace(' ', '_')}.json"
        self.write_text(name, json.dumps({"query": query, "prompt": prompt}, indent=2))
        return name

    def load(self, name: str) -> tuple[DataFrame, DataFrame]:
        """JSON if there is any, else Parquet, else two empty tables."""
        if self.exists(f"{name}.json"):
            return load_json(self.spark, f"{self.base}/{name}.json")
        out = []
        for part, spec in (("entities", ENTITY), ("relationships", RELATIONSHIP)):
            here = self.exists(f"{name}_{part}.parquet")
            out.append(self.spark.read.schema(_schema(spec)).parquet(f"{self.base}/{name}_{part}.parquet") if here else self.spark.createDataFrame([], _schema(spec)))
        return out[0], out[1]


def load_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of one JSON file, with their places as ord."""
    e, r = _schema(ENTITY), _schema(RELATIONSHIP)
    schema = T.StructType([T.StructField("entities", T.ArrayType(e)), T.StructField("relationships", T.ArrayType(r))])
    whole = spark.read.schema(schema).json(path, multiLine=True)
    part = lambda c: whole.select(F.posexplode(c).alias("ord", "x")).select("x.*", F.col("ord").cast("long").alias("ord"))
    return part("entities"), part("relationships")
