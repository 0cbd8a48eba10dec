"""The whole build: load, chunk, extract, merge, store, and prompts for questions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from braidwork.functions.text import COMPLETION_DELIMITER, ENTITY_TYPES, RECORD_DELIMITER, TUPLE_DELIMITER, entity_text
from braidwork.operators import chunk, extract, prompt, resolve
from braidwork.operators.retrieve import HybridRetriever, create_retriever
from braidwork.runtime import table_path, written
from braidwork.sources import documents, samples, store

#: Places of an order: chunks of a document, and records of a response.
CHUNKS, RECORDS = 100_000, 10_000


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 800
    chunk_overlap: int = 150
    max_entities_per_chunk: int = 15
    entity_types: tuple[str, ...] = ENTITY_TYPES
    name_threshold: float = 0.8

    @classmethod
    def of(cls, config: dict) -> Settings:
        """From a configuration as load_config reads it; what it does not say stays."""
        processing, extraction = config.get("processing") or {}, config.get("extraction") or {}
        given = {k: v for part in (processing, extraction) for k, v in part.items() if k in cls.__dataclass_fields__ and v is not None}
        if "entity_types" in given:
            given["entity_types"] = tuple(given["entity_types"])
        return cls(**given)

    def statistics(self) -> dict:
        """What the build would do, for logs: its settings, formats and delimiters."""
        return asdict(self) | {"supported_formats": [f".{k}" for k in documents.KINDS], "tuple_delimiter": TUPLE_DELIMITER, "record_delimiter": RECORD_DELIMITER, "completion_delimiter": COMPLETION_DELIMITER}


@dataclass
class Build:
    chunks: DataFrame
    entities: DataFrame
    relationships: DataFrame
    retriever: HybridRetriever
    counts: dict[str, int]


def build(spark: SparkSession, source: str | DataFrame | None, target: str, generate: Callable[[list[str]], list[str]], encode: Callable[[list[str]], list], config: dict | None = None, queries: Iterable[str] = ()) -> Build:
    """Builds a graph under `target` and writes a prompt for each query.

    source: a path, a table of documents (id, content, ord from 0 on), or None for
    the built-in ones. generate and encode are the models. Responses are written
    once and read from there, as a model may answer otherwise the next time.
    """
    own = Settings.of(config or {})
    if source is None:
        docs = samples.documents(spark)
    elif isinstance(source, str):
        docs, _ = documents.load_documents(spark, source)
        order = docs.select("source_path", (F.row_number().over(W.orderBy("source_path")) - 1).cast("long").alias("ord"))  # names alone, which the driver has listed
        docs = docs.drop("ord").join(order, "source_path")
    else:
        docs = source
    chunks = chunk.chunk_documents(docs, own.chunk_size, own.chunk_overlap)
    chunks = chunks.withColumn("ord", F.col("doc_ord") * CHUNKS + F.col("chunk_index"))
    chunks = written(extract.embed(chunks, "text", encode), "chunks")
    responses = written(extract.respond(chunks, generate, own.entity_types, own.max_entities_per_chunk), "responses")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("ord", F.col("ord") * RECORDS + F.col("pos")).drop("pos").withColumn("properties", F.lit(None).cast("map<string,string>"))

    found = written(placed(extract.parse_entities(responses)), "found")
    links = written(placed(extract.parse_relationships(responses)), "links")
    entities = resolve.merge_entities(found, own.name_threshold).withColumn("properties", F.lit(None).cast("map<string,string>"))
    entities = written(extract.embed(entities.withColumn("__text", entity_text(F.col("name"), F.col("description"))), "__text", encode).drop("__text"), "entities")
    relationships = written(resolve.merge_relationships(links).withColumn("properties", F.lit(None).cast("map<string,string>")), "relationships")
    graph_store = store.GraphStore(spark, target)
    graph_store.save(entities, relationships, "graphs/graph")
    retriever = create_retriever(entities, relationships, lambda q: encode([q])[0], chunks)
    n_prompts = 0
    for q in queries:
        r = retriever.retrieve(q, include_chunks=True)
        text = prompt.augmented_prompt(q, r.entities.select("ord", "name", "type", "description"), r.relationships, r.chunks).first()[0]
        graph_store.save_prompt(q, text)
        n_prompts += 1
    tables = {"docs": docs, "chunks": chunks, "entities_found": found, "relationships_found": links, "entities": entities, "relationships": relationships}
    return Build(chunks, entities, relationships, retriever, {name: df.count() for name, df in tables.items()} | {"prompts": n_prompts})


def build_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The build over all documents, with stubs for models; its counts."""
    import re

    from braidwork.plans import fixtures as X

    def generate(prompts):
        out = []
        for p in prompts:
            first = [re.sub("[^a-z0-9]", "", w.lower()) for w in p.split("## Text to Process:\n")[1].split("\n\n## Extracted")[0].split()[:2]]
            records = [f"({w}<|>t{len(w)}<|>word {k})" for k, w in enumerate(first) if w]
            if len(records) == 2:
                records.append(f"({first[0]}<|>next<|>{first[1]}<|>follows)")
            out.append("##".join([*records, "<|COMPLETE|>"]))
        return out

    def encode(texts):
        return [[float(t.count(c)) for c in "aeiou"] for t in texts]

    docs = X.fixture(spark, sf_dir, X.DOCS).select("id", "content", "ord")
    made = build(spark, docs, table_path(spark, "build"), generate, encode, {"processing": {"chunk_size": 800, "chunk_overlap": 150}}, ["what follows the first word"])
    return spark.createDataFrame([tuple(made.counts.values())], ", ".join(f"{c} long" for c in made.counts))
