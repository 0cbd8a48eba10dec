"""From model responses to typed rows; models are functions that the caller gives."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions.text import COMPLETION_DELIMITER, ENTITY_TYPES, extraction_prompt, strip
from braidwork.runtime import prepare


def stopping(generate: Callable[[list[str]], list[str]], stops: list[str]) -> Callable[[list[str]], list[str]]:
    """generate, with each response stripped and freed of stop sequences at its end, in the given order."""

    def call(prompts: list[str]) -> list[str]:
        out = []
        for response in generate(prompts):
            response = response.strip()
            for stop in stops:
                response = response.removesuffix(stop).strip()
            out.append(response)
        return out

    return call


def respond(chunks: DataFrame, generate: Callable[[list[str]], list[str]], types=ENTITY_TYPES, most: int = 20) -> DataFrame:
    """chunk_id, ord, response and error of each chunk (id, text, ord). A failing batch is tried text by text; errors give "".

    Responses may differ from run to run: persist or write them before they are used twice.
    """
    prepare(chunks.sparkSession)

    def ask(prompts: list[str]) -> list[tuple[str, str | None]]:
        try:
            return [(r, None) for r in generate(prompts)]
        except Exception as error:  # noqa: BLE001  a model's failure is a result, kept in `error`
            return [("", str(error))] if len(prompts) == 1 else [ask([p])[0] for p in prompts]

    @F.pandas_udf("response string, error string")
    def call(prompts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(ask(prompts.tolist()), columns=["response", "error"])

    return chunks.select(F.col("id").alias("chunk_id"), "ord", call(extraction_prompt(F.col("text"), types, most)).alias("r")).select("chunk_id", "ord", "r.*")


def embed(rows: DataFrame, text: str, encode: Callable[[list[str]], list], name: str = "embedding") -> DataFrame:
    """rows with an embedding column; null for blank texts and for those that fail. A failing batch is tried text by text."""
    prepare(rows.sparkSession)

    def ask(texts: list[str]) -> list:
        try:
            return list(encode(texts))
        except Exception:  # noqa: BLE001  a failing model leaves nulls
            return [None] * len(texts) if len(texts) < 2 else [v for t in texts for v in ask([t])]

    @F.pandas_udf("array<float>")
    def call(texts: pd.Series) -> pd.Series:
        out: list = [None] * len(texts)
        some = [i for i, t in enumerate(texts) if t and t.strip()]
        for i, v in zip(some, ask([texts[i].strip() for i in some]) if some else [], strict=True):
            out[i] = None if v is None else [float(x) for x in v]
        return pd.Series(out, dtype=object)

    return rows.withColumn(name, call(F.col(text)))


def _records(responses: DataFrame) -> DataFrame:
    rows = responses.select("chunk_id", "ord", F.posexplode(F.split(F.coalesce("response", F.lit("")), "##")).alias("pos", "record"))
    record = strip(F.col("record"))
    rows = rows.withColumn("record", record).filter((F.col("record") != "") & (F.col("record") != COMPLETION_DELIMITER) & F.col("record").startswith("(") & F.col("record").endswith(")"))
    inner = F.when(F.length("record") < 2, F.lit("")).otherwise(F.col("record").substr(F.lit(2), F.length("record") - 2))
    return rows.select("chunk_id", "ord", "pos", F.transform(F.split(inner, r"<\|>", -1), strip).alias("part"))


def parse_entities(responses: DataFrame) -> DataFrame:
    """name, type, description, source_chunks, confidence; ord and pos give their order."""
    p = F.col("part")
    rows = _records(responses).filter(F.size("part") == 3).filter((F.get(p, 0) != "") & (F.get(p, 1) != ""))
    return rows.select(F.get(p, 0).alias("name"), F.upper(F.get(p, 1)).alias("type"), F.get(p, 2).alias("description"), F.array("chunk_id").alias("source_chunks"), F.lit(1.0).alias("confidence"), "ord", "pos")


def parse_relationships(responses: DataFrame) -> DataFrame:
    """source_entity, target_entity, relationship_type (the second field), description, source_chunks, confidence."""
    p = F.col("part")
    rows = _records(responses).filter(F.size("part") == 4).filter((F.get(p, 0) != "") & (F.get(p, 1) != "") & (F.get(p, 2) != ""))
    return rows.select(F.get(p, 0).alias("source_entity"), F.get(p, 2).alias("target_entity"), F.upper(F.get(p, 1)).alias("relationship_type"), F.get(p, 3).alias("description"), F.array("chunk_id").alias("source_chunks"), F.lit(1.0).alias("confidence"), "ord", "pos")
