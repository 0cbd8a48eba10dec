import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from braidwork.functions import text as T
from braidwork.operators import chunk, extract


def one(spark, value, f, name="v"):
    return spark.createDataFrame([(value,)], f"{name} string").select(f(F.col(name))).first()[0]


def test_clean_text(spark):
    assert one(spark, " a b\n\n é\x07c\x1c ", T.clean_text) == "a b c"
    assert one(spark, None, T.clean_text) == ""


def test_normalize_name(spark):
    cases = {"Acme Inc.": "acme", "Acme Corp Inc": "acme", "Acme Inc Corp": "acme inc", "  The U.S. Co. ": "the u.s.", "zoé-2½": "zoé2½", "Inc": "inc", "": ""}
    got = {r.v: r.n for r in spark.createDataFrame([(k,) for k in cases], "v string").select("v", T.normalize_name(F.col("v")).alias("n")).collect()}
    assert got == cases


def test_name_similarity(spark):
    cases = [("Acme Inc", "ACME", 1.0), ("acme labs", "acme", 0.9), ("a b c", "b c d", 0.5), ("", "x", 0.9), ("x", "y", 0.0)]
    rows = spark.createDataFrame(cases, "a string, b string, want double")
    assert all(abs(r.got - r.want) < 1e-9 for r in rows.select("want", T.name_similarity(F.col("a"), F.col("b")).alias("got")).collect())


def test_entity_name(spark):
    assert one(spark, "  The  A an  Apple ", T.normalize_entity_name) == "apple"
    assert one(spark, "a the x", T.normalize_entity_name) == "the x"


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0], [1.0, 2.0], 0.0), ([0.0], [1.0], 0.0), (None, [1.0], 0.0), ([1.0], [-1.0], -1.0)], "a array<float>, b array<float>, want double")
    got = rows.select("want", T.cosine(F.col("a"), F.col("b")).alias("c"), T.clamped_cosine(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.c == r.want and r.d == max(0, r.want) for r in got)


def chunks(text, size, overlap):
    """A plain statement of the rule."""
    out, s = [], 0
    while s < len(text) and text.strip():
        e = s + size
        if e < len(text):
            ends = [m.end() for m in re.finditer(r"[.\n]", text[s:e])]
            if ends and ends[-1] > 1:
                e = s + ends[-1]
        if text[s:e].strip():
            out.append((s, e, text[s:e].strip()))
        s = e - overlap if e - overlap > s else e
    return out


def test_chunks():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("ab. \n") for _ in range(rng.randrange(60)))
        size = rng.randrange(2, 20)
        overlap = rng.randrange(size)
        assert [s[1:] for s in chunk.spans(text, size, overlap)] == chunks(text, size, overlap)


def test_chunks_come_in_small_batches():
    texts = [None, "", "x. " * 400_000, *("Some words. " * 300 for _ in range(2000)), " "]
    batch = pa.RecordBatch.from_pydict({"source_doc_id": [f"d{i}" for i in range(len(texts))], "doc_ord": list(range(len(texts))), "content": texts})
    got = list(chunk._cut([batch], 800, 150))
    assert max(sum(map(len, b.column("text").to_pylist())) for b in got[1:]) <= chunk.BATCH_CHARS + 3600 * 2
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [(f"d{i}", i, *s) for i, t in enumerate(texts) for s in chunk.spans(t or "", 800, 150)]


def test_models_get_small_batches(spark):
    rows = spark.range(3000).coalesce(1).select(F.col("id").cast("string").alias("id"), F.lit("text").alias("text"), F.col("id").alias("ord"))
    assert extract.respond(rows, lambda prompts: [str(len(prompts))] * len(prompts)).agg(F.max(F.col("response").cast("int"))).first()[0] <= 1024
    assert extract.embed(rows, "text", lambda texts: [[float(len(texts))]] * len(texts)).agg(F.max(F.col("embedding")[0])).first()[0] <= 1024


def test_chunks_always_end():
    assert len(chunk.spans("a." + "b" * 5000, 800, 150)) < 50


RESPONSES = {
    "": [],
    "(MIT<|>organization<|>a school)##<|COMPLETE|>": [("MIT", "ORGANIZATION", "a school")],
    "(MIT<|>org<|>)##": [("MIT", "ORG", "")],
    "(<|>org<|>d)##(MIT<|><|>d)##": [],
    "(A<|>B)##(A<|>B<|>C<|>D<|>E)##": [],
    "(A<|>T<|>x ## y)##": [],
    "(A<|>T<|>d)\n<|COMPLETE|>": [],
    "  (A<|> t <|> d )  ##": [("A", "T", "d")],
}


def test_parse(spark):
    rows = spark.createDataFrame([(f"c{i}", i, r) for i, r in enumerate(RESPONSES)] + [("n", 99, None)], "chunk_id string, ord long, response string")
    got = {}
    for r in extract.parse_entities(rows).collect():
        got.setdefault(r.ord, []).append((r.name, r.type, r.description))
    assert got == {i: v for i, v in enumerate(RESPONSES.values()) if v}
    rel = spark.createDataFrame([("c", 1, "(MIT<|>produces<|>startups<|>d)##(A<|>r<|><|>d)##")], "chunk_id string, ord long, response string")
    assert [(r.source_entity, r.relationship_type, r.target_entity) for r in extract.parse_relationships(rel).collect()] == [("MIT", "PRODUCES", "startups")]


def test_failing_model(spark):
    def generate(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return ["(X<|>t<|>d)##"] * len(prompts)

    rows = spark.createDataFrame([("1", "good", 1), ("2", "bad", 2)], "id string, text string, ord long")
    got = {r.chunk_id: (r.response, r.error) for r in extract.respond(rows, generate).collect()}
    assert got == {"1": ("(X<|>t<|>d)##", None), "2": ("", "no")}
    vectors = extract.embed(rows.unionByName(spark.createDataFrame([("3", " ", 3)], rows.schema)), "text", lambda t: [[1.0, 2.0]] * len(t)).collect()
    assert [r.embedding for r in sorted(vectors, key=lambda r: r.ord)] == [[1.0, 2.0], [1.0, 2.0], None]
