import json

from braidwork import pipeline
from braidwork.operators import extract, retrieve
from braidwork.sources import samples, store


def generate(prompts):
    return ["(Weston<|>location<|>a town)##(Sall<|>location<|>a port)##(Weston<|>near<|>Sall<|>on the coast)##<|COMPLETE|>" for _ in prompts]


def encode(texts):
    return [[float(len(t)), 1.0] for t in texts]


def test_build(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "b.txt").write_text("Weston is near Sall. " * 60)
    (tmp_path / "texts" / "a.txt").write_text("Sall is near Weston.")
    config = {"processing": {"chunk_size": 300, "chunk_overlap": 30}, "extraction": {"entity_types": ["LOCATION"], "unknown": 1}, "models": None}
    for source, n_docs in ((str(tmp_path / "texts"), 2), (None, len(samples.DOCUMENTS))):
        out = tmp_path / f"out{n_docs}"
        made = pipeline.build(spark, source, f"file://{out}", generate, encode, config, samples.QUESTIONS[:2])
        n = made.counts["chunks"]
        assert made.counts == {"docs": n_docs, "chunks": n, "entities_found": 2 * n, "relationships_found": n, "entities": 2, "relationships": 1, "prompts": 2} and n >= n_docs
        assert sorted(r.name for r in made.entities.collect()) == ["Sall", "Weston"]
        e, r = store.GraphStore(spark, f"file://{out}").load("graphs/graph")
        assert e.count() == 2 and r.count() == 1
        body = json.loads(next(out.glob("query_*.json")).read_text())
        assert body["query"] in samples.QUESTIONS and "Weston" in body["prompt"]


def test_settings():
    own = pipeline.Settings.of({"processing": {"chunk_size": 10, "batch_size": 2}, "extraction": None})
    assert (own.chunk_size, own.chunk_overlap) == (10, 150)
    told = own.statistics()
    assert told["chunk_size"] == 10 and ".txt" in told["supported_formats"] and told["tuple_delimiter"] == "<|>" and told["max_entities_per_chunk"] == 15


def test_stop_sequences():
    call = extract.stopping(lambda ps: [p + " END" for p in ps], ["END", "x"])
    assert call([" a", "b x"]) == ["a", "b"]


def test_a_bad_text_spoils_no_batch(spark):
    def encode_some(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return [[1.0] for _ in texts]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["one", "bad", " ", "two", None])], "i int, text string").coalesce(1)
    got = {r.i: r.embedding for r in extract.embed(rows, "text", encode_some).collect()}
    assert got == {0: [1.0], 1: None, 2: None, 3: [1.0], 4: None}


def test_json_entry_and_timing(spark, tmp_path):
    graph = {"entities": [{"name": "Weston", "type": "LOCATION"}], "relationships": []}
    (tmp_path / "g.json").write_text(json.dumps(graph))
    docs = spark.createDataFrame([("d", "in weston", 0)], "id string, content string, ord long")
    keyword = retrieve.KeywordRetriever.from_json(spark, str(tmp_path / "g.json"), docs)
    assert [r.source for r in keyword.context("what of Weston?").collect()] == [] and keyword.find("what of weston?").count() == 1
    made = retrieve.create_retriever(*pipeline_tables(spark))
    assert made.retrieve("weston", "graph_only").metadata["retrieval_time"] > 0


def pipeline_tables(spark):
    e = spark.createDataFrame([("Weston", "LOCATION", "", 0)], "name string, type string, description string, ord long")
    r = spark.createDataFrame([], "source_entity string, target_entity string, relationship_type string, description string, confidence double, ord long")
    return e, r, None
