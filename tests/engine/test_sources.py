import json
import zipfile

import pytest

from braidwork.operators import prompt
from braidwork.schemas import ENTITY, RELATIONSHIP
from braidwork.sources import documents, store
from braidwork.streaming import ingest


def docx(path, paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")


def test_load_documents(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "a.txt").write_text(" one\n\ttwo ")
    (tmp_path / "sub dir" / "b c.TXT").write_text("three")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "skip.csv").write_text("x")
    docx(tmp_path / "w.docx", ["four", "five"])
    good, bad = documents.load_documents(spark, str(tmp_path))
    assert sorted((r.id, r.content) for r in good.collect()) == [("a", "one two"), ("b c", "three"), ("w", "four five")]
    assert [r.source_path.rsplit("/", 1)[1] for r in bad.collect()] == ["bad.txt"]
    assert documents.load_document(spark, str(tmp_path / "a.txt")).first().content == "one two"
    with pytest.raises(FileNotFoundError):
        documents.load_document(spark, str(tmp_path / "none.txt"))
    with pytest.raises(ValueError):
        documents.load_document(spark, str(tmp_path / "skip.csv"))
    custom = documents.load_documents(spark, str(tmp_path), {"txt": lambda data: "read otherwise"})[0]
    assert "read otherwise" in {r.content for r in custom.collect()}


def test_load_empty_files(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    for name, text in (("a.txt", ""), ("sub dir/1+1 50% ä.txt", ""), ("sub dir/2+1 50%41.txt", "full"), ("skip.csv", ""), ("w.docx", "")):
        (tmp_path / name).write_text(text)
    good, bad = documents.load_documents(spark, str(tmp_path))
    assert sorted((r.id, r.content) for r in good.collect()) == [("1+1 50% ä", ""), ("2+1 50%41", "full"), ("a", "")]
    assert [r.source_path.rsplit("/", 1)[1] for r in bad.collect()] == ["w.docx"]
    assert documents.load_document(spark, str(tmp_path / "a.txt")).first().content == ""


def test_config(tmp_path):
    assert documents.load_config(str(tmp_path / "none.yaml")) == {}
    (tmp_path / "c.yaml").write_text("processing:\n  chunk_size: 800\n")
    assert documents.load_config(str(tmp_path / "c.yaml")) == {"processing": {"chunk_size": 800}}


def test_store(spark, tmp_path):
    e = spark.createDataFrame([("a", "T", "d", ["c1", "c2"], 1.0, None), ("b", "T", None, [], 0.5, {"k": "v"})], ENTITY)
    r = spark.createDataFrame([("a", "b", "R", "d", ["c1"], 1.0, None)], RELATIONSHIP)
    s = store.GraphStore(spark, str(tmp_path), threshold=4)
    assert s.save(e, r, "graphs/g") == "json"
    body = json.loads((tmp_path / "graphs" / "g.json").read_text())
    assert body["entities"][0]["properties"] is None and len(body["relationships"]) == 1
    assert store.GraphStore(spark, str(tmp_path), threshold=3).save(e, r.limit(0), "graphs/g") == "json"
    assert store.GraphStore(spark, str(tmp_path), threshold=2).save(e, r.limit(0), "graphs/p") == "parquet"
    a, b = s.load("graphs/p")
    assert sorted(x.name for x in a.collect()) == ["a", "b"] and b.count() == 0
    a, b = s.load("graphs/g")
    assert [tuple(x)[:4] for x in a.orderBy("ord").collect()] == [("a", "T", "d", ["c1", "c2"]), ("b", "T", None, [])]
    a, b = s.load("missing")
    assert a.count() == 0 and b.count() == 0
    assert s.save_prompt("What is it and who found it?", "p") == "query_What_is_it_and_who_f.json"


def test_prompts(spark):
    e = spark.createDataFrame([(0, "a", "T", "word " * 60), (1, "b", "T", None)], "ord long, name string, type string, description string")
    r = spark.createDataFrame([], "ord long, source_entity string, target_entity string, relationship_type string, description string")
    text = prompt.augmented_prompt(" why? ", e, r).first().prompt
    assert text.startswith("## User Query\nwhy?\n\n## Relevant Entities\n- a (T): word") and "…\n- b (T): N/A\n\n## Instruction\n" in text
    assert "Key Relationships" not in text
    assert prompt.format_context(e.filter("ord = 1"), r).first().context == "Relevant Entities:\n- b (T): N/A"
    assert prompt.format_context(e.limit(0), r).first().context == ""


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "One. Two.", "en", "s", 9), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(str(tmp_path / "in"))
    query = ingest.write_chunks(ingest.stream_chunks(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "at"))
    query.awaitTermination()
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["One. Two."]
