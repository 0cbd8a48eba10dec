import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
import corpus_pipeline
from braidwork.llm import packing, quality, token_ids
from tests.llm.test_chosen_path import brute as classes
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_pii import base


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice("river stone tree walk lamp quiet green field water house light paper".split()) + str(rng.randrange(40)) for _ in range(n))
    items = [(i, prose(40)) for i in range(5)]
    rows, labels = [], []
    for i in range(150):
        text = prose(rng.randrange(30, 120))
        kind = i % 10
        if kind == 1:
            text = "### $$$ buy now " * 20 + str(i)
        elif kind == 2:
            text = rows[-2][1] if rng.random() < 0.5 else rows[-2][1] + " more"
        elif kind == 3:
            text = text + " " + items[i % 5][1] + " " + prose(5)
        elif kind == 4:
            text = text + f" write to bob{i}@mail.example.com or +1 (415) 555-{1000 + i}"
        rows.append((i, text))
        labels.append((i, int(kind != 1), 0))
    rows += [(900, None), (901, ""), (902, "alone")]
    at = tmp_path_factory.mktemp("tables")
    write = lambda name, names, kinds, data: pq.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*data, strict=True), kinds, strict=True)], names=names), at / f"{name}.parquet")
    write("documents", ["doc_id", "text", "lang", "source", "n_chars"], [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()], [(i, t, "en", "s", len(t or "")) for i, t in rows])
    write("labels", ["doc_id", "quality", "toxic"], [pa.int64(), pa.int32(), pa.int32()], labels)
    write("benchmark", ["item_id", "text"], [pa.int64(), pa.string()], items)
    return str(at), rows, items


def test_every_stage(spark, folder):
    at, rows, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    own = dict(rows)
    model = quality.train(docs, spark.read.parquet(f"{at}/labels.parquet"))
    score = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    want = [{i: t for i, t in own.items() if score[i] >= 0.5}]
    named = classes(list(want[0].items()))
    want.append({i: t for i, t in want[0].items() if named[i][0] == i})
    leaked = {d for d, *_ in leaks(list(want[1].items()), items)}
    want.append({i: t for i, t in want[1].items() if i not in leaked})
    hidden = {}
    for i, t in want[2].items():
        for span in sorted(base(t), key=lambda s: -int(s.split(":")[1])):
            kind, a, b = span.split(":")
            t = t[: int(a)] + f"[{kind.upper()}]" + t[int(b) :]
        hidden[i] = t
    want.append(hidden)
    assert all(len(a) > len(b) for a, b in zip([own, *want[:2]], want[:3], strict=True)) and hidden != want[2]
    for (name, stage), kept in zip(corpus_pipeline.STAGES, want, strict=False):
        out = stage(spark, docs, at)
        assert out.dtypes == docs.dtypes
        got = {r.doc_id: r.text for r in out.collect()}
        assert got == kept, name
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, at).collect()
    tokens = token_ids.WordTokenizer(token_ids.vocabulary_path())
    flat, ends = tokens.encode(pa.array([t or "" for t in hidden.values()]))
    sizes = {i: int(b - a) + 1 for i, a, b in zip(hidden, ends[:-1], ends[1:], strict=True)}
    assert {i: sum(p.length for p in pieces if p.doc_id == i) for i in hidden} == sizes
    whole = sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in pieces)
    ran = __spark_entry__.queries()["pipeline"](spark, at).collect()
    assert sum(p.length for p in ran) == sum(w[2] for w in whole)
    assert {p.doc_id for p in ran} == set(hidden)
    assert all(p.offset + p.length <= packing.SEQUENCE for p in ran)


def test_empty_table(spark, folder, tmp_path):
    at, *_ = folder
    for name in ("documents", "labels", "benchmark"):
        pq.write_table(pq.read_table(f"{at}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
