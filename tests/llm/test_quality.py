import math
import random

import numpy as np
import pytest

from braidwork.llm import quality


def corpus(n, seed):
    rng = random.Random(seed)
    good, bad = "river stone tree walk lamp quiet".split(), "buy cheap ### $$$ click now".split()
    for i in range(n):
        y = rng.random() < 0.7
        yield i, " ".join(rng.choice(good if y == (rng.random() < 0.85) else bad) for _ in range(rng.randrange(8, 60))), int(y)


def test_held_out_accuracy(spark, docs):
    rows = list(corpus(600, 1))
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows if i % 3], "doc_id long, quality int, toxic int")
    df = docs([(i, t) for i, t, _ in rows])
    got = {r.doc_id: r.score for r in quality.score(df, quality.train(df, labels)).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i % 3 == 0]
    assert np.mean(right) > 0.95


def test_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a"), (4, "w" * 100_000), (5, " \n ")]
    df = docs(rows)
    labels = spark.createDataFrame([(3, 1, 0), (2, 0, 0), (1, None, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(df, quality.train(df, labels)).collect()
    assert len(got) == len(rows)
    empty = {r.score for r in got if r.doc_id in (1, 2, 5)}
    assert len(empty) == 1 and 0 <= empty.pop() <= 1
    assert len({r.score for r in got if r.doc_id == 3}) == 1


@pytest.mark.parametrize("labels,want", [([], 0.5), ([(3, 1, 0)], 1.0), ([(3, 0, 0)], 0.0)])
def test_one_class(spark, docs, labels, want):
    df = docs([(3, "a b"), (4, "c")])
    got = quality.score(df, quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    assert all(r.score == pytest.approx(want, abs=1e-5) for r in got)


def test_fit_matches_plain_restatement():
    """The fit by sparse arrays against one over dictionaries, step by step."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, rng.integers(1, 12))).astype(np.int32) for _ in range(80)]
    labels = np.array([int(7 in r or 9 in r or rng.random() < 0.2) for r in rows])
    pair, bias, slope, offset = quality.fit(rows, labels)
    size, order = 1 << quality.BITS, np.random.default_rng(0).permutation(80)

    def plain(part):
        held = {g: {} for g in (0, 1)}
        for i in part:
            for f in rows[i].tolist():
                held[labels[i]][f] = held[labels[i]].get(f, 0) + 1
        total = {g: size + sum(held[g].values()) for g in (0, 1)}
        ratio = lambda f: math.log((held[1].get(f, 0) + 1) / total[1]) - math.log((held[0].get(f, 0) + 1) / total[0])
        xs = []
        for i in part:
            x = {f: ratio(f) for f in rows[i].tolist()}
            norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
            xs.append({f: v / norm for f, v in x.items()})
        y = [1 if labels[i] else -1 for i in part]
        top = {s: quality.C * len(part) / 2 / y.count(s) for s in (1, -1)}
        w, b, alpha, steps = {}, 0.0, [0.0] * len(part), np.random.default_rng(1)
        for _ in range(quality.ROUNDS):
            for k in steps.permutation(len(part)).tolist():
                g = y[k] * (sum(w.get(f, 0.0) * v for f, v in xs[k].items()) + b) - 1
                new = min(max(alpha[k] - g / (sum(v * v for v in xs[k].values()) + 1), 0.0), top[y[k]])
                for f, v in xs[k].items():
                    w[f] = w.get(f, 0.0) + (new - alpha[k]) * y[k] * v
                b += (new - alpha[k]) * y[k]
                alpha[k] = new
        used = {f: v for f, v in w.items() if v}
        mean = sum(map(abs, used.values())) / len(used)
        return ratio, {f: quality.KEEP * mean + (1 - quality.KEEP) * v for f, v in used.items()}, b

    ratio, w, b = plain(order.tolist())
    assert bias == pytest.approx(b, abs=1e-9)
    assert all(pair[0][f] == pytest.approx(ratio(f), abs=1e-5) and pair[1][f] == pytest.approx(w.get(f, 0.0), abs=1e-5) for f in range(40))
    # the curve is of the rows that the first model has not seen
    ratio, w, b = plain(order[16:].tolist())
    z = []
    for i in order[:16]:
        x = {f: ratio(f) for f in rows[i].tolist()}
        z.append(sum(w.get(f, 0.0) * v for f, v in x.items()) / math.sqrt(sum(v * v for v in x.values())) + b)
    assert (slope, offset) == pytest.approx(quality.logistic(np.array(z), labels[order[:16]] > 0), abs=1e-6)


def test_shapes_are_of_whole_words():
    long = b"a1" * 100
    assert len(np.setdiff1d(quality.features(long + b"X"), quality.features(long + b"!"))) > 0
    assert quality._Shapes()[long + b"X"] != quality._Shapes()[long]


def test_one_id_of_many_texts(spark, docs):
    """A labelled doc_id that names many texts gives max_train of them at most; equal ones count once."""
    df = docs([(1, f"good {i % 40}") for i in range(200)] + [(2, "bad words")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    seen = [(r.doc_id, r.text, r.label) for r in quality.labelled(df, labels, "quality", 10).collect()]
    assert len(seen) == 10 == len(set(seen))


def test_clashing_names(spark, docs):
    df = docs([(1, "a b c"), (2, "d e")]).selectExpr("*", "'mine' as row", "'mine' as __text")
    model = quality.train(df, spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int"))
    assert [(r["row"], r["__text"]) for r in quality.score(df, model, "row", "__text").collect()] == [("mine", "mine")] * 2
    assert quality.keep(df, model, 0.0).columns == df.columns


def test_empty(spark, docs):
    df = docs([])
    assert quality.score(df, quality.train(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_training_is_bounded(spark, docs):
    rows = list(corpus(200, 2))
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    df = docs([(i, t) for i, t, _ in rows])
    pair, *_ = quality.train(df, labels, max_train=20)
    assert pair.shape == (2, 1 << quality.BITS)


def test_workers_forget_hashes(spark, docs):
    """Workers wait beside those of the stages that follow, so they keep no words after a task."""
    import pyarrow as pa

    rows = docs([(i, " ".join(f"w{i}x{j}" for j in range(300))) for i in range(40)])

    def words_kept(batches):
        import sys

        from braidwork.llm.common import WordHashes

        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(v) for v in sys.__dict__.get("_braidwork_kept", {}).values() if isinstance(v, WordHashes))], pa.int64())})

    pair = np.zeros((2, 1 << quality.BITS), np.float32)
    model = pair, 0.0, 1.0, 0.0
    for made in (quality.keep(rows, model), quality.score(rows, model)):
        assert made.count() == 40
        assert sum(r.n for r in spark.range(8).repartition(8).mapInArrow(words_kept, "n long").collect()) == 0
