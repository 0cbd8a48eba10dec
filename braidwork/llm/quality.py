"""Quality classifier: naive Bayes support vectors.

A text is the set of its n-gram indicators: lower-case words, pairs of words,
shapes of words, pairs of those and a word three times in a row, hashed to 2^BITS features. Each indicator is scaled with
its class log-count ratio r = log((p/|p|) / (q/|q|)), p and q being 1 plus the
numbers of good and bad training texts that hold it. A linear model is then fit
to the scaled, unit-length vectors under hinge loss by dual coordinate descent,
and its weights are drawn towards their mean size, as naive Bayes would have it.
A logistic curve, fit on training texts that the model did not see, turns the
margin into a probability.

Training takes at most MAX_TRAIN labels, those with the smallest hash of their
doc_id, and at most as many texts; fitting happens in one task, whose input that
bound limits. The model is 2^BITS numbers, so it goes to the executors with the code.

Edge cases: null and empty texts have no indicator and get the score of the
bare threshold; a label that is null is ignored; a document with both labels
counts as both, a repeated label once, a repeated row once if texts must be chosen; ties of
the hash go by doc_id and label; texts are read whole, whatever their length; other
columns, whatever their names, are returned and never read; without labels of both classes every score is the share of good
labels (0.5 without any); an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.llm.common import U64, WordHashes, forget, kept, mix, prepare, table, texts, utf8

BITS = 18
MAX_TRAIN = 10_000
C, ROUNDS, KEEP = 1.0, 12, 0.25
_SHAPE = bytes.maketrans(bytes(range(256)), bytes(ord("0") if 48 <= c <= 57 else c if c < 65 or 91 <= c <= 96 or 123 <= c <= 127 else ord("A") if c <= 90 else ord("a") for c in range(256)))


class _Shapes(WordHashes):
    """Hash of a word's shape: letters a or A, digits 0, others as they are, runs as one."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        shape, last = bytearray(), -1
        for c in word.translate(_SHAPE):
            if c != last:
                shape.append(c)
                last = c
        value = self[word] = xxhash.xxh3_64_intdigest(bytes(shape), 1)
        return value


def features(text: bytes) -> np.ndarray:
    """The distinct features of a text, ascending."""
    raw = text.split()
    if not raw:
        return np.empty(0, np.int32)
    words = kept("word_hashes", WordHashes).array(text.lower().split())
    shapes = kept("shape_hashes", _Shapes).array(raw)
    one = mix(words + U64(1))
    two = mix(words[:-1] * U64(0x9E3779B97F4A7C15) + words[1:])
    form = mix(shapes[:-1] * U64(0x9E3779B97F4A7C15) + shapes[1:] + U64(2))
    single = mix(shapes + U64(3))
    again = words[2:][(words[2:] == words[1:-1]) & (words[1:-1] == words[:-2])][:1] * U64(0) + U64(5)  # a word three times in a row, whichever
    return np.unique(np.concatenate([one, two, form, single, mix(again)]) >> U64(64 - BITS)).astype(np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float, float, float]:
    """Weights of the features (r times w), bias, slope and offset of the logistic curve."""
    good = labels > 0
    if not len(rows) or good.all() or not good.any():
        share = float(good.mean()) if len(rows) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros((2, 1 << BITS), np.float32), 0.0, 0.0, math.log(share / (1 - share))
    order = np.random.default_rng(seed).permutation(len(rows))
    held = order[: max(2, len(rows) // 5)] if len(rows) >= 50 else order
    own = order[len(held) :] if len(rows) >= 50 else order
    if good[own].all() or not good[own].any():
        own = held = order
    # the curve is fit to margins of rows that neither the ratios nor the weights have seen
    ratio = ratios([rows[i] for i in own], good[own])
    w, bias = descend([rows[i] for i in own], good[own], ratio, seed + 1)
    z = np.array([margin(rows[i], ratio, w, bias) for i in held])
    slope, offset = logistic(z, good[held])
    rows, good = [rows[i] for i in order], good[order]
    ratio = ratios(rows, good)
    w, bias = descend(rows, good, ratio, seed + 1)
    return _pair(ratio, w), bias, slope, offset


def ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """The features' class log-count ratios."""
    counts = [np.ones(1 << BITS), np.ones(1 << BITS)]
    for row, g in zip(rows, good, strict=True):
        counts[int(g)][row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(rows: list[np.ndarray], good: np.ndarray, ratio: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias under hinge loss, each class weighing half, by dual coordinate descent; drawn towards their mean size."""
    y = np.where(good, 1.0, -1.0)
    weigh = {s: len(rows) / 2 / max(1, np.count_nonzero(y == s)) for s in (1.0, -1.0)}
    w, bias, alpha, scaled = np.zeros(1 << BITS), 0.0, np.zeros(len(rows)), []
    for row in rows:
        x = ratio[row]
        norm = math.sqrt(float(x @ x)) or 1.0
        scaled.append(x / norm)
    rng = np.random.default_rng(seed)
    for _ in range(ROUNDS):
        for i in rng.permutation(len(rows)):
            x, row, s = scaled[i], rows[i], y[i]
            gradient = s * (float(w[row] @ x) + bias) - 1.0
            top, old = C * weigh[s], alpha[i]
            new = min(max(old - gradient / (float(x @ x) + 1.0), 0.0), top)
            if new != old:
                alpha[i] = new
                w[row] += (new - old) * s * x
                bias += (new - old) * s
    size = np.abs(w).sum() / max(1, np.count_nonzero(w))
    return KEEP * size * (w != 0) + (1 - KEEP) * w, bias


def _pair(ratio: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Both numbers that a feature needs: r (for the length) and w."""
    return np.stack([ratio, w]).astype(np.float32)


def margin(row: np.ndarray, ratio: np.ndarray, w: np.ndarray, bias: float) -> float:
    x = ratio[row]
    norm = math.sqrt(float(x @ x)) or 1.0
    return float(w[row] @ x) / norm + bias


def logistic(z: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(good | margin): Newton's method on smoothed targets."""
    n1, n0 = np.count_nonzero(good), np.count_nonzero(~good)
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, math.log((n1 + 1) / (n0 + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, v = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * z * z).sum() + 1e-6, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(g * z).sum() + 1e-6 * a, g.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 0.0), b


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, text and label of at most max_train training rows.

    max_train bounds the labels, and then the texts that they name, of which
    equal ones with equal labels count once; those of the least hash are taken.
    """
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label is not null and doc_id is not null").distinct()
    chosen = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_train))  # the bound makes it fit for a broadcast
    rows = texts(docs).join(chosen, "doc_id").select("doc_id", "text", "label")
    if docs.select("doc_id").join(chosen, "doc_id").count() > max_train:  # a doc_id names many texts
        rows = rows.dropDuplicates(["doc_id", "text", "label"]).orderBy(F.xxhash64("doc_id", "text", "label"), "text").limit(max_train)
    return rows


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float, float, float]:
    """Fits the model to labelled texts. labels: doc_id and a 0/1 column."""
    prepare(docs.sparkSession)
    rows = labelled(docs, labels, label, max_train)

    def extract(batches):
        for batch in batches:
            found = [features(t) for t in utf8(batch["text"])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].cast(pa.string()), "label": batch["label"], "row": pa.array([f.tobytes() for f in found], pa.binary())})
        forget()

    def learn(group: pa.Table) -> pa.Table:
        own = sorted(zip(group["doc_id"].to_pylist(), group["label"].to_pylist(), group["row"].to_pylist(), strict=True))
        pair, bias, slope, offset = fit([np.frombuffer(r, np.int32) for _, _, r in own], np.array([y for _, y, _ in own]))
        return pa.table({"model": pa.array([pair.astype("<f4").tobytes()], pa.binary()), "numbers": pa.array([[bias, slope, offset]], pa.list_(pa.float64()))})

    sparse = rows.mapInArrow(extract, "doc_id string, label int, row binary")
    got = sparse.groupBy(F.lit(0).alias("one")).applyInArrow(learn, "model binary, numbers array<double>").collect()
    if not got:
        pair, bias, slope, offset = fit([], np.empty(0))
    else:
        pair, (bias, slope, offset) = np.frombuffer(got[0].model, "<f4"), got[0].numbers
    return pair.reshape(2, -1), bias, slope, offset


def score(docs: DataFrame, model, *more: str) -> DataFrame:
    """doc_id, the named columns and score: the probability that a text is good."""
    pair, bias, slope, offset = model
    ratio, w = pair
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.struct("doc_id", *more).alias("row"))
    shared = docs.sparkSession.sparkContext.broadcast((ratio, w))

    def apply(batches):
        for batch in batches:
            r, v = shared.value
            z = np.array([margin(features(t), r, v, bias) for t in utf8(batch["text"])])
            p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(p, pa.float64())], names=["row", "score"])
        forget()

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(apply, schema).select("row.*", "score")


def keep(docs: DataFrame, model, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose texts score `least` or more."""
    pair, bias, slope, offset = model
    shared = docs.sparkSession.sparkContext.broadcast(tuple(pair))
    schema = T.StructType([T.StructField("row", docs.schema)])

    def choose(batches):
        for batch in batches:
            r, v = shared.value
            z = np.array([margin(features(t), r, v, bias) for t in utf8(batch["text"])])
            good = 1 / (1 + np.exp(-np.clip(slope * z + offset, -60, 60))) >= least
            yield pa.RecordBatch.from_arrays([batch["row"].filter(pa.array(good, pa.bool_()))], names=["row"])
        forget()

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.struct(*docs.columns).alias("row"))
    return rows.mapInArrow(choose, schema).select("row.*")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Learns from labels whose crc32(doc_id) mod 3 is not 1; scores all documents."""
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = train(docs, table(spark, sf_dir, "labels").filter(~held))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
