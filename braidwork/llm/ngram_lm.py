"""Language-model scoring with a weighted backoff automaton.

Smoothed n-grams become a weighted automaton. A state is a context of up to
order-1 words; an arc is an n-gram that training holds, weighted with its whole
smoothed log10 probability; a failure arc leads to the state with the context's
first word dropped, weighted with the log10 of the mass left for it. One
left-to-right traversal carries the state: at each token it takes the arc of the
longest context or adds failure weights until there is one.

Smoothing is Dirichlet: P(w|u) = (c(uw) + m P(w|u')) / (c(u) + m), with add-one
below: P(w) = (c(w) + 1) / (N + V + 1). Each level sums to one over the
vocabulary and one slot for unknown words.

The model is as large as the corpus, so no task and no broadcast ever holds it.
Documents are dealt to blocks of bounded size by a hash; equal rows are dealt
apart. Each block sends its distinct n-grams, pre-aggregated and delta-coded, to
buckets of the key range; a bucket sums the training counts and sends back one
count for each n-gram asked for, in the order asked. The block then builds just
the part of the automaton that its own texts can reach, which is exact. A frequent
n-gram arrives once from each block, so no key is hot.

Of more than DIRECT blocks, each speaks to relays only: the blocks of one group
and one wide range of keys share a relay, which merges what they ask, passes it
on to the range's buckets and deals the answers out again. So n blocks send about
n^1.5 messages, not n^2, and results are the same.

Words are identified by 64-bit hashes.

Edge cases: a null or empty text is one end token; null doc_ids are scored as
any other and count as held out or not by the given column; repeated rows are
scored and counted each; ties do not arise, as counts are sums; a text longer than
a block makes its block as long as itself; columns of clashing names are not read
but for `train`; an empty table gives no rows; without training rows all counts
are 0 and scores are those of the uniform model.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import U64, blocks_for, mix, planes, prepare, slices, table, trim, unplanes, utf8, volume, word_hashes

BLOCK_BYTES = 10_000_000
#: Production order and prior weight of each order above 1.
ORDER, PRIOR = 3, 12.0
#: Blocks that speak to buckets without relays, and partitions of one shuffle at most.
DIRECT, PARTITIONS = 4096, 20_000
#: Hashes that stand for the begin and end of a text; words are never empty.
BEGIN, END = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)


def block_grams(texts_: list[bytes], order: int):
    """Flat n-gram keys of the texts, each as begin, words, end.

    Returns the tokens of each text and, for m = 1..order, the distinct keys,
    each position's index among them (-1: the history is shorter) and a
    position of each.
    """
    hashes = word_hashes()
    parts, lengths = [], np.empty(len(texts_), np.int64)
    for i, text in enumerate(texts_):
        words = text.lower().split()  # bytes: only A-Z change, only 20, 09-0D split
        lengths[i] = len(words) + 1
        flat = np.empty(len(words) + 2, U64)
        flat[0], flat[-1] = BEGIN, END
        flat[1:-1] = hashes.array(words)
        parts.append(flat)
    tokens = np.concatenate(parts) if parts else np.empty(0, U64)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    place = np.arange(len(tokens)) - np.repeat(starts, lengths + 1)
    levels, key = [], mix(tokens)
    for m in range(1, order + 1):
        if m > 1:
            longer = np.zeros_like(key)
            longer[1:] = mix(key[:-1] * U64(0x9E3779B97F4A7C15) + tokens[1:] + U64(m))
            key = longer
        valid = np.flatnonzero(place >= m - 1)
        distinct, first, inverse = np.unique(key[valid], return_index=True, return_inverse=True)
        index = np.full(len(key), -1, np.int32)
        index[valid] = inverse
        levels.append((distinct, index, valid[first]))
    return lengths, starts, place, levels


def bounds(n: int) -> np.ndarray:
    """Upper ends of n equal ranges of 64-bit keys, without the last."""
    return np.array([(i << 64) // n for i in range(1, n)], U64)


def ask(texts_: list[bytes], train: np.ndarray, order: int, ends: np.ndarray):
    """For each key range: the block's distinct keys of each order and their training counts."""
    lengths, starts, place, levels = block_grams(texts_, order)
    trained = np.repeat(train, lengths + 1)
    found = []
    for distinct, index, _ in levels:
        found.append((distinct, np.bincount(index[(index >= 0) & trained], minlength=len(distinct)).astype(np.uint64)))
    yield from dealt(found, ends)


def dealt(found: list[tuple[np.ndarray, np.ndarray]], ends: np.ndarray):
    """(range, keys of each order, counts of each order), coded, for the ranges that end at `ends`."""
    cuts = [np.r_[0, np.searchsorted(distinct, ends), len(distinct)] for distinct, _ in found]
    for b in range(len(ends) + 1):
        keys = [planes(np.diff(distinct[at[b] : at[b + 1]], prepend=U64(0))) for (distinct, _), at in zip(found, cuts, strict=True)]
        yield b, keys, [planes(count[at[b] : at[b + 1]]) for (_, count), at in zip(found, cuts, strict=True)]


def merged(requests: list[tuple[int, list[bytes], list[bytes]]], order: int):
    """For each order: distinct keys, their counts summed, each request's keys' places among them."""
    for m in range(order):
        keys = [np.cumsum(unplanes(r[1][m], U64), dtype=U64) for r in requests]
        counts = np.concatenate([unplanes(r[2][m], U64) for r in requests])
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), U64)
        np.add.at(total, inverse, counts)
        yield distinct, total, np.split(inverse, np.cumsum([len(k) for k in keys])[:-1])


def answer(requests: list[tuple[int, list[bytes], list[bytes]]], order: int):
    """Total training counts for each sender's keys, with the bucket's share of V and N."""
    sums, kinds, tokens = [], 0, 0
    for m, (distinct, total, places) in enumerate(merged(requests, order)):
        if m == 0:
            word = distinct != mix(np.array([BEGIN]))[0]
            kinds, tokens = int(np.count_nonzero(total[word])), int(total[word].sum())
        sums.append([total[p] for p in places])
    for i, request in enumerate(requests):
        yield request[0], [planes(s[i]) for s in sums], kinds, tokens


class Automaton:
    """The states and arcs that a block's texts can reach.

    levels: as from block_grams; counts: training counts of their keys;
    n_kinds, n_tokens: V and N of the whole training data.
    """

    def __init__(self, levels, counts, n_kinds: int, n_tokens: int, prior: float):
        self.levels, self.counts = levels, counts
        one = (counts[0].astype(np.float64) + 1) / (n_tokens + n_kinds + 1)
        self.arcs, self.fails, below = [np.log10(one)], [None], one
        for m in range(1, len(levels)):
            _, index, first = levels[m]
            lower, context = levels[m - 1][1][first], levels[m - 1][1][first - 1]
            seen = counts[m - 1][context].astype(np.float64)
            p = (counts[m] + prior * below[lower]) / (seen + prior)
            self.arcs.append(np.log10(p))
            self.fails.append(np.log10(prior / (counts[m - 1].astype(np.float64) + prior)))
            below = p

    def traverse(self, first: int, last: int) -> float:
        """log10 probability of a text: of the tokens at positions first to last - 1, in one walk that carries the state.

        The state is the number of words before a token that form a context which
        training holds; it is the longest such, so arcs of longer ones need no look.
        """
        weights = [self.arcs[0][self.levels[0][1][first:last]].tolist()]
        known = (self.counts[0][self.levels[0][1][first:last]] > 0).tolist()
        failing: list[list[float]] = [[]]
        for m in range(1, len(self.levels)):
            gram = self.levels[m][1][first:last]
            arc = (gram >= 0) & (self.counts[m][gram] > 0)
            weights.append(np.where(arc, self.arcs[m][gram], 1.0).tolist())  # no log probability is above 0
            failing.append(self.fails[m][self.levels[m - 1][1][first - 1 : last - 1]].tolist())
        total, top = 0.0, len(weights) - 1
        state = min(1, top)  # the begin of the text
        for i in range(last - first):
            while state and weights[state][i] > 0:
                total += failing[state][i]
                state -= 1
            total += weights[state][i]
            state = min(state + 1, top) if known[i] else 0
        return total


def score_block(texts_: list[bytes], counts, n_kinds: int, n_tokens: int, prior: float):
    """Token numbers, known tokens, base and model scores of the texts."""
    lengths, starts, place, levels = block_grams(texts_, len(counts))
    model = Automaton(levels, counts, n_kinds, n_tokens, prior)
    at = np.flatnonzero(place > 0)
    cut = np.cumsum(lengths) - lengths
    known = np.add.reduceat((counts[0][levels[0][1][at]] > 0).astype(np.int64), cut)
    base = np.add.reduceat(model.arcs[0][levels[0][1][at]], cut)
    whole = np.array([model.traverse(a + 1, a + 1 + n) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)])
    return lengths, known, base, whole


def _deal(n: int):
    """Rows to (block, blob): blob holds the block's share of a batch, as a compressed Arrow stream."""

    def deal(batches):
        import xxhash
        import zstandard
        from pyspark import TaskContext

        own, seen = TaskContext.get().partitionId(), {}
        pack = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for batch in slices(whole, "text", 8_000_000):
                members: dict[int, list[int]] = {}
                for i, h in enumerate(batch["h"].to_pylist()):
                    c = seen[h] = seen.get(h, -1) + 1  # equal rows differ by their number
                    members.setdefault(xxhash.xxh3_64_intdigest(f"{h} {own} {c}") % n, []).append(i)
                body = batch.select(["doc_id", "text", "train"])
                out = []
                for block, places in members.items():
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, body.schema) as stream:
                        stream.write_batch(body.take(pa.array(places)))
                    out.append((block, pack.compress(sink.getvalue())))
                yield pa.RecordBatch.from_pydict({"block": pa.array([b for b, _ in out], pa.int32()), "blob": pa.array([x for _, x in out], pa.binary())})

    return deal


def _texts(blobs) -> tuple[pa.Array, list[bytes], np.ndarray]:
    """doc_id, text and train of a block, in an order that doesn't depend on arrival."""
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    rows = pa.concat_tables(pa.ipc.open_stream(unpack.decompress(b)).read_all() for b in sorted(blobs.to_pylist())).combine_chunks()
    return rows["doc_id"], [t for c in rows["text"].chunks for t in utf8(c)], rows["train"].to_numpy(zero_copy_only=False)


_ASKED = "keys array<binary>, counts array<binary>"
_TOLD = "sums array<binary>, kinds long, tokens long"


def _asked(name: str, to: str, out: list[tuple]) -> pa.Table:
    names, kinds = (to, name, "keys", "counts"), (pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()))
    return pa.table({n: pa.array([x[i] for x in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def _told(name: str, to: str, out: list[tuple]) -> pa.Table:
    names, kinds = (to, name, "sums", "kinds", "tokens"), (pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.int64(), pa.int64())
    return pa.table({n: pa.array([x[i] for x in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})


def _requests(group: pa.Table, sender: str) -> list[tuple]:
    return sorted(zip(*(group[c].to_pylist() for c in (sender, "keys", "counts")), strict=True))


def _sums(replies: pa.Table, sender: str, order: int) -> tuple[list[np.ndarray], int, int]:
    """The answers' counts of each order, joined by the senders' key ranges; V and N in them."""
    got = sorted(zip(replies[sender].to_pylist(), replies["sums"].to_pylist(), strict=True))
    return [np.concatenate([unplanes(s[m], U64) for _, s in got]) for m in range(order)], *(sum(replies[c].to_pylist()) for c in ("kinds", "tokens"))


def score(docs: DataFrame, train: F.Column, order: int = ORDER, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES, direct: int = DIRECT) -> DataFrame:
    """Scores every text with the model of the rows where `train` holds.

    docs: doc_id, text; other columns may serve `train` and are not returned.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, train_kinds,
    base_score, score.
    """
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    _, n_bytes = volume(rows)
    n = blocks_for(n_bytes, block_bytes)
    wide = n if n <= direct else math.isqrt(n - 1) + 1  # key ranges that a block speaks to
    fine = 1 if n <= direct else -(-n // wide)  # buckets of a range
    groups = n if n <= direct else wide  # of blocks, each with a relay for a range
    ends = bounds(wide * fine)
    to = lambda df, key: df.repartition(min(PARTITIONS, n), key).groupBy(key)
    blocks = rows.select(F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text", "train").mapInArrow(_deal(n), "block int, blob binary")
    blocks = blocks.repartition(min(PARTITIONS, n), "block")

    def send(group: pa.Table) -> pa.Table:
        trim()  # what the group before has left
        block = group["block"][0].as_py()
        _, body, trained = _texts(group["blob"])
        relay = 0 if fine == 1 else block % groups * wide
        return _asked("block", "at", [(relay + b, block, k, c) for b, k, c in ask(body, trained, order, ends[fine - 1 :: fine])])

    def pass_on(group: pa.Table) -> pa.Table:
        at = group["at"][0].as_py()
        found = [(distinct, total) for distinct, total, _ in merged(_requests(group, "block"), order)]
        low = at % wide * fine
        return _asked("relay", "bucket", [(low + b, at, k, c) for b, k, c in dealt(found, ends[low : low + fine - 1])])

    def reply(group: pa.Table) -> pa.Table:
        sender, key = ("block", "at") if fine == 1 else ("relay", "bucket")
        bucket = group[key][0].as_py()
        return _told(key, sender, [(x[0], bucket, *x[1:]) for x in answer(_requests(group, sender), order)])

    def deal_out(group: pa.Table, replies: pa.Table) -> pa.Table:
        at, requests = group["at"][0].as_py(), _requests(group, "block")
        sums, kinds, tokens = _sums(replies, "bucket", order)
        places = [p for *_, p in merged(requests, order)]
        return _told("at", "block", [(r[0], at % wide, [planes(s[p[i]]) for s, p in zip(sums, places, strict=True)], kinds, tokens) for i, r in enumerate(requests)])

    def finish(own: pa.Table, replies: pa.Table) -> pa.Table:
        trim()
        ids, body, trained = _texts(own["blob"])
        counts, kinds, tokens = _sums(replies, "at", order)
        lengths, known, base, whole = score_block(body, counts, kinds, tokens, prior)
        same = lambda x: pa.array(np.full(len(body), x, np.int64))
        return pa.table({"doc_id": ids, "held_out": pa.array(~trained), "n_tokens": pa.array(lengths), "n_known": pa.array(known), "train_tokens": same(tokens), "train_kinds": same(kinds), "base_score": pa.array(base), "score": pa.array(whole)})

    asked = blocks.groupBy("block").applyInArrow(send, "at long, block long, " + _ASKED)
    if fine == 1:
        told = to(asked, "at").applyInArrow(reply, "block long, at long, " + _TOLD)
    else:
        passed = to(asked, "at").applyInArrow(pass_on, "bucket long, relay long, " + _ASKED)
        back = to(passed, "bucket").applyInArrow(reply, "relay long, bucket long, " + _TOLD)
        told = to(asked, "at").cogroup(to(back, "relay")).applyInArrow(deal_out, "block long, at long, " + _TOLD)
    told = to(told.withColumn("block", F.col("block").cast("int")), "block")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, train_tokens long, train_kinds long, base_score double, score double"
    return blocks.groupBy("block").cogroup(told).applyInArrow(finish, schema)


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores all documents; those whose crc32(doc_id) mod 7 is 2 are held out of training."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
