"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles; texts of one set are one record.
Records get COORDINATES min-hashes, each a uniformly sampled token of the set
that sets share with the probability of their similarity. Each of RUNS runs
samples one coordinate, and with probability 1/0.8 - 1 a second one, and splits
all records by the token there. Buckets of up to LIMIT records are brute-forced;
larger ones are split again, each time on two further sampled coordinates, up to
DEPTH levels or until a split leaves more than DENSE of the bucket together.
A pair of similarity 0.8 is missed by all runs with probability 0.2^RUNS (7e-5)
where buckets are within LIMIT.

Brute force has two steps. Records without a partner of a similar sketch (the
min-hashes' low bytes) leave. The others' whole sets are fetched, and all their
similarities are computed exactly, by matrix products over the shared tokens. A
bucket returns one row a record: how many documents it links to and the bucket's
root of its component. So results are linear in the bucket. A record brings the
list of its buckets, and a pair counts in the first that both are in, at whatever
level that was brute-forced, so sums over buckets count each link once.

A bucket that stays larger than LIMIT is of records that share nearly all
coordinates. It is dealt by salt into parts of LIMIT / 2 records on average, and
every two of its parts are brute-forced together as one block. So all its pairs
meet, no task holds more than about LIMIT records, and no pair is lost; a pair
of one part counts in that part's first block only. Of a pair of similarity 0.8
that shares a bucket, any number of further splits loses both paths with a
probability below 0.0625, so all runs miss it with one below 2.5e-4.

Sets may be long, so the sets of a bucket hold TOKENS tokens at most; one of more
is dealt into parts in the same way.

Classes are the components of the links, found by rounds of joins over links
alone; nothing about all documents reaches the driver.

Joins with the rows of a key split off the hot keys, as those of a hub, of exact
copies or of a large bucket: they are few, are broadcast and their rows stay.

Edge cases: doc_ids are of any type; a text of one to four words is one shingle; null texts and texts
without words link to nothing, not even to each other; a null doc_id is kept and
never names a class unless all of its class are null; repeated rows are copies;
ties go to the least doc_id; columns of clashing names are not read, and returned as
they are; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork import runtime
from braidwork.llm.common import HOT_ROWS, U64, WordHashes, bounded, forget, hot_from, joined_by, kept, mix, planes, prepare, table, trim, unplanes, utf8

WORDS, SIMILARITY = 5, 0.8
COORDINATES, RUNS, DEPTH = 64, 6, 8
LIMIT, DENSE = 3000, 0.7
#: A pair stays if its sketches agree in this share of the coordinates: 0.8 less 4.4 standard deviations.
SKETCH = 0.58
#: Bytes that are broadcast; a row of keys and binary names takes about ROW.
BROADCAST_BYTES, ROW = 16_000_000, "96"
#: Tokens of the sets that one brute force holds; a bucket of more is done part by part.
TOKENS = 4_000_000
_RNG = np.random.default_rng(20)
FACTORS = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * U64(2) + U64(1)
#: The coordinates that the runs sample first, as (run, coordinate); no coordinate serves twice.
FIRST = [(r, c) for r in range(RUNS) for c in ([r * 2, r * 2 + 1] if _RNG.random() < 1 / SIMILARITY - 1 else [r * 2])]


def shingle_set(text: bytes, n: int = WORDS) -> np.ndarray:
    """The distinct 48-bit hashes of a text's shingles, ascending; words are lower-cased (A-Z) and split by white space."""
    words = kept("word_hashes", WordHashes).array(text.lower().split())
    if not len(words):
        return words
    n = min(n, len(words))
    key = words[: len(words) - n + 1].copy()
    for j in range(1, n):
        key = mix(key * U64(0x9E3779B97F4A7C15) + words[j : len(words) - n + 1 + j])
    return np.unique(mix(key + U64(n)) >> U64(16))


def min_hashes(tokens: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, U64)
    for start in range(0, len(tokens), 4096):
        np.minimum(out, (tokens[start : start + 4096, None] * FACTORS).min(axis=0), out=out)
    return (out >> U64(32)).astype(np.uint32)


def child_keys(path: int, level: int, row: np.ndarray) -> list[int]:
    """The paths on which a record goes on from a bucket: what is sampled depends on the path alone."""
    h = xxhash.xxh3_64_intdigest(f"{path} {level}")
    low, n = COORDINATES // 4, COORDINATES - COORDINATES // 4
    one = h % n
    two = (one + 1 + (h >> 32) % (n - 1)) % n
    return [_key(path, low + c, int(row[low + c])) for c in (one, two)]


def _key(path: int, coordinate: int, value: int) -> int:
    h = xxhash.xxh3_64_intdigest(f"{path} {coordinate} {value}")
    return h - (1 << 64) if h >> 63 else h


def records(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, k and k2 (its key), sid (its set), tokens (their number), sketch. No words: sid is null."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), F.hash("doc_id", "text").alias("k2"), F.coalesce("text", F.lit("")).alias("text"))
    kind = dict(docs.dtypes)["doc_id"]

    def sketch(batches):
        for batch in batches:
            sids, sketches, sizes = [], [], []
            for text in utf8(batch["text"]):
                tokens = shingle_set(text)
                sids.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                sketches.append(min_hashes(tokens).tobytes() if len(tokens) else None)
                sizes.append(len(tokens))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "k": batch["k"], "k2": batch["k2"], "sid": pa.array(sids, pa.binary()), "tokens": pa.array(sizes, pa.int64()), "sketch": pa.array(sketches, pa.binary())})
        forget()

    return rows.mapInArrow(sketch, f"doc_id {kind}, k long, k2 int, sid binary, tokens long, sketch binary")


def _grouped(batches):
    """Tables of equal `key` from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch["key"].to_numpy()
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def _paths(reps: DataFrame) -> DataFrame:
    """key, sid: every record on each of the runs' first paths."""

    def first(batches):
        for batch in batches:
            rows = np.array([np.frombuffer(s, np.uint32) for s in batch["sketch"].to_pylist()]).reshape(-1, COORDINATES)
            for run, c in FIRST:
                keys = [_key(run, c, v) for v in rows[:, c].tolist()]
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "sid": batch["sid"]})

    return reps.select("sid", "sketch").mapInArrow(first, "key long, sid binary")


def _deeper(rows: DataFrame, level: int) -> DataFrame:
    def split(batches):
        for batch in batches:
            keys, take = [], []
            for i, (path, sketch) in enumerate(zip(batch["key"].to_pylist(), batch["sketch"].to_pylist(), strict=True)):
                own = child_keys(path, level, np.frombuffer(sketch, np.uint32))
                keys += own
                take += [i] * len(own)
            part = batch.select(["sid", "size"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *part.columns], names=["key", "sid", "above"])

    return rows.select("key", "sid", "sketch", "size").mapInArrow(split, "key long, sid binary, above long")


def buckets(reps: DataFrame, limit: int, depth: int, least: int) -> DataFrame:
    """key, bucket, part, sid, copies, tokens, sketch of all records in buckets of 2 to `limit` records, and in blocks of two parts of larger ones.

    key names what is brute-forced together: a bucket, or a block of it. part is
    the record's part, as -1 - part in all of the part's blocks but the first.
    Sketches are joined to the rows that have company; all others go without.
    """
    rows, out = _paths(reps).withColumn("above", F.lit(None).cast("long")), []
    sketches = reps.select("sid", "sketch")
    for level in range(depth + 1):
        sizes = runtime.written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
        rows = runtime.written(joined_by(rows, sizes, ["key"], "size", least), "company")
        out.append(rows.filter(F.col("size") <= limit).select("key", F.col("key").alias("bucket"), F.lit(0).alias("part"), "sid"))
        rows = rows.filter(F.col("size") > limit)
        if rows.isEmpty():
            break
        dense = F.coalesce(F.col("size") > DENSE * F.col("above"), F.lit(False)) if level < depth else F.lit(True)
        out.append(_blocks(rows.filter(dense), limit))
        if level == depth:
            break
        rows = _deeper(rows.filter(~dense).join(sketches, "sid"), level)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.join(reps.select("sid", "copies", "tokens", "sketch"), "sid")


def _blocks(rows: DataFrame, limit: int) -> DataFrame:
    """The records of buckets above the limit, in a block for each two of their bucket's parts. There are 3 parts or more."""
    parts = F.ceil(F.col("size") * 2 / limit).cast("int")  # half the limit on average
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sid", "key"), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).filter("own <> other")
    block = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    first = F.col("other") == F.when(F.col("own") == 0, 1).otherwise(0)
    return rows.select(block.alias("key"), F.col("key").alias("bucket"), F.when(first, F.col("own")).otherwise(-1 - F.col("own")).alias("part"), "sid")


def lighter(left: DataFrame, tokens: int) -> DataFrame:
    """left with `half`, and with the keys whose sets hold more than `tokens` tokens dealt into parts, each two of which are a key of their own.

    half is to those parts what part is to a bucket's; 0 where nothing is dealt.
    """
    heavy = runtime.written(left.groupBy("key").agg(F.sum("tokens").alias("sum"), F.count(F.lit(1)).alias("n")).filter((F.col("sum") > tokens) & (F.col("n") > 2)), "heavy")
    left = left.join(heavy.select("key", "sum"), "key", "left")
    plain = left.filter("sum is null").drop("sum").withColumn("half", F.lit(0))
    parts = F.greatest(F.ceil(F.col("sum") * 2 / tokens), F.lit(3)).cast("int")
    rows = left.filter("sum is not null").withColumn("own", F.pmod(F.xxhash64("sid", "key", F.lit(1)), parts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).filter("own <> other")
    first = F.col("other") == F.when(F.col("own") == 0, 1).otherwise(0)
    rows = rows.withColumn("half", F.when(first, F.col("own")).otherwise(-1 - F.col("own")))
    rows = rows.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"), F.lit(1)))
    return plain.unionByName(rows.select(*plain.columns))


def sketch_partners(rows: np.ndarray, share: float = SKETCH) -> np.ndarray:
    """Which sketches have a partner that agrees in the share of coordinates."""
    low = np.ascontiguousarray((rows & np.uint32(0xFF)).astype(np.uint8).T)
    n, need = rows.shape[0], int(np.ceil(share * COORDINATES))
    found = np.zeros(n, bool)
    for a in range(0, n, 256):
        agree = np.zeros((min(256, n - a), n - a), np.uint8)
        for c in range(COORDINATES):
            agree += low[c, a : a + 256, None] == low[c, None, a:]
        agree[np.arange(len(agree)), np.arange(len(agree))] = 0
        pair = agree >= need
        found[a : a + 256] |= pair.any(axis=1)
        found[a:] |= pair.any(axis=0)
    return found


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common tokens of all pairs, exactly."""
    n, size = len(sets), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    number = np.cumsum(counts > 1) - 1
    column, row = number[inverse[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((n, n), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, [start, start + 2048])
        part = np.zeros((n, 2048), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        out += part @ part.T
    return out


def links(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """A matrix of the pairs that are similar."""
    size = np.array([len(s) for s in sets], np.float64)
    both, linked = intersections(sets), np.empty((len(sets), len(sets)), bool)
    for a in range(0, len(sets), 256):  # few rows at a time, as wide numbers take room
        own = both[a : a + 256].astype(np.float64)
        linked[a : a + 256] = own >= similarity * (size[a : a + 256, None] + size[None, :] - own) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def counted_here(linked: np.ndarray, bucket: int, parts: list[np.ndarray], leaves: list[list[int]]) -> np.ndarray:
    """The links that this bucket or block counts: those of no earlier common bucket, and of one part in its first block."""
    out = linked.copy()
    for part in parts:
        for p in np.unique(part[part < 0]):
            own = np.flatnonzero(part == p)
            out[np.ix_(own, own)] = False
    members: dict[int, list[int]] = {}
    for i in np.flatnonzero(linked.any(axis=1)).tolist():
        for leaf in leaves[i]:
            if leaf < bucket:
                members.setdefault(leaf, []).append(i)
    for own in members.values():
        if len(own) > 1:
            out[np.ix_(own, own)] = False
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """The first member of each member's component."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            root[i], edge = i, np.array([i])
            while len(edge):
                new = np.flatnonzero(linked[edge].any(axis=0) & (root < 0))
                root[new] = i
                edge = new
    return root


def components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """a -> root for all ends of the edges (a, b): alternating large-star and small-star rounds, until nothing changes.

    The edges of a hub stay where they are: its least neighbour is broadcast.
    """
    now = runtime.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    n_now = now.count()
    while True:
        hot = hot_from(n_now, hot_rows)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = runtime.written(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "low")
        large = joined_by(both, low, ["a"], "n", hot).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = runtime.written(large, "large")
        own = runtime.written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "own")
        small = joined_by(large, own, ["a"], "n", hot).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(own.select("a", F.col("m").alias("b")))
        after = runtime.written(small.distinct(), "edges")
        n_after = after.count()
        # a star forest: every a has one b, and no b is an a
        same = n_after == n_now and after.join(now, ["a", "b"], "left_anti").isEmpty()
        now, n_now = after, n_after
        if same:
            break
    return now.unionByName(now.select(F.col("b").alias("a"), "b").distinct())


def join(docs: DataFrame, similarity: float = SIMILARITY, limit: int = LIMIT, depth: int = DEPTH, broadcast_bytes: int = BROADCAST_BYTES, tokens: int = TOKENS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, k, k2, class_id (the least doc_id of its class), n_links (other documents that are similar), n_copies, sid, root (its class's set)."""
    if similarity < SIMILARITY:
        raise ValueError(f"the sketch share and the runs are set for a similarity of {SIMILARITY} or more")
    prepare(docs.sparkSession)
    all_rows = runtime.written(records(docs), "records")
    hot = hot_from(all_rows.count(), hot_rows)
    reps = all_rows.filter("sid is not null").groupBy("sid").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.min(F.struct("k", "k2")).alias("at"), F.max("tokens").alias("tokens"), F.max("sketch").alias("sketch"))
    reps = runtime.written(reps, "sets")
    spread = buckets(reps, limit, depth, hot).repartition("key").sortWithinPartitions("key")

    def survive(batches):
        for group in _grouped(batches):
            if group.num_rows < 2:
                continue
            group = group.combine_chunks()
            rows = np.array([np.frombuffer(s, np.uint32) for s in group["sketch"].to_pylist()])
            stay = sketch_partners(rows)
            if stay.any():
                yield from group.filter(pa.array(stay)).select(["key", "bucket", "part", "sid", "copies", "tokens"]).combine_chunks().to_batches()
        trim()

    left = runtime.written(spread.mapInArrow(survive, "key long, bucket long, part int, sid binary, copies long, tokens long"), "partners")

    # the whole sets of those that are left
    one = reps.join(bounded(runtime.written(left.select("sid").distinct(), "wanted"), broadcast_bytes, ROW), "sid", "left_semi")
    one = runtime.written(one.select("sid", "at.k", "at.k2", "copies"), "wanted")
    bodies = docs.select(F.xxhash64("doc_id", "text").alias("k"), F.hash("doc_id", "text").alias("k2"), F.coalesce("text", F.lit("")).alias("text"))
    small = bounded(one, broadcast_bytes, ROW)
    bodies = (joined_by(bodies, one, ["k", "k2"], "copies", hot) if small is one else bodies.join(small, ["k", "k2"])).select("sid", "text")

    def fetch(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"sid": batch["sid"], "tokens": pa.array([planes(np.diff(shingle_set(t), prepend=U64(0))) for t in utf8(batch["text"])], pa.binary())})
        forget()

    sets = runtime.written(bodies.mapInArrow(fetch, "sid binary, tokens binary").dropDuplicates(["sid"]), "tokens")
    leaves = left.groupBy("sid").agg(F.collect_set("bucket").alias("leaves"))
    # by sid first: a set serves in few buckets; then by bucket
    full = lighter(left, tokens).drop("tokens").join(sets.join(leaves, "sid"), "sid").repartition("key").sortWithinPartitions("key")

    def brute(batches):
        for group in _grouped(batches):
            own = sorted(zip(*(group[c].to_pylist() for c in ("sid", "copies", "part", "half", "leaves", "tokens")), strict=True))
            if len(own) < 2:
                continue
            linked = links([np.cumsum(unplanes(t, U64), dtype=U64) for *_, t in own], similarity)
            if not linked.any():
                continue
            counted = counted_here(linked, group["bucket"][0].as_py(), [np.array([x[c] for x in own]) for c in (2, 3)], [x[4] for x in own])
            copies = np.array([x[1] for x in own])
            has = np.flatnonzero(linked.any(axis=1))
            root = roots(linked)
            yield pa.RecordBatch.from_pydict({"a": pa.array([own[i][0] for i in has], pa.binary()), "b": pa.array([own[root[i]][0] for i in has], pa.binary()), "links": pa.array([int(copies[counted[i]].sum()) for i in has], pa.int64())})
        trim()

    found = runtime.written(full.mapInArrow(brute, "a binary, b binary, links long"), "links")
    whole = components(found.select("a", "b"), hot_rows)
    counts = found.groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    named = reps.select("sid", "copies", "least").join(whole.select(F.col("a").alias("sid"), F.col("b").alias("root")), "sid")
    named = runtime.written(named.join(counts, "sid", "left"), "named")
    names = runtime.written(named.groupBy("root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n")), "names")
    linked = joined_by(named, names, ["root"], "n", hot).select("sid", "copies", "class_id", F.coalesce("links", F.lit(0)).alias("links"), "root")
    alone = reps.join(linked.select("sid"), "sid", "left_anti").filter("copies > 1").select("sid", "copies", F.col("least").alias("class_id"), F.lit(0).cast("long").alias("links"), F.col("sid").alias("root"))
    about = runtime.written(linked.unionByName(alone), "classes")
    rows = all_rows.select("doc_id", "k", "k2", "sid")
    small = bounded(about, broadcast_bytes, ROW)
    if small is about:  # without words there is nothing to join, and exact copies may be many
        many = F.broadcast(about.filter(F.col("copies") > hot))
        out = rows.filter("sid is not null")
        out = out.join(many, "sid").unionByName(out.join(many, "sid", "left_anti").join(about.filter(F.col("copies") <= hot), "sid", "left"))
        out = out.unionByName(rows.filter("sid is null"), allowMissingColumns=True)
    else:
        out = rows.join(small, "sid", "left")
    n_copies = F.coalesce(F.col("copies"), F.lit(1)).cast("long")
    return out.select("doc_id", "k", "k2", F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + n_copies - 1).alias("n_links"), n_copies.alias("n_copies"), "sid", F.coalesce("root", "sid").alias("root"))


def dedupe(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class: the one of the least (doc_id, key); all columns are kept."""
    found = join(docs, **options)
    member = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "k", "k2")
    # a class is its component, whatever its doc_ids; a text without words is by itself
    alone = F.col("sid").isNull()
    group = F.struct("root", F.when(alone, F.col("k")).alias("k"), F.when(alone, F.col("k2")).alias("k2"))
    keep = found.groupBy(group.alias("g")).agg(F.min(member).alias("m"), F.sum(F.col("sid").isNull().cast("int")).alias("wordless")).select("m.k", "m.k2", "wordless")
    same = found.groupBy("k", "k2").agg(F.count(F.lit(1)).alias("rows"))
    keep = runtime.written(keep.join(same, ["k", "k2"]).select("k", "k2", "rows", (F.col("wordless") > 0).alias("wordless")), "keep")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("k"), F.hash("doc_id", "text").alias("k2"))
    small = bounded(keep, BROADCAST_BYTES, ROW)
    rows = joined_by(rows, keep, ["k", "k2"], "rows", HOT_ROWS) if small is keep else rows.join(small, ["k", "k2"])
    single = rows.filter("rows = 1 or wordless")
    again = rows.filter("rows > 1 and not wordless").dropDuplicates(["k", "k2"])
    return single.unionByName(again).select("row.*")


def op9_chosen_path(spark, sf_dir: str) -> DataFrame:
    """Every document's near-copy class and number of links."""
    return join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


#: The same by comparing all documents that share a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM t WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a, count(*) AS links, count(*) FILTER (same) AS copies FROM l GROUP BY a)
SELECT r.a AS doc_id, min(r.b) AS class_id, coalesce(min(k.links), 0) AS n_links, 1 + coalesce(min(k.copies), 0) AS n_copies FROM r LEFT JOIN k ON k.a = r.a GROUP BY r.a"""
