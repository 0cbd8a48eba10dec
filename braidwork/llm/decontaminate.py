"""Benchmark decontamination by SimHash windows, in DataFrame expressions only.

Texts are lower-case words of letters and digits; a shingle is five words in a
row. An item of m shingles is compared with windows of m shingles.

1. Windows. A shingle of no item weighs the most, so moving a window right past
   one never makes it less similar. So windows that start at a shingle of any item
   suffice, and of those the ones whose shingles of items of their size weigh
   SIMILARITY times the lightest item of that size. Running sums over a document's
   hits tell, in one sorted pass. Which item a window resembles is not asked here.
2. Fingerprints. The SimHash of a window has BITS bits; a shingle adds plus or
   minus the root of its weight, so that fingerprints agree by weight.
3. Multi-index Hamming. Fingerprints are cut into BLOCKS blocks of 16 bits. Of two
   within RADIUS, one block differs in FLIPS bits or less. So the items' blocks are
   listed with all their flips, and an equi-join on (size, block, value) finds every
   pair within the radius; an unrelated pair meets there with probability 0.13.
4. Verification. Pairs within the radius stay, and the exact weighted Jaccard
   similarity of the shingle multisets, a shingle weighing 1 + ln(items / items that
   hold it), must be SIMILARITY.

At similarity 0.8 a bit differs with probability 0.15: 29 of 192 on average, and the
radius lies 3.7 standard deviations off, so about 1 pair in 10,000 of just that
similarity is lost, and fewer of higher ones.

The benchmark's shingles are broadcast up to BROADCAST_SHINGLES of them, counted
first (two numbers each); above that they are joined by shuffle. So are keys of
documents up to BROADCAST_ROWS. Shingles of all documents never leave their task:
only hits do.

Edge cases: null and empty texts, and those of fewer than five words, share
nothing, on either side; a null doc_id or item_id is kept; repeated rows give
one result for each (doc_id, item_id); ties take the first window; a text of any
length is searched whole; columns of clashing names are not read, and returned as
they are; empty tables give no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork import runtime
from braidwork.llm.common import table

WORDS, SIMILARITY = 5, 0.8
BITS, BLOCKS, FLIPS = 192, 12, 3
#: The most bits that can differ so that one of the blocks differs in FLIPS bits at most.
RADIUS = BLOCKS * FLIPS + BLOCKS - 1
BROADCAST_SHINGLES, BROADCAST_ROWS = 1_000_000, 200_000


def words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.split(plain, " ")


def shingles(text: Column, n: int = WORDS) -> Column:
    """Hashes of the text's n-word shingles, in order; the words are hashed once each."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    # bound as a lambda's variable, so that the words are made once a text
    return F.get(F.transform(F.array(hashed), lambda h: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(n))))).otherwise(F.array().cast("array<bigint>"))), 0)


def simhash(signs: Column) -> Column:
    """BITS bits, as whole numbers of 64: a bit is set if the hashes that have it weigh more than the others. signs: (h, v), v a whole number."""
    one = F.lit(1).cast("long")

    def bits(name: str) -> Column:
        sign = lambda x, b: F.when(F.getbit(x[name], b) == 1, x["v"]).otherwise(-x["v"])
        return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(signs, F.lit(0).cast("long"), lambda acc, x: acc + sign(x, b)) > 0)

    def joined(bits: Column) -> Column:
        return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: F.call_function("shiftleft", acc, F.lit(1)).bitwiseOR(F.when(x, one).otherwise(0)))

    return F.array(*(joined(bits(f"h{j}")) for j in range(BITS // 64)))


def signed(h: Column, v: Column) -> Column:
    """A shingle's hash, widened to BITS bits, and what it adds."""
    return F.struct(h.alias("h0"), *(F.xxhash64(h, F.lit(j)).alias(f"h{j}") for j in range(1, BITS // 64)), v.alias("v"))


def blocks(fingerprint: Column) -> Column:
    """The fingerprint's blocks of 16 bits, as (block, value)."""
    part = lambda i: F.call_function("shiftrightunsigned", F.get(fingerprint, i // 4), F.lit(i % 4 * 16)).bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int")
    return F.array(*(F.struct(F.lit(i).alias("block"), part(i).alias("value")) for i in range(BLOCKS)))


def flips() -> Column:
    """All values of 16 bits of which FLIPS at most are set."""
    masks = [sum(1 << b for b in bits) for n in range(FLIPS + 1) for bits in combinations(range(16), n)]
    return F.expr(f"array({','.join(map(str, masks))})")


def apart(a: Column, b: Column) -> Column:
    """The number of bits in which two fingerprints differ."""
    return sum((F.bit_count(F.get(a, j).bitwiseXOR(F.get(b, j))) for j in range(1, BITS // 64)), F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0))))


def _bounded(small: DataFrame, limit: int) -> DataFrame:
    """small for a broadcast if it has at most `limit` rows, else as it is. It must be cheap to count."""
    return F.broadcast(small) if small.count() <= limit else small


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns) and a key of 96 bits for (doc_id, text): rows of equal key are repeated rows."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("__k"), F.hash("doc_id", "text").alias("__k2"))


def item_tables(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, float]:
    """items (item, item_id, own, m), their shingles (item, m, h, c, w), weights (h, w), totals (item, m, weight, print) and the heaviest weight."""
    items = benchmark.select("item_id", "text").distinct().select("item_id", F.xxhash64("item_id", "text").alias("item"), shingles(F.col("text")).alias("own")).filter(F.size("own") > 0)
    items = runtime.written(items.select("item_id", "item", "own", F.size("own").alias("m")), "items")
    n_items = items.count()
    each = items.select("item", "m", F.explode("own").alias("h")).groupBy("item", "m", "h").agg(F.count(F.lit(1)).alias("c"))
    weigh = runtime.written(each.groupBy("h").agg((1 + F.log(F.lit(float(max(1, n_items))) / F.count(F.lit(1)))).alias("w")), "weights")
    each = runtime.written(each.join(weigh, "h"), "shingles")
    signs = F.sort_array(F.collect_list(signed(F.col("h"), F.col("c") * root(F.col("w")))))
    total = each.groupBy("item", "m").agg(F.sum(F.col("w") * F.col("c")).alias("weight"), signs.alias("signs"))
    total = runtime.written(total.select("item", "m", "weight", simhash(F.col("signs")).alias("print")), "totals")
    return items, each, weigh, total, heaviest(n_items)


def window_places(hits: DataFrame, each: DataFrame, total: DataFrame, similarity: float, broadcast_rows: int) -> DataFrame:
    """__k, __k2, m, start, from_, n: windows that start at a hit and whose hits of the size weigh enough, with the places of their hits."""
    key = ["__k", "__k2", "m"]
    least = total.groupBy("m").agg((similarity * F.min("weight") - 1e-6).alias("least"))
    sizes = runtime.written(each.select("h", "m").distinct().join(least, "m"), "sizes")
    own = runtime.written(hits.join(_bounded(sizes, broadcast_rows), "h").select(*key, "pos", "w", "least"), "own")
    heavy = own.groupBy(*key, "least").agg(F.sum("w").alias("weight")).filter("weight >= least").select(*key, "least")
    heavy = _bounded(runtime.written(heavy, "heavy"), broadcast_rows)
    # all hits of a document, for each size that can be; those of the size weigh
    at = hits.select("__k", "__k2", "pos").join(heavy, ["__k", "__k2"]).join(own.select(*key, "pos", "w"), [*key, "pos"], "left")
    hit = at.select(*key, "least", F.col("pos").alias("at"), F.lit(1).alias("hit"), F.coalesce("w", F.lit(0.0)).alias("w"), F.col("pos").alias("start"))
    end = at.select(*key, "least", (F.col("pos") + F.col("m") - 1).alias("at"), F.lit(0).alias("hit"), F.lit(0.0).alias("w"), F.col("pos").alias("start"))
    so_far = W.partitionBy(*key).orderBy("at", F.desc("hit")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = hit.unionByName(end).select(*key, "least", "start", "hit", F.sum("w").over(so_far).alias("sum"), F.sum("hit").over(so_far).alias("n"), "w")
    # up to a window's first hit, and up to its end
    low = lambda c: F.max(F.when(F.col("hit") == 1, c))
    high = lambda c: F.max(F.when(F.col("hit") == 0, c))
    found = rows.groupBy(*key, "least", "start").agg((high(F.col("sum")) - low(F.col("sum") - F.col("w"))).alias("weight"), (low(F.col("n")) - 1).alias("from_"), high(F.col("n")).alias("to"))
    return found.filter("weight >= least").select(*key, "start", F.col("from_").cast("int").alias("from_"), (F.col("to") - F.col("from_")).cast("int").alias("n"))


def near_pairs(prints: DataFrame, total: DataFrame) -> DataFrame:
    """__k, __k2, m, start, item, distance: all windows and items of one size whose fingerprints are within RADIUS."""
    left = prints.select("__k", "__k2", "m", "start", F.col("print").alias("p1"), F.inline(blocks(F.col("print"))))
    right = total.select("item", "m", F.col("print").alias("p2"), F.inline(blocks(F.col("print"))))
    right = right.select("item", "m", "p2", "block", F.explode(F.transform(flips(), lambda f: F.col("value").bitwiseXOR(f))).alias("value"))
    # listed flips are many rows of few bytes on file: never to be taken for a small table
    pairs = left.join(right.hint("merge"), ["m", "block", "value"]).withColumn("distance", apart(F.col("p1"), F.col("p2"))).filter(F.col("distance") <= RADIUS)
    return pairs.select("__k", "__k2", "m", "start", "item", "distance").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, broadcast_rows: int = BROADCAST_ROWS, broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """The best window of each (document, item) pair that is similar.

    Returns __k, __k2, doc_id, item_id, start (the window's first word), n_words,
    distance (of the fingerprints), similarity.
    """
    items, each, weigh, total, top = item_tables(benchmark)

    # hits: where documents hold a shingle of the benchmark
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("__k"), F.hash("doc_id", "text").alias("__k2"))
    placed = rows.select("__k", "__k2", "doc_id", F.posexplode(shingles(F.col("text"))).alias("pos", "h"))
    hits = runtime.written(placed.join(_bounded(weigh, broadcast_shingles), "h").distinct(), "hits")
    windows = runtime.written(window_places(hits, each, total, similarity, broadcast_rows), "windows")

    # fingerprints, from the documents that have windows
    some = windows.groupBy("__k", "__k2").agg(F.collect_list(F.struct("m", "start", "from_", "n")).alias("list"))
    some = runtime.written(some.join(hits.groupBy("__k", "__k2").agg(F.sort_array(F.collect_list(F.struct("pos", "h", "w"))).alias("hits")), ["__k", "__k2"]), "places")
    whole = rows.join(_bounded(some.select("__k", "__k2"), broadcast_rows), ["__k", "__k2"], "left_semi").dropDuplicates(["__k", "__k2"]).select("__k", "__k2", "doc_id", shingles(F.col("text")).alias("all"))
    cut = whole.join(some, ["__k", "__k2"]).select("__k", "__k2", "doc_id", F.explode(F.transform("list", lambda x: F.struct(
        x["m"].alias("m"), x["start"].alias("start"), F.slice("all", x["start"] + 1, x["m"]).alias("hashes"), F.slice("hits", x["from_"] + 1, x["n"]).alias("in")))).alias("x")).select("__k", "__k2", "doc_id", "x.*")
    # every shingle as one of no item, but for the hits
    rest = root(F.lit(top))
    added = F.transform("hashes", lambda h, i: signed(h, F.coalesce(root(F.get(F.filter("in", lambda x: x["pos"] == F.col("start") + i), 0)["w"]), rest)))
    cut = runtime.written(cut.withColumn("signs", added), "signs")
    cut = runtime.written(cut.withColumn("print", simhash(F.col("signs"))).drop("signs"), "prints")
    near = runtime.written(near_pairs(cut, total), "near")

    # exact weighted similarity
    weighed = lambda at: F.aggregate(at, F.lit(0.0), lambda acc, x: acc + x["w"])
    about = items.select("item", "item_id", "own").join(total.select("item", "weight"), "item")
    pairs = near.join(cut.drop("print"), ["__k", "__k2", "m", "start"]).join(about, "item")
    weight = weighed("in") + (F.size("hashes") - F.size("in")) * F.lit(top)
    kinds = F.array_distinct(F.transform("in", lambda x: F.struct(x["h"].alias("h"), x["w"].alias("w"))))
    count = lambda where, h: F.size(where) - F.size(F.array_remove(where, h))
    common = F.aggregate(kinds, F.lit(0.0), lambda acc, x: acc + x["w"] * F.least(count(F.col("hashes"), x["h"]), count(F.col("own"), x["h"])))
    pairs = pairs.withColumns({"__all": weight, "__both": common})
    scored = pairs.withColumn("similarity", F.col("__both") / (F.col("__all") + F.col("weight") - F.col("__both"))).filter(F.col("similarity") >= similarity - 1e-9)
    best = F.max_by(F.struct("start", (F.size("hashes") + WORDS - 1).alias("n_words"), "distance", "similarity"), F.struct("similarity", -F.col("start")))
    return scored.groupBy("__k", "__k2", "doc_id", "item_id").agg(best.alias("best")).select("__k", "__k2", "doc_id", "item_id", "best.*")


def heaviest(n: int) -> float:
    """The weight of a shingle that one item, or none, holds."""
    return 1 + math.log(max(1, n))


def root(weight: Column) -> Column:
    """The root of a weight in thousandths, a whole number: sums don't depend on their order."""
    return F.round(F.sqrt(weight) * 1000).cast("long")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold an item; all their columns are kept."""
    found = runtime.written(matches(docs, benchmark, **options).select("__k", "__k2").distinct(), "contaminated")
    rows = keyed(docs)
    return rows.join(_bounded(found, BROADCAST_ROWS), ["__k", "__k2"], "left_anti").select("row.*")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Each document that holds a benchmark item, with the item and the place."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = F.max_by(F.struct("start", "n_words", "distance", "similarity"), F.struct("similarity", -F.col("start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", F.col("best.start").cast("long").alias("start_word"), F.col("best.n_words").cast("long").alias("n_words"), F.col("best.distance").alias("distance"), F.round("best.similarity", 6).alias("similarity"))
