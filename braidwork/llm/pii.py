"""Personal data by weak supervision, in DataFrame expressions only.

1. Candidates of each kind (email, ip, card, phone): the leftmost
   non-overlapping matches of the base rule, valid or not, and of a wider rule
   (spelled-out addresses, numbers without a plus sign, a phone number in a
   longer run of digits, IPv6). Positions come from the lengths of the matches
   and of what lies between them.
2. Labelers vote 1, 0 (abstain) or -1 on each candidate: the base rule, a strict
   rule, a gazetteer (top-level domains, card issuers, calling codes, reserved
   networks), the words before it, and the characters around it.
3. Expectation-maximisation estimates, per kind, each labeler's reliability: it
   works on the counts of vote patterns, of which there are at most 3^5 a kind.
4. The posteriors train the final span classifier, a logistic model on a span's
   shape, neighbours and votes; all of these are of few values, so its training
   input is a table of counts of bounded size.
5. Base spans stay; other candidates stay if the classifier accepts them and
   they overlap no base span.

A document's candidates are an array in its row, so nothing is shuffled but the
counts. A text without the character that a rule needs is not searched by it.

Edge cases: null and empty texts have no spans; repeated rows are handled each;
a null doc_id is kept; spans of equal start go by kind, then end; texts are searched
whole, whatever their length; columns of clashing names are not read, and returned
as they are; without any candidate the prior labelers' say is taken; an empty table
gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork import runtime
from braidwork.llm.common import table

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("base", "strict", "gazetteer", "context", "edges")

# The base rules. \G and the look-behinds only skip starts at which no leftmost
# match can begin, and possessive quantifiers only ways that cannot match, so
# matches are those of the plain rules in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[.\x20-]){3}[0-9]{4}(?![0-9])",
    "phone": r"\+[0-9]{1,3}[\x20-]?\([0-9]{3}\)[\x20-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])|(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}
WIDE_NEEDS = {"email": r"(?i)[\[(]at[\])]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[.\x20-][0-9]{4}[.\x20-][0-9]{4}[.\x20-][0-9]{4}", "phone": r"[0-9]{3}[.\x20-][0-9]{4}"}
# Gazetteers: fixed values, in natural order.
TLDS = "ai app at au be biz br ca ch cn co com de dev edu es eu fr gov ie in info int io it jp kr me mil mx net nl no nz org pl pt ru se uk us".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|64[4-9]|65|62)"
CUES = {
    "email": (r"(?i)(?:e-?mail|mail|contact|write to|correo|courriel|kontakt)\W*$", r"(?i)(?:git|ssh|import)\W*$"),
    "ip": (r"(?i)(?:\bip|host|server|address|from|ping|adresse)\W*$", r"(?i)(?:version|release|section|chapter|\bv)\W*$"),
    "card": (r"(?i)(?:card|visa|mastercard|credit|payment|karte|carte|tarjeta)\W*$", r"(?i)(?:isbn|order|invoice|tracking|serial|\bid)\W*$"),
    "phone": (r"(?i)(?:phone|tel|call|mobile|cell|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)\W*$", r"(?i)(?:isbn|order|invoice|version|\bid)\W*$"),
}
CONTEXT_CHARS = 24
#: The labelers' assumed reliabilities at the start of EM, and the share of true spans.
START = {"base": 0.9, "strict": 0.85, "gazetteer": 0.75, "context": 0.8, "edges": 0.7}
EM_ROUNDS = 50


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


#: Running sums go over chunks of so many matches: appending to an array copies it.
CHUNK = 64


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """start, end and text of all matches, in code points, for texts that `needs` occurs in."""
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")

    def paired(found: Column) -> Column:
        return F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("s")))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        last = first + F.length(x["s"])
        return F.struct(last.alias("at"), F.concat(acc["out"], F.array(F.struct(first.alias("start"), last.alias("end"), x["s"].alias("s")))).alias("out"))

    def chunked(pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda c: F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)))

    def placed(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda chunk: F.aggregate(chunk, F.lit(0), lambda acc, x: acc + x["gap"] + F.length(x["s"])))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(sizes, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(chunks, starts, lambda chunk, at: F.aggregate(chunk, F.struct(at.alias("at"), none.alias("out")), step)["out"]))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    whole = _let(found, lambda f: F.when(F.size(f) > 0, _let(paired(f), lambda p: _let(chunked(p), placed))).otherwise(none))
    return F.when(text.rlike(needs), whole).otherwise(none)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    digits = _digits(s)
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, 1).cast("int")
        return F.when((n - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + worth(i))
    return F.when(n.between(14, 19), total % 10 == 0).otherwise(False)


def _valid(kind: str, s: Column) -> Column:
    """The base rule's further conditions."""
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return _luhn(s)
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    no = ~yes if no is None else no
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, s: Column, base: Column, before: Column, after: Column) -> list[Column]:
    if kind == "email":
        strict = (F.length(s) <= 254) & s.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$")
        listed = _vote(F.lower(F.substring_index(s, ".", -1)).isin(TLDS))
    elif kind == "ip":
        strict = s.rlike(r"^(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})$|:")
        listed = _vote(s.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.|:"), s.rlike(r"^(?:0|22[4-9]|2[3-5][0-9])\."))
    elif kind == "card":
        strict = s.rlike(r"^[0-9]{15,16}$|^(?:[0-9]{4}[\x20-]){3}[0-9]{4}$|^[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}$") & _luhn(s)
        listed = _vote(s.rlike(ISSUERS))
    else:
        strict = s.rlike(r"^\+[0-9]{1,3}[\x20-]?(?:\([0-9]{2,4}\)[\x20-]?)?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,4}$|^\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[.-][0-9]{4}$")
        listed = _vote(s.rlike(r"^\+(?:" + "|".join(CALLING) + ")"), s.rlike(r"^\+0"))
    good, bad = CUES[kind]
    context = _vote(before.rlike(good), before.rlike(bad))
    edges = _vote(~before.rlike(r"[\p{L}\p{N}]$") & ~after.rlike(r"^[\p{L}\p{N}]"))
    return [_vote(base), _vote(strict), listed, context, edges]


def _shape(kind: str, s: Column) -> Column:
    """One of a few shapes of a span."""
    if kind == "email":
        return F.when(s.rlike("@[^@]*\\.[^@]*\\."), "deep").when(s.contains("@"), "plain").otherwise("spelled")
    if kind == "ip":
        return F.when(s.contains(":"), "six").otherwise("four")
    n = F.length(_digits(s))
    size = F.when(n < 10, "short").when(n <= 13, "middle").when(n <= 16, "long").when(n <= 19, "longer").otherwise("longest")
    return F.concat(size, F.when(s.rlike(r"[\x20().-]"), "-split").otherwise("-whole"), F.when(s.startswith("+"), "-plus").otherwise(""))


def _side(text: Column) -> Column:
    return F.when(text == "", "end").when(text.rlike(r"[\p{L}\p{N}]"), "word").when(text.rlike(r"\s"), "space").otherwise("mark")


def _described(text: Column, k: int, kind: str, wide: bool):
    def describe(m: Column) -> Column:
        s = m["s"]
        base = F.lit(False) if wide else _valid(kind, s)
        place = F.greatest(m["start"] - CONTEXT_CHARS, F.lit(0))
        around = F.substring(text, place + 1, m["end"] - place + 1)  # one walk to its place in the text
        return _let(F.struct(F.substring(around, F.lit(1), m["start"] - place).alias("before"), F.substring(around, m["end"] - place + 1, F.lit(1)).alias("after"), base.alias("base")), lambda x: told(m, x))

    def told(m: Column, x: Column) -> Column:
        s, before, after = m["s"], x["before"], x["after"]
        votes = F.concat_ws(",", *(v.cast("string") for v in _votes(kind, s, x["base"], before, after)))
        return F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), x["base"].alias("base"), votes.alias("votes"), _shape(kind, s).alias("shape"), _side(F.substring(before, -1, 1)).alias("left"), _side(after).alias("right"))

    return describe


def candidates(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the named columns and `spans`: all candidates with kind, place, base, votes, shape and sides."""
    text = F.col("__text")
    found = []
    for k, kind in enumerate(KINDS):
        base, wide = _matches(text, BASE[kind], NEEDS[kind]), _matches(text, WIDE[kind], WIDE_NEEDS[kind])
        if kind == "card":  # short runs of digits are no candidates
            base = F.filter(base, lambda m: F.length(m["s"]) >= 13)
        found.append(F.transform(base, _described(text, k, kind, False)))
        # a span that both rules find is one candidate and votes once
        wide = F.when(text.rlike(WIDE_NEEDS[kind]), F.array_except(wide, base)).otherwise(wide)
        found.append(F.transform(wide, _described(text, k, kind, True)))
    rows = docs.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("__text"))
    return rows.select("doc_id", *more, "__text", F.concat(*found).alias("spans"))


def pattern_counts(found: DataFrame) -> list[tuple]:
    """Counts of (kind, votes, shape, left, right): few by construction, whatever the input."""
    one = found.select(F.explode("spans").alias("x")).select("x.kind", "x.votes", "x.shape", "x.left", "x.right")
    return [tuple(r) for r in one.groupBy(*one.columns).count().collect()]


def estimate(counts: list[tuple]) -> tuple[dict, dict]:
    """EM over vote patterns. Returns the posterior of each (kind, votes) and each kind's reliabilities."""
    posterior, learnt = {}, {}
    for kind in range(len(KINDS)):
        weight: dict[str, float] = {}
        for k, votes, *_, n in counts:
            if k == kind:
                weight[votes] = weight.get(votes, 0) + n
        patterns = {v: [int(x) for x in v.split(",")] for v in weight}
        share = 0.5
        rates = {}  # [labeler][truth][vote]
        for j, name in enumerate(LABELERS):
            a = START[name]
            rates[j] = {1: {1: a, -1: 1 - a}, 0: {1: 1 - a, -1: a}}
        for _ in range(EM_ROUNDS):
            post = {}
            for v, votes in patterns.items():
                yes, no = math.log(share), math.log(1 - share)
                for j, x in enumerate(votes):
                    if x:
                        yes += math.log(rates[j][1][x])
                        no += math.log(rates[j][0][x])
                post[v] = 1 / (1 + math.exp(min(700, no - yes)))
            if not post:
                break
            total = sum(weight.values())
            share = min(0.98, max(0.02, (1 + sum(weight[v] * p for v, p in post.items())) / (2 + total)))
            for j, name in enumerate(LABELERS):
                a = START[name] * 10  # a prior of ten votes keeps what truth means
                for truth in (1, 0):
                    own = {x: sum(weight[v] * (p if truth else 1 - p) for v, p in post.items() if patterns[v][j] == x) for x in (1, -1)}
                    top, low = (a, 10 - a) if truth else (10 - a, a)
                    s = own[1] + own[-1] + 10
                    rates[j][truth] = {1: (own[1] + top) / s, -1: (own[-1] + low) / s}
        posterior |= {(kind, v): p for v, p in post.items()} if patterns else {}
        learnt[KINDS[kind]] = {"share": share, **{name: (rates[j][1][1], rates[j][0][-1]) for j, name in enumerate(LABELERS)}}
    return posterior, learnt


def _features(kind: int, votes: str, shape: str, left: str, right: str) -> list[str]:
    return [f"{kind}", f"{kind} {shape}", f"{kind} l {left}", f"{kind} r {right}", *(f"{kind} {name} {v}" for name, v in zip(LABELERS, votes.split(","), strict=True))]


def classifier(counts: list[tuple], posterior: dict, rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic model fit to the posteriors by weighted gradient descent."""
    weights: dict[str, float] = {}
    rows = [(_features(*row[:5]), posterior[row[0], row[1]], math.sqrt(row[5])) for row in counts]
    total = sum(n for *_, n in rows) or 1.0
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for names, target, n in rows:
            z = sum(weights.get(f, 0.0) for f in names)
            error = n / total * (1 / (1 + math.exp(-max(-30, min(30, z)))) - target)
            for f in names:
                slope[f] = slope.get(f, 0.0) + error
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) - rate * 8 * (g + decay * weights.get(f, 0.0))
    return weights


def accepted(weights: dict[str, float], counts: list[tuple]) -> dict[tuple, bool]:
    """The classifier's say on each description that occurs."""
    return {row[:5]: sum(weights.get(f, 0.0) for f in _features(*row[:5])) >= 0 for row in counts}


def train(docs: DataFrame) -> tuple[dict, dict]:
    """What the final classifier accepts, and the labelers' reliabilities."""
    counts = pattern_counts(candidates(docs))
    posterior, learnt = estimate(counts)
    return accepted(classifier(counts, posterior), counts), learnt


def _decide(spans: Column, accept: dict) -> tuple[Column, Column]:
    """The base spans, and all spans, each sorted by start, kind and end."""
    place = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter(spans, lambda x: x["base"]), place))
    yes = sorted("|".join(map(str, k)) for k, ok in accept.items() if ok)
    key = lambda x: F.concat_ws("|", x["kind"].cast("string"), x["votes"], x["shape"], x["left"], x["right"])
    if not yes:
        return base, base

    def every(own: Column) -> Column:
        more = F.filter(spans, lambda x: ~x["base"] & key(x).isin(yes) & ~F.exists(own, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        return F.array_sort(F.array_distinct(F.concat(own, F.transform(more, place))))

    return base, _let(base, every)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(found: DataFrame, accept: dict) -> DataFrame:
    base, every = _decide(F.col("spans"), accept)
    rows = found.select("doc_id", F.when(F.size("spans") > 0, base).otherwise(F.slice(base, 1, 0)).alias("base"), every.alias("every"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"))


def redact(docs: DataFrame, accept: dict) -> DataFrame:
    """docs with each span replaced by its kind in brackets; overlapping spans become one, of the first's kind.

    All columns are kept; n_chars, if there, is renewed where the text changes.
    """
    found = candidates(docs.withColumn("__whole", F.struct(*docs.columns)), "__whole")
    _, every = _decide(F.col("spans"), accept)
    rows = found.select("__whole", "__text", every.alias("__every"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(acc: Column, x: Column) -> Column:
        inside = x["start"] < acc["at"]
        gap = F.substring(F.col("__text"), acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.concat(gap, F.get(names, x["kind"]))))).alias("out"))

    done = F.aggregate(F.col("__every"), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)
    whole = F.col("__whole")
    rows = rows.select(whole, "__text", F.when(F.size("__every") > 0, done).alias("__done"))
    text = F.when(F.col("__done").isNull(), whole["text"]).otherwise(F.concat(F.array_join(F.col("__done.out"), ""), F.substring(F.col("__text"), F.col("__done.at") + 1, F.length("__text"))))
    rows = rows.select(whole, text.alias("__new"), F.col("__done").isNotNull().alias("__changed"))
    out = []
    for c in docs.columns:
        value = whole[c]
        if c == "text":
            value = F.col("__new")
        elif c == "n_chars":
            value = F.when(F.col("__changed"), F.length("__new").cast(dict(docs.dtypes)[c])).otherwise(value)
        out.append(value.alias(c))
    return rows.select(*out)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    found = runtime.written(candidates(table(spark, sf_dir, "documents")).drop("__text"), "pii")
    counts = pattern_counts(found)
    posterior, _ = estimate(counts)
    return digests(found, accepted(classifier(counts, posterior), counts))
