"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from a template. A page's tokens are its opening and
closing tags, told apart by their path of enclosing blocks, and its text nodes. Tokens with the same occurrence vector (how often they stand in each of
the host's pages) form an equivalence class; classes of at least MIN_TOKENS tokens
in at least MIN_PAGES pages and FREQUENT of the host's pages are the template's.
They nest by their paths: a template node lies in the slot of its nearest
enclosing template node. The texts of a slot over all pages tell what it is. The
main slot is found from the body down: as long as one container that stands once
in each page holds all running text that doesn't repeat over the host's pages, the
search goes into it. Of its slots those go of which all running text repeats over
the host's pages, and those beside an article that hold links alone. Texts that
stand once in each of a host's pages are template, too, wherever they are.

Names are but marks. A tag (nav, header, footer, aside, form) or a whole class name
marks a block as no main text, but never a block that holds most of the host's
running text, as a form around the page does, nor a header within an article. An
inline element is left out if a class name calls it an advert.

A vector is never held: its fingerprint is the xor of 64-bit hashes of (page,
count), twice, with its support and sum. So classes of a host of any size come
from one aggregation by (host, token) with partial sums in each batch; no task
sees all pages of a host. A host's template is bounded by the tokens that stand
in FREQUENT of its pages. Templates are broadcast if they are below
BROADCAST_BYTES together, else joined by (host, salt).

Edge cases: a null html is empty and gives ""; a null url is a host of its own;
hosts of fewer than MIN_PAGES pages, and pages that lack the main slot, are
judged by their own texts; repeated pages are all extracted; of slots with equal
text the first is entered; a html of any length is parsed whole; columns of clashing
names are not read; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork import runtime
from braidwork.llm.common import slices, table

MIN_PAGES, MIN_TOKENS, FREQUENT = 3, 3, 0.3
#: A text that stands once in each page of a host is template if the host has so many pages and it so many characters: short ones, as a formula, recur by chance.
CONSTANT_PAGES, CONSTANT_CHARS = 5, 20
#: A marked block that holds more than this share of the running text is main text.
SHARE = 0.5
BROADCAST_BYTES, SALTS = 32_000_000, 64

#: Blocks that stay beside the article though all their text is a link.
KEPT_CHILDREN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split())

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|textarea|title"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tspan tt u var wbr math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mtable mtr mtd".split())
CONTAINER = frozenset("body main article section div form td table tbody tr".split())
DROP_TAGS = frozenset("button select option menu dialog head".split())
MARK_TAGS = frozenset("nav header footer aside form".split())
#: No word in a class drops these.
NEVER = frozenset("html body main article".split())
#: Words in class or id attributes and roles that tell what isn't main text.
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer foot copyright cookie cookies consent notice alert popup modal newsletter subscribe signup login form search share sharing social "
    "related recommended comment comments reply replies disqus respond widget toolbar pagination pager contentinfo complementary".split()
)
#: Those of them that call an inline element an advert.
ADVERTS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo".split())
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    """A block of a page: its label, token, parent, whether it is dropped by a tag, marked by a tag or class name, in an article, and its running and linked characters."""

    __slots__ = ("article", "chars", "dropped", "label", "links", "marked", "name", "parent", "token")

    def __init__(self, name, label, token, parent, dropped, marked=False):
        self.name, self.label, self.token, self.parent, self.dropped, self.marked = name, label, token, parent, dropped, marked
        self.article = name == "article" or parent is not None and parent.article
        if name == "header" and self.article:  # the article's own
            self.marked = False
        self.chars = self.links = 0


def _label(name: str, attributes: str) -> tuple[str, bool, bool]:
    """The label, whether the tag drops the block, and whether a whole class name, id or role marks it as no main text."""
    drop, marked = name in DROP_TAGS, name in MARK_TAGS
    if not attributes or "=" not in attributes:
        return name, drop, marked
    marks = []
    for kind, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        # "ad-banner" is of such words alone, "has-sidebar" is not
        marked = marked or any((parts := WORD.findall(v)) and DROP_WORDS.issuperset(parts) for v in value.split())
        marks.append(f"{kind.lower()}={' '.join(sorted(value.split()))}")
    return " ".join([name, *sorted(marks)]), drop, marked and name not in NEVER


def _advert(attributes: str) -> bool:
    """Whether a whole class name, id or role calls an element an advert."""
    return "=" in attributes and any((parts := WORD.findall(v)) and ADVERTS.issuperset(parts) for _, *values in ATTRIBUTE.findall(attributes) for v in "".join(values).lower().split())


def parse(html: str, labels: dict) -> tuple[list[tuple[Node, str]], dict[tuple[str, int], int]]:
    """A page's blocks of text in order, each with its node, and its tokens' counts.

    Node objects are one for each opened block; blocks of equal path share a token.
    """
    root = Node("", "", 0, None, False)
    stack, texts, held = [root], [], []
    counts: dict[tuple[str, int], int] = defaultdict(int)
    linked = 0
    muted: list[str] = []  # the inline advert's open tags, and what it holds
    silent: list[str] = []

    def flush():
        if muted:  # it holds a block, so it is none
            held.extend(silent)
            muted.clear()
            silent.clear()
        if held:
            text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                node = stack[-1]
                node.chars += len(text)
                texts.append((node, text))
                counts["t", xxhash.xxh3_64_intdigest(text, node.token)] += 1

    def close(depth: int):
        flush()
        while len(stack) > depth:
            counts["c", stack.pop().token] += 1

    def add(text: str):
        if muted:
            silent.append(text)
            return
        held.append(text)
        if linked:
            stack[-1].links += len(text)

    at = 0
    for m in TAG.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        raw, end, name, attributes, end2, name2, attributes2 = m.groups()
        name = (name or name2 or "").lower()
        if raw or not name:
            continue
        if name == "a":
            linked = 0 if end or end2 else 1
        if name in INLINE:
            if muted and name == muted[0]:
                if not (end or end2):
                    muted.append(name)
                elif muted.pop() and not muted:
                    silent.clear()
            elif not muted and not (end or end2) and _advert(attributes or attributes2 or ""):
                muted.append(name)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                add(" ")
                if name == "hr":
                    flush()
            continue
        if end or end2:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    close(depth)
                    break
            else:
                flush()
            continue
        flush()
        if stack[-1].name == "p" and name in CLOSES_P or stack[-1].name == name and name in ("li", "tr", "td", "th", "dt", "dd", "option"):
            close(len(stack) - 1)
        key = (name, attributes or attributes2 or "")
        found = labels.get(key)
        if found is None:
            if len(labels) > 10_000:
                labels.clear()
            found = labels[key] = _label(*key)
        parent = stack[-1]
        node = Node(name, found[0], xxhash.xxh3_64_intdigest(found[0], parent.token), parent, parent.dropped or found[1], found[2])
        counts["o", node.token] += 1
        stack.append(node)
    if at < len(html):
        rest = html[at:]
        cut = re.search(r"<[A-Za-z/!?][^>]*\Z", rest)  # a tag that the page's end cuts off
        add(rest[: cut.start()] if cut else rest)
    close(1)
    flush()
    return texts, counts


def lineage(node: Node) -> list[Node]:
    out = []
    while node.parent is not None:
        out.append(node)
        node = node.parent
    return out[::-1]


def running(node: Node, text: str) -> int:
    return 0 if node.dropped else max(0, len(text) - node.links)


def find_main(nodes: dict[int, tuple], repeated: dict[int, int]) -> tuple[int, frozenset, frozenset]:
    """The main slot's token, from the body down, the marked tokens that are kept, and the main slot's children to leave out.

    nodes: token -> (parent token, name, dropped, marked, running characters in it
    that are neither dropped nor marked, those that aren't dropped, whether it
    stands once in a page). repeated: token -> its own running characters that
    repeat over the host's pages.
    """
    inner = defaultdict(list)
    for token, (parent, *_) in nodes.items():
        inner[parent].append(token)
    total = sum(nodes[t][5] for t in inner[0])
    kept = frozenset(t for t, n in nodes.items() if n[3] and not n[2] and n[5] > SHARE * total)
    whole = {t: n[4] for t, n in nodes.items()}

    def above(t: int):
        while t:
            yield t
            t = nodes[t][0]

    for t in nodes:
        if not kept.isdisjoint(up := list(above(t))):
            whole.update((u, nodes[u][5]) for u in up)
    fresh = dict(whole)
    for t, chars in repeated.items():
        if not any(nodes[u][3] and u not in kept for u in above(t)):
            for u in above(t):
                fresh[u] = max(0, fresh[u] - chars)
    if not any(fresh.values()):  # every page is the same: nothing tells the article
        fresh = whole
    fresh[0] = sum(fresh[t] for t in inner[0])
    at = 0
    while True:
        good = [t for t in inner[at] if nodes[t][6] and not nodes[t][2] and (not nodes[t][3] or t in kept) and (nodes[t][1] in CONTAINER or nodes[t][1] == "html")]
        best = max(good, key=lambda t: (fresh[t], -t), default=None)
        if best is None or not fresh[best] or fresh[best] < fresh[at]:
            break
        at = best
    within = any(nodes[t][1] in ("article", "main") for t in above(at))
    return at, kept, frozenset(t for t in inner[at] if not fresh[t] and (whole[t] or not within and nodes[t][1] not in KEPT_CHILDREN))


def own_nodes(texts: list[tuple[Node, str]]) -> dict[int, tuple]:
    """The nodes that hold text, as find_main wants them, from one page alone."""
    out: dict[int, tuple] = {}
    seen: dict[int, set] = defaultdict(set)
    for node, text in texts:
        own, up = running(node, text), lineage(node)
        plain = 0 if any(n.marked for n in up) else own
        for n in up:
            seen[n.token].add(id(n))
            parent, name, dropped, marked, chars, held, _ = out.get(n.token, (n.parent.token, n.name, n.dropped, n.marked, 0, 0, True))
            out[n.token] = (parent, name, dropped, marked, chars + plain, held + own, len(seen[n.token]) == 1)
    return out


def main_text(texts: list[tuple[Node, str]], found: tuple | None, constant: frozenset = frozenset()) -> str:
    """The text of the main slot, without the template's constant texts; without a main slot, of the page's own."""
    paths = [lineage(node) for node, _ in texts]
    if found is None or not any(n.token == found[0] for up in paths for n in up):
        loose = any(not up for up in paths)
        found = find_main(own_nodes(texts), {})
        found = (0, found[1], frozenset()) if loose else found
    main, kept, left = found
    own = [(node, text) for (node, text), up in zip(texts, paths, strict=True) if not node.dropped and (main == 0 or any(n.token == main for n in up)) and not any(n.marked and n.token not in kept or n.token in left for n in up)]
    slots = [text for node, text in own if xxhash.xxh3_64_intdigest(text, node.token) not in constant] if constant else []
    return " ".join(slots or (text for _, text in own))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def host_column() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


TOKENS = "host string, kind string, token long, parent long, name string, dropped boolean, marked boolean, support long, total long, chars long, held long, x long, y long"


def token_statistics(pages: DataFrame) -> DataFrame:
    """Per host and token, over all pages: support, total, running characters and the vector's fingerprint."""

    def count(batches):
        labels: dict = {}
        for batch in batches:
            for own in slices(batch, "html", 8_000_000):
                sums: dict[tuple, list] = {}
                for host, key, page in zip(own["host"].to_pylist(), own["page"].to_pylist(), own["html"].to_pylist(), strict=True):
                    texts, counts = parse(page, labels)
                    counts["#", 0] = 1
                    about: dict[tuple, list] = {}
                    for node, text in texts:
                        own, up = running(node, text), lineage(node)
                        plain = 0 if any(n.marked for n in up) else own
                        for n in up:
                            a = about.setdefault(("o", n.token), [n.parent.token, n.name, n.dropped, n.marked, 0, 0])
                            a[4] += plain
                            a[5] += own
                        a = about.setdefault(("t", xxhash.xxh3_64_intdigest(text, node.token)), [node.token, "", False, False, 0, 0])
                        a[4] += own
                        a[5] += own
                    for (kind, token), c in counts.items():
                        s = sums.setdefault((host, kind, token), [0, "", False, False, 0, 0, 0, 0, 0, 0])
                        a = about.get((kind, token))
                        if a:
                            s[:4] = a[:4]
                            s[6] += a[4]
                            s[7] += a[5]
                        s[4] += 1
                        s[5] += c
                        h = xxhash.xxh3_128_intdigest(f"{key} {c}")
                        s[8] ^= h & (1 << 64) - 1
                        s[9] ^= h >> 64
                flat = [(host, kind, signed(token), signed(s[0]), *s[1:8], signed(s[8]), signed(s[9])) for (host, kind, token), s in sums.items()]
                if flat:
                    names = ("host", "kind", "token", "parent", "name", "dropped", "marked", "support", "total", "chars", "held", "x", "y")
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(pa.array, zip(*flat, strict=True)), strict=True)))

    rows = pages.select(host_column().alias("host"), F.xxhash64("page_id", "url").alias("page"), F.coalesce("html", F.lit("")).alias("html"))
    found = rows.mapInArrow(count, TOKENS)
    return found.groupBy("host", "kind", "token").agg(
        F.max("name").alias("name"), F.max_by("parent", "name").alias("parent"), F.max_by("dropped", "name").alias("dropped"), F.max_by("marked", "name").alias("marked"),
        F.sum("support").alias("support"), F.sum("total").alias("total"), F.sum("chars").alias("chars"), F.sum("held").alias("held"), F.expr("bit_xor(x)").alias("x"), F.expr("bit_xor(y)").alias("y"),
    )


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """One row for each host that has a template: host, nodes (its opening tags, nested by parent, and its repeated texts)."""
    # written, as three parts of the plan read it; most tokens stand in few pages and are gone by now
    often = runtime.written(token_statistics(pages).filter(F.col("support") >= min_pages), "tokens")
    hosts = often.filter("kind = '#'").select("host", F.col("support").alias("n_pages"))
    often = often.filter("kind <> '#'").join(hosts, "host").filter(F.col("support") >= FREQUENT * F.col("n_pages"))
    vector = ["host", "support", "total", "x", "y"]
    valid = often.groupBy(*vector).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_tokens).drop("size")
    # a text repeats or not, whatever class it is of
    nodes = often.filter("kind = 'o' and name <> ''").join(valid, vector, "left_semi").unionByName(often.filter("kind = 't' and chars + held > 0"))
    once = F.col("support") == F.col("total")
    node = F.struct("kind", "token", "parent", "name", "dropped", "marked", "chars", "held", once.alias("once"), (once & (F.col("support") == F.col("n_pages")) & (F.col("n_pages") >= CONSTANT_PAGES) & (F.col("held") >= CONSTANT_CHARS * F.col("support"))).alias("every"))
    return nodes.groupBy("host").agg(F.sort_array(F.collect_list(node)).alias("nodes"))


def main_of(nodes: list[dict]) -> tuple[int, frozenset, frozenset] | None:
    """find_main of a host's template, None if its body isn't in it."""
    whole = lambda t: t & (1 << 64) - 1
    by = {n["token"]: n for n in nodes if n["kind"] == "o"}
    tree = {whole(t): (whole(n["parent"]) if n["parent"] in by else 0, n["name"], n["dropped"], n["marked"], n["chars"], n["held"], n["once"]) for t, n in by.items()}
    repeated: dict[int, int] = defaultdict(int)
    for n in nodes:
        if n["kind"] == "t" and n["parent"] in by:
            repeated[whole(n["parent"])] += n["chars"]
    found = find_main(tree, repeated)
    return found if found[0] else None


def constants(nodes: list[dict]) -> frozenset:
    """The texts that stand once in each page of a host, unless they are all of its text."""
    texts = [n for n in nodes if n["kind"] == "t"]
    return frozenset(n["token"] & (1 << 64) - 1 for n in texts if n["every"])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text and n_chars of every page, and the main slot's token (null: the page's own)."""
    found = runtime.written(templates(pages, min_pages), "templates")
    size = found.select(F.sum(40 + F.size("nodes") * 64)).first()[0] or 0
    kinds = dict(pages.dtypes)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_column().alias("host"))
    if size <= broadcast_bytes:
        rows = rows.join(F.broadcast(found), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", salt).join(salted, ["host", "salt"], "left").drop("salt")

    def read(batches):
        labels, known = {}, {}
        for batch in batches:
            out, mains = [], []
            for host, page, nodes in zip(batch["host"].to_pylist(), batch["html"].to_pylist(), batch["nodes"], strict=True):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                    own = nodes.as_py() or []
                    known[host] = main_of(own), constants(own)
                texts, _ = parse(page, labels)
                main, constant = known[host]
                out.append(main_text(texts, main, constant))
                mains.append(None if main is None else signed(main[0]))
            yield pa.RecordBatch.from_pydict({"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64()), "main_slot": pa.array(mains, pa.int64())})

    return rows.select("page_id", "url", "html", "host", "nodes").mapInArrow(read, f"page_id {kinds['page_id']}, url string, text string, n_chars long, main_slot long")


def op4_template(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
