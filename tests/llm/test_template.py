import random

import pytest

from braidwork.llm import template

WORDS = "river stone & tree walk lamp quiet été".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def page(rng, kind, i):
    parts = [prose(rng, rng.randrange(20, 60)) for _ in range(rng.randrange(1, 6))]
    body = "".join(f"<p>{p.replace('&', '&amp;')}</p>\n" for p in parts)
    links = "".join(f'<li><a href="/{w}">{prose(rng, 6)}</a></li>' for w in "abcd")
    if kind == "article":
        html = f'<html><head><title>t {i}</title><script>var t="</p><p>no";</script></head><body><nav><ul>{links}</ul></nav><!-- <p>no</p> --><div class="ad">{prose(rng, 5)}</div><article>{body}</article><footer>&copy; x</footer></body></html>'
    else:  # no name tells what is what
        html = f'<html><body><div class="x1"><ul>{links}</ul></div><div class="x2"><div class="x3">{body}</div></div><div class="comments"><p>{prose(rng, 30)}</p></div><div class="x4">always the same</div></body></html>'
    return html, " ".join(" ".join(p.split()) for p in parts)


def table(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'clash' as host", "'clash' as text", "'clash' as nodes", "1 as token", "'clash' as salt")


@pytest.mark.parametrize("limit", [template.BROADCAST_BYTES, -1])
def test_slots(spark, docs, limit):
    rng, rows, want = random.Random(2), [], {}
    for i in range(60):
        kind = "article" if i % 2 else "plain"
        html, want[i] = page(rng, kind, i)
        rows.append((i, f"http://{kind}.example.com/{i}", html))
    got = {r.page_id: r for r in template.extract(table(spark, rows), broadcast_bytes=limit).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) and r.main_slot is not None for r in got.values())


def test_single_pages_and_edges(spark, docs):
    rng = random.Random(3)
    html, want = page(rng, "article", 0)
    rows = [
        (1, "http://one.example.com/", html),
        (2, None, None),
        (None, "http://x.example.com/", ""),
        (4, "no url", "just text &lt;b&gt;"),
        (5, "http://y.example.com/", html[: html.index("</article>")]),
        (6, "http://z.example.com/", "<div><p>a<b>b</b>c<br>d<p>e</div><script>x"),
        (6, "http://z.example.com/", "<div><p>a<b>b</b>c<br>d<p>e</div><script>x"),
        (7, "http://w.example.com/", "<p>" + "long " * 50_000),
        (8, "http://v.example.com/", "<" * 2000 + '<a href="'),
        (9, "http://u.example.com/", "<div>" * 3000 + "deep"),
    ]
    got = {}
    for r in template.extract(table(spark, rows)).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[1] == [want] and got[2] == [""] and got[None] == [""]
    assert got[4] == ["just text <b>"] and got[5] == [want]
    assert got[6] == ["abc d e"] * 2
    assert got[7] == [("long " * 50_000).strip()] and got[9] == ["deep"] and len(got[8]) == 1


def test_class_names_and_siblings(spark, docs):
    """A word within a class name drops no article, and differing text beside the largest block stays."""
    rng, rows, want = random.Random(8), [], {}
    say = lambda n: prose(rng, n).replace("&", "and")
    for i in range(40):
        a, b, c = say(40), say(90), say(20)
        kinds = {
            "sidebar": (f'<body class="has-sidebar"><div class="content with-sidebar"><p>{b}</p></div><div class="ad-banner">{c}</div></body>', b),
            "open": (f'<body><article class="post comments"><p>{b}</p><figure><figcaption>{c}</figcaption></figure><p><math><mi>x</mi></math></p></article></body>', f"{b} {c} x"),
            "most": (f'<body><div id="content" class="notice"><p>{b}</p></div><div class="comments">{c}</div></body>', b),
            "intro": (f'<body><div class="x2"><div class="intro">{a}</div><div class="x3">{b}</div></div><div class="x4">{"always the same words " * 5}</div></body>', f"{a} {b}"),
            "lead": (f"<body><h1>{c}</h1><article><p>{b}</p></article></body>", f"{c} {b}"),
        }
        for k, (kind, (html, text)) in enumerate(kinds.items()):
            for host, n in (("many", 40), ("few", 1)):
                if i < n and not (host == "few" and kind == "intro"):
                    key = i * 100 + k * 10 + n % 7
                    rows.append((key, f"http://{kind}.{host}.example.com/{i}", f"<html>{html}</html>"))
                    want[key] = text
    got = {r.page_id: r.text for r in template.extract(table(spark, rows)).collect()}
    assert {k: (got[k], w) for k, w in want.items() if got[k] != w} == {}


def test_marks_are_no_verdicts(spark, docs):
    """A form around the page, an article's own header, figures, maths and drawings stay; inline adverts go."""
    rng, rows, want = random.Random(11), [], {}
    say = lambda n: prose(rng, n).replace("&", "and")
    for i in range(20):
        a, b, c = say(60), say(50), say(6)
        kinds = {
            "form": (f'<body><form id="aspnetForm"><nav><a href="/">x</a></nav><div class="x1"><p>{a}</p></div><footer>{c}</footer></form></body>', a),
            "header": (f"<body><header>{say(4)}</header><article><header><h1>{c}</h1></header><p>{a}</p><footer>{say(5)}</footer></article></body>", f"{c} {a}"),
            "inline": (f'<body><article><p>{a}<span class="advert">buy <span>now</span></span> {b}</p><p><span class="ad"><div>{c}</div></span></p></article></body>', f"{a} {b} {c}"),
            "svg": (f"<body><article><p>{a}</p><figure><svg><title>t</title><text>{c}</text></svg></figure></article></body>", f"{a} {c}"),
        }
        for k, (kind, (html, text)) in enumerate(kinds.items()):
            rows.append((i * 10 + k, f"http://{kind}.example.com/{i}", f"<html>{html}</html>"))
            want[i * 10 + k] = text
            rows.append((1000 + i * 10 + k, f"http://{kind}-{i}.example.com/", f"<html>{html}</html>"))  # a host of one page
            want[1000 + i * 10 + k] = text
    got = {r.page_id: r.text for r in template.extract(table(spark, rows)).collect()}
    assert {k: (got[k], w) for k, w in want.items() if got[k] != w} == {}


def test_the_template_decides(spark, docs):
    """No name tells what is what: repeated slots and constant lines go by the template alone, and stay without it."""
    rng, rows, want = random.Random(12), [], {}
    for i in range(30):
        a, b = (prose(rng, 40).replace("&", "and") for _ in range(2))
        menu = "".join(f'<a href="/{w}">{w}</a> ' for w in "abcd")
        rows.append((i, f"http://h.example.com/{i}", f'<html><body><div class="q1">{menu}</div><div class="q2">Our house rules are the same on every page of ours.</div><div class="q3"><div class="q4"><p>{a}</p><p>Read on in the next issue.</p><p>{b}</p></div><div class="q5">Told by the same hand as ever.</div></div></body></html>'))
        want[i] = f"{a} {b}"
    got = {r.page_id: r.text for r in template.extract(table(spark, rows)).collect()}
    assert got == want
    without = {r.page_id: r.text for r in template.extract(table(spark, rows), min_pages=1000).collect()}
    assert all(without[i] != w and "same hand" in without[i] and "house rules" in without[i] for i, w in want.items())


def test_equal_pages_keep_their_text(spark, docs):
    """Where all pages of a host are one, nothing is template."""
    rows = [(i, "http://h.example.com/", "<html><body><article><p>one text</p><p>another text</p></article></body></html>") for i in range(8)]
    assert {r.text for r in template.extract(table(spark, rows)).collect()} == {"one text another text"}


def test_classes_match_brute_force(spark, docs):
    """Tokens share a class if and only if their counts agree on every page."""
    rng, pages = random.Random(5), []
    for i in range(20):
        pages.append((i, "http://h.example.com/", "<body>" + "<div>" * (k := rng.randrange(1, 3)) + "</div>" * k + "<p>x</p>" * rng.randrange(1, 3) + "<h1>t</h1></body>"))
    vectors = {}
    for i, _, html in pages:
        for token, c in template.parse(html, {})[1].items():
            vectors.setdefault(token, {})[i] = c
    got = {}
    for r in template.token_statistics(table(spark, pages)).filter("kind <> '#'").collect():
        got.setdefault((r.x, r.y, r.support, r.total), set()).add((r.kind, r.token & (1 << 64) - 1))
    want = {}
    for token, vector in vectors.items():
        want.setdefault(tuple(sorted(vector.items())), set()).add(token)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_empty(spark, docs):
    assert template.extract(table(spark, [])).count() == 0
