import hashlib
import random
import re

from braidwork.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(d) for d in digits[::-1]]
    return sum(values[0::2] + [2 * d - 9 if d > 4 else 2 * d for d in values[1::2]]) % 10 == 0


def base(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def check(got, rows):
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text in rows:
        want, r = base(text), by[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (text or "")[:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in RULES]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        key = lambda s: (int(s.split(":")[1]), list(RULES).index(s.split(":")[0]))
        assert spans == sorted(spans, key=key)


def run(df):
    found = pii.candidates(df)
    counts = pii.pattern_counts(found)
    posterior, learnt = pii.estimate(counts)
    return pii.digests(found, pii.accepted(pii.classifier(counts, posterior), counts)).collect(), learnt


SPECIAL = [
    None, "", "a@b.c_d@e.f", "x@y@z.com.", "é🙂 bob@mail.example.com, 1.2.3.4.5.6.7.8 999.1.1.1 000.0.00.255",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "call +1 (269) 555-3296 4524132264652876", "+1 (269) 555-3296.", "tel: 415-555-1234 ok",
    "bob [at] example [dot] com", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "+", "@", "a@", "1.2.3", "+1          ", "|".join(["a@b.cc"] * 50),
]


def test_spans(docs):
    rng = random.Random(7)
    rows = list(enumerate(SPECIAL))
    parts = ["bob@x.org", "a.b@c", "@", ".", "10.0.0.1", "256.1.1.1", "4111111111111111", "1234 5678 9012 3456", "+49 (30) 1234-5678", " ", "-", "é", "🙂", "7", "word", "\n", "+1", "(555)"]
    rows += [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 30)))) for i in range(400)]
    got, _ = run(docs(rows))
    check(got, rows)
    by = {r.doc_id: r.spans for r in got}
    assert by[6].startswith("phone:5:22")


def test_long_texts(docs):
    rows = [(1, "9" * 100_000), (2, "9 " * 50_000), (3, "a" * 10_000 + "@"), (4, "a@" + "b." * 5_000), (5, "1." * 8_000), (6, "+1" + " " * 50_000), (7, "a." * 5_000 + "@x.yy"), (8, "0-" * 20_000), (9, "x " * 60_000 + "q@r.st")]
    got, _ = run(docs(rows))
    check(got, rows)


def test_redact(docs):
    rows = [(1, "mail bob@x.org or 10.0.0.1!"), (2, None), (3, ""), (4, "clean"), (4, "clean"), (None, "a@b.cc")]
    df = docs(rows)
    accept, learnt = pii.train(df)
    out = pii.redact(df, accept)
    assert out.dtypes == df.dtypes
    got = sorted(((r.doc_id, r.text, r.n_chars, r.block) for r in out.collect()), key=str)
    want = [(1, t := "mail [EMAIL] or [IP]!", len(t), "clash"), (2, None, None, "clash"), (3, "", 0, "clash"), (4, "clean", 5, "clash"), (4, "clean", 5, "clash"), (None, "[EMAIL]", 7, "clash")]
    assert got == sorted(want, key=str)
    assert set(learnt) == set(pii.KINDS)


def test_em_tells_reliable_labelers():
    rng, counts = random.Random(1), {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        votes = ",".join(str(1 if (rng.random() < a) == truth else -1) for a in (0.95, 0.9, 0.8, 0.6, 0.7))
        counts[votes] = counts.get(votes, 0) + 1
    _, learnt = pii.estimate([(0, v, "plain", "space", "space", n) for v, n in counts.items()])
    r = learnt["email"]
    assert abs(r["share"] - 0.4) < 0.05
    assert r["base"][0] > r["gazetteer"][0] > r["context"][0]


def test_empty(docs):
    got, _ = run(docs([]))
    assert got == []


def test_native(docs):
    plan = pii.candidates(docs([(1, "a@b.cc")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_one_vote_a_span(docs):
    """A span that the base and the wide rule both find is one candidate."""
    rows = [(1, "call +1 (555) 123-4567 or (555) 765-4321, card 4111 1111 1111 1111, at 4111-1111-1111-1112.")]
    spans = [(s.kind, s.start, s.end, s.base) for s in pii.candidates(docs(rows)).first().spans]
    assert len({s[:3] for s in spans}) == len(spans)
    assert any(s[0] == 3 and s[3] for s in spans) and any(s[0] == 3 and not s[3] for s in spans)
