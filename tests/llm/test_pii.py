import random
import re

from paceline.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    found = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 12 <= len(pii.digits(m[0])) <= 19 and pii.luhn(pii.digits(m[0]))]
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(pii.digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_are_the_plain_patterns():
    rng = random.Random(3)
    for alphabet in ("a.@1 2+-3(", "0123456789. -", "+1 (2)34-", "a@.b@c.d"):
        for _ in range(3000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(text) == brute(text)


def test_spans_the_plain_patterns_miss():
    made = pii.model()
    kinds = lambda t: [(k, t[a:b]) for k, a, b, *_ in pii.find(t, made)]
    assert kinds("call +1 (269) 555-3296 4524132264652876 now") == [("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")]
    assert kinds("joe [at] mail [dot] com") == [("email", "joe [at] mail [dot] com")]
    assert kinds("plain words, 404189497460 and 2024-01-05") == []


def test_held_out_accuracy_of_the_trees():
    made, rng = pii.model(), random.Random(99)
    hit = wrong = missed = 0
    for _ in range(300):
        text, spans = pii.written(rng)
        got = {s[:3] for s in pii.find(text, made)}
        base = set(brute(text))
        hit += len(got & set(spans))
        wrong += len(got - set(spans) - base)
        missed += len([s for s in spans if s not in got])
    assert wrong <= 0.06 * hit
    assert missed <= 0.2 * (hit + missed)


def test_frame(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "mail a@b.co, x" + " w" * 50_000, 0), (3, "mail a@b.co, x" + " w" * 50_000, 0), (None, "1.2.3.4", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = {r.doc_id: r for r in pii.annotate(docs).collect()}
    assert out[1].redacted is None and out[1].spans == []
    assert out[3].redacted.startswith("mail [EMAIL], x w")
    assert out[None].redacted == "[IP]"
    assert pii.annotate(docs).count() == 5
    assert pii.annotate(docs.limit(0)).count() == 0


def test_linear_on_long_runs():
    made = pii.model()
    for text in ("a" * 200_000 + "@", "1" * 200_000, "@" * 100_000, "+1" * 50_000, "1." * 100_000, "a@b." * 50_000):
        pii.find(text, made)
