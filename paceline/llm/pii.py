"""Personal data: candidate spans scored by gradient-boosted trees.

Base spans (e-mail addresses, IP addresses, card and phone numbers in their plain formats) are found by
fixed patterns and always stay. High-recall generators propose further, overlapping spans: numbers that
the plain pattern ran together with a neighbour, national and spaced formats, spelled-out addresses.
Boosted trees score each proposal from its format and its context, and a calibrated threshold for each
kind decides which are added.

The trees are trained here, on texts with known spans that a seeded generator writes; no data of the
corpus is used, so the model is the same for every corpus. Finding spans is one map-only pass over
whole texts, in time linear in their length.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.llm.common import bounded_batches, read_table

# The kinds in the order that breaks ties, and the base patterns. The possessive forms match what the plain
# forms match, since no character of a repeat can start what follows it; they keep long runs of digits linear.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping matches of the base pattern: at each @ the run of local characters before it, the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            yield "ip", m.start(), m.end()


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(number := digits(m[0])) <= 19 and luhn(number):
            yield "card", m.start(), m.end()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    found = list(emails(text))
    if DIGIT.search(text):
        found += [*ips(text), *cards(text), *phones(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# The generators propose more than is personal: the trees decide.
GENERATORS = (
    ("card", re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ .\-/][0-9]{4}){2}[ .\-/][0-9]{1,7}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])3[0-9]{3}[ .-][0-9]{6}[ .-][0-9]{5}(?![0-9])")),
    ("phone", re.compile(r"\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,2}(?![0-9])")),
    ("phone", re.compile(r"\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])\([0-9]{2,4}\) ?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9.+-])(?:0|00[1-9])[0-9]{1,3}(?:[ ./-][0-9]{2,4}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9.+-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])")),
)
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}", re.I)
MARKED = re.compile(r"[\[({]at[\])}]| dot ", re.I)
HINTS = {
    "email": re.compile(r"mail|contact|write|reach", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login|from", re.I),
    "card": re.compile(r"card|visa|credit|debit|payment|pay|charge", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|number|cell", re.I),
}
AGAINST = re.compile(r"order|invoice|ref|token|password|key|hash|version|\bv\b|isbn|serial|sku|ticket|id\b|build|page|section", re.I)
AROUND = 32


def proposals(text: str) -> list[Span]:
    found: set[Span] = set()
    if DIGIT.search(text):
        for kind, pattern in GENERATORS:
            found.update((kind, m.start(), m.end()) for m in pattern.finditer(text))
    if MARKED.search(text):
        found.update(("email", m.start(), m.end()) for m in SPELLED.finditer(text))
    return sorted(found, key=lambda s: (s[1], s[2], s[0]))


FEATURES = (
    *(f"is_{k}" for k in KINDS), "digits", "length", "luhn", "separators", "kinds_of_separator", "plus", "bracket", "groups",
    "distinct_digits", "first_digit", "octets", "before_word", "after_word", "before_dot", "after_dot", "hint", "against", "hex_near",
    "marked_at", "marked_dot", "ends_in_letters",
)


def describe(text: str, span: Span) -> list[float]:
    """Format and context of one proposal, as numbers in the order of FEATURES."""
    kind, start, end = span
    own, number = text[start:end], digits(text[start:end])
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    marks = [c for c in own if not c.isalnum()]
    parts = re.split(r"\[?\.\]?", own)
    return [
        *(float(kind == k) for k in KINDS),
        len(number), len(own), float(bool(number) and luhn(number)), len(marks), len(set(marks)), float(own.startswith("+")), float("(" in own),
        len(re.findall(r"[0-9]+", own)), len(set(number)), float(number[:1] or -1),
        float(len(parts) == 4 and all(p.isdigit() and int(p) <= 255 for p in parts)),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in ".,-/=#\""), float(after[:1] in "-/=#\""),
        float(bool(HINTS[kind].search(before))), float(bool(AGAINST.search(before))),
        float(bool(re.search(r"[0-9a-f]{6,}$", before)) or bool(re.match(r"[0-9a-f]{6,}", after))),
        float(bool(re.search(r"[\[({]at[\])}]", own, re.I))), float(bool(re.search(r"[\[({ ]dot[\])} ]", own, re.I))),
        float(own[-2:].isalpha()),
    ]


@dataclass(frozen=True)
class Settings:
    texts: int = 2500
    trees: int = 40
    depth: int = 3
    rate: float = 0.25
    #: least share of true spans among those above a kind's threshold, on texts held back from the trees
    precision: float = 0.97
    seed: int = 11


def written(rng: random.Random) -> tuple[str, list[Span]]:
    """One made-up text with personal data and look-alikes; its true spans."""
    d = lambda n, low=0: str(rng.randint(max(low, 0), 9)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 1))
    word = lambda: "".join(rng.choice(["th", "er", "an", "re", "on", "ti", "es", "le", "qu", "sch"]) for _ in range(rng.randint(1, 4)))

    def number(n: int) -> str:
        body = rng.choice("3456") + d(n - 2)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def true() -> list[Span | str]:
        kind = rng.choice(KINDS)
        if kind == "card":
            x, sep = number(16), rng.choice([" ", "-", ".", "", ""])
            s = sep.join(x[i : i + 4] for i in range(0, 16, 4))
        elif kind == "phone":
            s = rng.choice([f"+1 ({d(3, 2)}) {d(3)}-{d(4)}", f"+{d(2, 1)} {d(3)} {d(3)} {d(3)}", f"({d(3, 2)}) {d(3)}-{d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"{d(3, 2)}-{d(3)}-{d(4)}", f"+{d(2, 1)}-{d(2)}-{d(4)}-{d(4)}"])
        elif kind == "ip":
            s = rng.choice([".", ".", "[.]"]).join(str(rng.randint(1, 255)) for _ in range(4))
        else:
            a, b, c = word(), word(), rng.choice(["com", "org", "net", "de", "example.com"])
            s = rng.choice([f"{a} [at] {b} [dot] {c}", f"{a}(at){b}.{c}", f"{a}.{d(2)} (at) {b} (dot) {c}", f"{a} at {b} dot {c}"])
        return [kind, s]

    def false() -> str:
        hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
        return rng.choice([
            lambda: d(rng.randint(10, 19), 1), lambda: f'token = "{hexed(40)}"', lambda: f"password={hexed(18)}", lambda: f"20{d(2)}-0{d(1, 1)}-{rng.randint(10, 28)}",
            lambda: f"v{d(1)}.{d(1)}.{d(2)}.{d(1)}", lambda: f"{d(1, 1)}.{d(3)}.{d(3)}.{d(3)}.{d(2)}", lambda: f"order {d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(3)} {d(3)} {d(4)} units",
            lambda: f"id {d(16, 1)}", lambda: f"invoice 0{d(3)}-{d(3)}-{d(4)}", lambda: f"met at {word()} dot {word()}", lambda: f"isbn {d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(1)}", lambda: f"{d(3)}-{d(2)}-{d(4)}",
            lambda: f"section {d(1)}.{d(1)}.{d(2)}.{d(1)}", lambda: "+" + d(3) + " " + d(3) + " " + d(3) + " " + d(4) + " " + d(4) + " " + d(4),
        ])()

    lead = {"card": ["card", "pay with", "visa"], "phone": ["call", "phone", "tel"], "ip": ["host", "ip", "login from"], "email": ["mail", "write to", "contact"]}
    text, spans = "", []
    for _ in range(rng.randint(2, 5)):
        text += " ".join(word() for _ in range(rng.randint(1, 8))) + rng.choice([" ", " ", ", ", ". "])
        for _ in range(rng.choice([1, 1, 1, 2])):
            if rng.random() < 0.55:
                kind, s = true()
                if rng.random() < 0.4:
                    text += rng.choice(lead[kind]) + " "
                spans.append((kind, len(text), len(text) + len(s)))
                text += s + " "
            else:
                text += false() + " "
    return text + word(), spans


class Trees:
    """Boosted regression trees for the log odds, on features cut at a few quantiles; numpy only."""

    def __init__(self, depth: int, rate: float):
        self.depth, self.rate, self.start, self.trees = depth, rate, 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int) -> Trees:
        share = min(0.99, max(0.01, float(y.mean())))
        self.start = float(np.log(share / (1 - share)))
        cuts = [(f, c) for f in range(x.shape[1]) for c in np.unique(np.quantile(x[:, f], np.linspace(0.03, 0.97, 24)))]
        above = np.stack([x[:, f] > c for f, c in cuts])
        margin = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            tree: dict[int, tuple[int, float] | float] = {}
            self._grow(tree, 1, np.ones(len(y), bool), above, cuts, g, h)
            self.trees.append(tree)
            margin += self.rate * self._walk(tree, x)
        return self

    def _grow(self, tree, node, rows, above, cuts, g, h) -> None:
        sum_g, sum_h = g[rows].sum(), h[rows].sum()
        tree[node] = float(sum_g / (sum_h + 1.0))
        if node >= 1 << self.depth or rows.sum() < 20:
            return
        hot = above[:, rows]
        right_g, right_h = hot @ g[rows], hot @ h[rows]
        left_g, left_h = sum_g - right_g, sum_h - right_h
        gain = right_g**2 / (right_h + 1) + left_g**2 / (left_h + 1) - sum_g**2 / (sum_h + 1)
        gain[(right_h < 1) | (left_h < 1)] = 0
        at = int(gain.argmax())
        if gain[at] <= 1e-6:
            return
        tree[node] = cuts[at]
        self._grow(tree, 2 * node, rows & ~above[at], above, cuts, g, h)
        self._grow(tree, 2 * node + 1, rows & above[at], above, cuts, g, h)

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x)), [(1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(tree[node], float):
                out[rows] = tree[node]
            else:
                f, c = tree[node]
                high = x[rows, f] > c
                todo += [(2 * node, rows[~high]), (2 * node + 1, rows[high])]
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum(self._walk(t, x) for t in self.trees)


@dataclass
class Model:
    trees: Trees
    slope: float
    offset: float
    thresholds: dict[str, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.margin(x) + self.offset, -50, 50)))


@lru_cache(maxsize=2)
def model(settings: Settings = Settings()) -> Model:
    """Trees from three quarters of the written texts; on the rest the scores are calibrated and each kind's threshold is
    the lowest that keeps the asked precision."""
    rng = random.Random(settings.seed)
    rows, truth, kinds, held = [], [], [], []
    for k in range(settings.texts):
        text, spans = written(rng)
        for span in proposals(text):
            rows.append(describe(text, span))
            truth.append(float(span in spans))
            kinds.append(span[0])
            held.append(k % 4 == 0)
    x, y, held, kind = np.array(rows), np.array(truth), np.array(held), np.array(kinds)
    trees = Trees(settings.depth, settings.rate).fit(x[~held], y[~held], settings.trees)
    margin, answer = trees.margin(x[held]), y[held]
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Platt scaling by Newton's method
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -50, 50)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - answer) * margin).sum() + 1e-3 * (slope - 1), (p - answer).sum()])
        hess = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        slope, offset = np.array([slope, offset]) - np.linalg.solve(hess, grad)
    made = Model(trees, float(slope), float(offset), {})
    p = made.probability(x[held])
    for k in KINDS:
        own = kind[held] == k
        order = np.argsort(-p[own], kind="stable")
        good = np.cumsum(answer[own][order]) / np.arange(1, own.sum() + 1) >= settings.precision
        made.thresholds[k] = max(0.5, float(p[own][order][np.flatnonzero(good)[-1]])) if good.any() else 2.0
    return made


def find(text: str, made: Model) -> list[tuple[str, int, int, bool, float]]:
    """All spans as (kind, start, end, base, score): base spans with score 1, and accepted proposals that overlap no base
    span and no accepted proposal of higher score."""
    base = base_spans(text)
    out = [(*s, True, 1.0) for s in base]
    taken = [(s, e) for _, s, e in base]
    free = [s for s in proposals(text) if all(s[2] <= a or s[1] >= b for a, b in taken)] if len(taken) < 200 else []
    if len(taken) >= 200:  # many spans: one sweep instead of all against all
        edges, k = sorted(taken), 0
        reach = np.maximum.accumulate([e for _, e in edges])
        starts = np.array([s for s, _ in edges])
        for s in proposals(text):
            k = int(np.searchsorted(starts, s[2], "left"))
            if k == 0 or reach[k - 1] <= s[1]:
                free.append(s)
    if free:
        p = made.probability(np.array([describe(text, s) for s in free], float))
        used: list[tuple[int, int]] = []
        for i in np.lexsort(([s[1] for s in free], -p)).tolist():
            kind, start, end = free[i]
            if p[i] < made.thresholds[kind]:
                continue
            at = bisect.bisect_left(used, (start, end))
            if (at == 0 or used[at - 1][1] <= start) and (at == len(used) or used[at][0] >= end):
                used.insert(at, (start, end))
                out.append((kind, start, end, False, float(p[i])))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redacted(text: str, spans: list[tuple[str, int, int, bool, float]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in square brackets."""
    out, done = [], 0
    for kind, start, end, *_ in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())]))


def annotate(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text", spans_col: str = "spans", redacted_col: str | None = "redacted") -> DataFrame:
    """``docs`` with ``spans_col`` (kind, start, end, base, score; code points, end exclusive) and, if named, ``redacted_col``.

    A null text counts as empty: no spans, and its redacted text stays null. Repeated rows and other columns stay; columns
    of the two result names are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    new = [c for c in (spans_col, redacted_col) if c]
    kept = docs.drop(spans_col) if redacted_col is None or redacted_col == text_col else docs.drop(spans_col, redacted_col)
    names = [c for c in kept.columns if c != redacted_col]
    sent = spark.sparkContext.broadcast(model(settings))
    source, at = kept.columns.index(text_col), [kept.columns.index(c) for c in names]
    schema = T.StructType([*(kept.schema[c] for c in names), T.StructField(spans_col, SPANS), *([T.StructField(redacted_col, T.StringType())] if redacted_col else [])])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sent.value
        for batch in batches:
            texts = batch.column(source).to_pylist()
            found = [find(x, made) if x else [] for x in texts]
            listed = pa.array([[dict(zip(("kind", "start", "end", "base", "score"), s, strict=True)) for s in own] for own in found], arrow)
            clean = [pa.array([redacted(x, own) if own else x for x, own in zip(texts, found, strict=True)], pa.string())] if redacted_col else []
            yield pa.RecordBatch.from_arrays([*map(batch.column, at), listed, *clean], [*names, *new])

    return kept.mapInArrow(run, schema)


def op7_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = annotate(read_table(spark, sf_dir, "documents").select("doc_id", "text"), redacted_col=None)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda k: F.filter(base, lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
