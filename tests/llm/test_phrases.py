import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paceline.llm import phrases as P


def brute(rows, at_least=10, covered=50, first=2000, longest=3):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[k : k + m]) for k in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= at_least}
        most = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    most[p[k : k + m]] = max(most[p[k : k + m]], a)
        found = []
        for p, a in candidates.items():
            if 100 * most[p] < covered * a or not most[p]:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:first])]
    return sorted(out)


def got(spark, rows, **settings):
    df = spark.createDataFrame(rows, "lang string, text string")
    return sorted(tuple(r) for r in P.phrases(df, P.Settings(**settings)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed=1, docs=150, words=60):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "city", "big", "é", "ß", "x" * 40, "\u00a0", "a\u2028b", "-", "日本"] + [f"w{k}" for k in range(40)]
    rows = []
    for _ in range(docs):
        text = ""
        for _ in range(rng.randint(0, words)):
            text += rng.choice(["new york city", "the big", *rng.choices(vocabulary, k=6)]) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\x0b", "!?", " ; "])
        rows.append((rng.choice(["en", "fr", None, "und", ""]), text))
    return rows + [("en", None), ("en", ""), (None, " . "), ("en", "new york city " * 3000), ("de", "a b"), *[("fr", "same words here, again same words here")] * 15]


def test_against_brute_force(spark):
    rows = corpus(docs=700)
    want = brute(rows)
    assert len(want) > 50
    assert got(spark, rows) == want
    assert got(spark, rows, first=3) == brute(rows, first=3)


@pytest.mark.parametrize("changed", [{"keys": 7, "distinct": 5}, {"broadcast_words": 0, "chunk_bytes": 900}, {"broadcast_bytes": 3, "chunk_bytes": 1 << 20, "keys": 100}])
def test_small_buffers_and_chunks_give_the_same(spark, changed):
    rows = corpus(2, 80)
    assert got(spark, rows, at_least=4, **changed) == brute(rows, at_least=4)


@pytest.mark.parametrize("longest", [2, 5])
def test_other_lengths_and_wide_keys(spark, longest):
    rows = corpus(3, 60)
    want = brute(rows, at_least=5, longest=longest)
    assert got(spark, rows, at_least=5, longest=longest) == want
    assert got(spark, rows, at_least=5, longest=longest, long_bits=0) == want


def test_slices_of_a_long_text(monkeypatch):
    raw = b"ab cd. " * 50 + b"x" * 40 + b" y"
    assert b"".join(P.cut(raw, 9)) == raw and max(map(len, P.cut(raw, 9))) <= 50
    ids = {b"": -1, b"\n": 0, b"ab": 1, b"cd": 2, b"y": 3}
    whole = P.numbered(raw, ids)
    monkeypatch.setattr(P, "SLICE", 9)
    assert whole.tolist() == P.numbered(raw, ids).tolist() == [1, 2, 0] * 50 + [0, 3]


def test_layouts_agree(spark):
    ids = [np.array([1, 2, 1, 300]), np.array([1, 1, 5, 2]), np.array([3, 300, 1, 1])]
    for bits in (9, 30):
        layout = P.Layout(3, bits)
        assert layout.narrow == (bits == 9)
        keys = layout.packed(ids)
        assert np.argsort(keys, kind="stable").tolist() == [0, 2, 1, 3]
        assert layout.numpy(layout.arrow(keys).slice(1)).tolist() == keys[1:].tolist()
        pairs = layout.packed(ids[:2])
        df = spark.createDataFrame(pa.table({"key": layout.arrow(np.concatenate([keys, pairs])), "w": [1, 2, 1, 300] * 2}))
        rows = df.select(layout.words(df.key), layout.first(df.key, 2) == df.key, layout.first(df.key, 1) == layout.one(df.w)).collect()
        assert [tuple(r) for r in rows] == [(3, False, True)] * 4 + [(2, True, True)] * 4


def test_empty_and_clashing_columns(spark):
    assert got(spark, []) == [] and got(spark, [("en", "once only")]) == []
    df = spark.createDataFrame([(1, "en", "a b", 5, "x")] * 12, "key long, lang string, text string, n int, Word string")
    assert [tuple(r)[:4] for r in P.phrases(df).collect()] == [("en", 1, "a b", 12)]
