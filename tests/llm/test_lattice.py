import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from paceline.llm import lattice
from paceline.llm.common import id_remainder
from tests.conftest import SMALL

PATH = lattice.vocabulary_path()


def slow(model, word):
    """Sum over every way to cut the word, by definition."""
    first, further = ({w: k for w, k in t.items() if k >= 0} for t in (model.first, model.further))
    n, total = len(word), 0.0
    for cuts in itertools.product((0, 1), repeat=n):  # a cut before byte i; one before byte 0 means the empty first piece
        edges = [0, *(i for i in range(n) if cuts[i]), n]
        pieces = [word[a:b] for a, b in itertools.pairwise(edges)]
        ids = [first.get(pieces[0]), *(further.get(p) for p in pieces[1:])]
        if None in ids:
            continue
        p = 1.0
        for k in ids[:-1]:
            p *= model.on[k]
        total += p * model.last[ids[-1]]
    return total


def test_forward_recursion_sums_all_segmentations():
    model = lattice.Lattice(PATH)
    for word in (b"a", b"the", b"therein", "über".encode(), b"\xff\xfe", b"zq9!x"):
        assert math.exp(model.log_probability(word)) == pytest.approx(slow(model, word), rel=1e-9)


def test_log_space_for_long_words():
    model = lattice.Lattice(PATH)
    x, y = model.log_probability(b"ab" * 3000), model.log_probability(b"ab" * 6000)
    assert -math.inf < y < x < -700
    assert y / x == pytest.approx(2, rel=0.01)


def test_expected_counts_are_posteriors():
    model = lattice.Lattice(PATH)
    counts, stops = [0.0] * model.size, [0.0] * model.size
    model.expected(b"therein", counts, stops)
    assert sum(stops) == pytest.approx(1)
    assert sum(counts) >= 1


def test_training_raises_likelihood(spark):
    seen = [bytes([a, b, c]) + b"ing" for a in b"stw" for b in b"aeo" for c in b"nrl"]
    words = spark.createDataFrame([(w, 1) for w in seen], "word binary, c long")
    likelihood = [sum(map(lattice.Lattice(PATH, w).log_probability, seen)) for w in (None, lattice.train(words, PATH, 1), lattice.train(words, PATH, 3))]
    assert likelihood == sorted(likelihood)


def test_scores(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-2, ""), (None, "w" * 5000 + " x" * 2000)], "doc_id long, text string")
    every = docs.unionByName(odd)
    got = lattice.scored(every, id_remainder("doc_id", 10) != 0, PATH).collect()
    rows = [(r.doc_id, (r.text or "").encode().lower().split() + [None]) for r in every.collect()]
    c = Counter()
    for i, words in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            c.update(words)
    total, distinct = sum(c.values()), len(c)
    want = sorted((str(i), len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w), 4)) for i, w in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lattice.scored(every.limit(0), id_remainder("doc_id", 10) != 0, PATH).count() == 0


def test_document_scores_by_definition(spark):
    """Every word by all its segmentations and its own discounted count, every text as the product over its words and its end."""
    rng = np.random.default_rng(8)
    vocabulary = ["the", "cat", "sat", "on", "mat", "dog", "é", "thecat", "zq9"]
    rows = [(k, " ".join(rng.choice(vocabulary, rng.integers(0, 9), p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.08, 0.05, 0.04, 0.03]))) for k in range(60)] + [(100, "unseen xyz the"), (None, None), (101, "the the"), (101, "the the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learnt = id_remainder("doc_id", 10) != 0
    got = sorted((str(r.doc_id), r.score) for r in lattice.scored(docs, learnt, PATH).collect())
    words = lattice.word_counts(docs, learnt, "text")
    counts = {bytes(r.word): r.c for r in words.groupBy("word").agg({"c": "sum"}).withColumnRenamed("sum(c)", "c").collect()} if words.columns != ["word", "c"] else {bytes(r.word): r.c for r in words.collect()}
    total, seen = sum(counts.values()), Counter(counts.values())
    cuts = lattice.discounts({k: seen[k] for k in range(1, 5)})
    left = sum(cuts[min(c, 3) - 1] for c in counts.values() if c) / total
    own = lattice.Lattice(PATH, lattice.train(words, PATH, 1))

    def probability(word):
        known = (counts.get(word, 0) - cuts[min(counts[word], 3) - 1]) / total if counts.get(word) else 0.0
        return known if word == lattice.END else known + left * slow(own, word)

    want = sorted((str(i), sum(math.log10(probability(w)) for w in [*(t or "").encode().split(), lattice.END])) for i, t in rows)
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-6)
    clashing = docs.selectExpr("doc_id", "text", "1 as word", "2 as chunk", "3 as score", "4 as c", "5 as DATA")
    again = sorted((str(r.doc_id), r.score) for r in lattice.scored(clashing, learnt, PATH).collect())
    assert [i for i, _ in again] == [i for i, _ in got] and [x for _, x in again] == pytest.approx([x for _, x in got])


def test_long_words_teach_and_cost_in_proportion():
    import time

    own = lattice.Lattice(lattice.vocabulary_path())
    word = b"abcdefghij" * 4
    one, two = ([0.0] * own.size, [0.0] * own.size), ([0.0] * own.size, [0.0] * own.size)
    own.expected(word, *one)
    own.expected_long(own.arcs(word), *two)
    assert all(abs(a - b) < 1e-9 for x, y in zip(one, two, strict=True) for a, b in zip(x, y, strict=True))
    long = [0.0] * own.size, [0.0] * own.size
    own.expected(b"qzxj" * 300, *long)
    assert abs(sum(long[1]) - 1) < 1e-6 and sum(long[0]) > 100
    seconds = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        own.log_probability(b"q7Zx" * (n // 4))
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 12 * seconds[0]
