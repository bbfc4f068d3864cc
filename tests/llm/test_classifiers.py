import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import quality, toxicity
from tests.conftest import SMALL


def corpus(spark, n=400):
    rng = np.random.default_rng(0)
    good, bad = ["the cat sat on a mat", "rain falls over hills", "we walk and talk"], ["zz|zz|qq", "###!!###", "buy$$buy$$"]
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.6)
        rows.append((i, " ".join(rng.choice(good if y else bad) for _ in range(rng.integers(2, 20))), y, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, score string")


def test_subword_features_ignore_white_space_and_case():
    s = quality.Settings()
    f = lambda t: sorted(quality.features(np.frombuffer(t.encode(), np.uint8), s).tolist())
    assert f("The  cat\n") == f(" the cat")
    assert f("") == f(" \n") == []
    assert f("the cat") != f("the bat")


def test_quality_learns_and_takes_edges(spark):
    docs = corpus(spark)
    model = quality.fit(docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 <> 0").select("doc_id", "quality"))
    got = quality.score(docs, model).where("doc_id % 4 = 0").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in got]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "w " * 300_000)], "doc_id long, text string")
    scores = [r.score for r in quality.score(odd, model).collect()]
    assert len(scores) == 4 and all(0 <= x <= 1 for x in scores)
    assert quality.score(odd.limit(0), model).count() == 0
    none = quality.fit(docs, docs.select("doc_id", F.lit(None).cast("int").alias("quality")))
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}


def slow_buckets(text, s):
    """Buckets by plain Python: polynomial hashes of characters, each n and whole words apart."""
    one = (1 << 64) - 1

    def mix(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & one
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 & one
        return x ^ x >> 33

    found = []
    for word in text.split():
        word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)
        padded = f" {word} "
        for n in s.ngrams:
            for k in range(len(padded) - n + 1):
                if (gram := padded[k : k + n]).strip(" ") or n > 2:
                    h = 0
                    for c in gram:
                        h = (h * 0x9E3779B97F4A7C15 + mix(ord(c) + 257)) & one
                    found.append(mix(h + n & one) & s.buckets - 1)
        found.append(None)
    return [x for x in found if x is not None], sum(x is None for x in found)


def test_quality_scores_by_definition(spark):
    """The share of class 1 is the sigmoid of the mean weight of a text's features, words and n-grams by plain Python, and the bias."""
    s = quality.Settings()
    model = np.random.default_rng(4).normal(0, 2, s.buckets + 1).astype(np.float32)
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("aBcé日 .x") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 40))) for _ in range(40)] + ["word " * 80_000 + "end", "", None]
    one = (1 << 64) - 1

    def mix(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & one
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 & one
        return x ^ x >> 33

    def whole(word):
        h, power = 0, 0x9E3779B97F4A7C15
        for k, c in enumerate("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)):
            h = (h + mix(ord(c) + 257) * pow(power, k, 1 << 64)) & one
        return mix(h) & s.buckets - 1

    def slow_score(text):
        grams, memo = Counter(), {}
        for word, n in Counter((text or "").split()).items():
            if word not in memo:
                memo[word] = [*slow_buckets(word, s)[0], whole(word)]
            for b in memo[word]:
                grams[b] += n
        mean = sum(float(model[b]) * n for b, n in grams.items()) / sum(grams.values()) if grams else 0.0
        return 1 / (1 + math.exp(-max(-50, min(50, float(model[-1]) + mean))))

    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert got == {k: pytest.approx(slow_score(t), rel=1e-6) for k, t in enumerate(texts)}


def test_features_by_definition():
    s = quality.Settings()
    for text in ("The Cat", "é", "añb ßç üüü", "x", "a bb ccc dddd", "日本語 text"):
        grams, words = slow_buckets(text, s)
        got = quality.features(np.frombuffer(text.encode(), np.uint8), s).tolist()
        assert sorted(got[: len(got) - words]) == sorted(grams)
        assert len(set(got[len(got) - words :])) == len({w.lower() for w in text.split()})


def test_training_is_gradient_descent_on_the_loss():
    s = quality.Settings(buckets=64, dims=3, epochs=2, seed=5)
    texts, labels = [b"aa bb", b"cc dd", b"aa cc", b"bb"], [1, 0, 1, 0]
    model = quality.train(texts, labels, 0.5, s)
    rng = np.random.default_rng(5)
    v, out, bias = rng.uniform(-1 / 3, 1 / 3, (64, 3)), np.zeros((3, 2)), np.zeros(2)
    bags = [np.bincount(quality.features(np.frombuffer(t, np.uint8), s), minlength=64) for t in texts]

    def loss(v, out, bias, k):
        z = (bags[k] / bags[k].sum()) @ v @ out + bias
        return np.log(np.exp(z).sum()) - z[labels[k]]

    def slope(of, at):
        grad = np.zeros_like(at)
        for i in np.ndindex(at.shape):
            for sign in (1, -1):
                moved = at.copy()
                moved[i] += sign * 1e-6
                grad[i] += sign * of(moved) / 2e-6
        return grad

    done = 0
    for _ in range(2):
        for k in rng.permutation(4).tolist():
            left = 1 - done / 8
            done += 1
            gv, go, gb = slope(lambda x: loss(x, out, bias, k), v), slope(lambda x: loss(v, x, bias, k), out), slope(lambda x: loss(v, out, x, k), bias)  # noqa: B023
            v, out, bias = v - s.vector_rate * left * gv, out - s.rate * left * go, bias - s.rate * left * gb
    assert model[:-1] == pytest.approx(v @ (out[:, 1] - out[:, 0]), abs=1e-4)
    assert model[-1] == pytest.approx(bias[1] - bias[0], abs=1e-4)


def test_names_of_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "the cat", 5, 6), (2, None, 5, 6)], "doc_id long, text string, data int, _data int")
    out = quality.score(docs, np.zeros(quality.Settings().buckets + 1, np.float32)).collect()
    assert [(r.data, r._data, r.score) for r in out] == [(5, 6, 0.5)] * 2


def test_queries_give_the_contract_s_columns(spark):
    for query, least in ((toxicity.op2_toxicity_nearest, 0.5), (quality.op3_quality_subword, 0.3)):
        out = query(spark, SMALL)
        assert out.columns == ["doc_id", "held_out", "score", "predicted"]
        rows = out.collect()
        assert len(rows) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= least) and 0 <= r.score <= 1 for r in rows)


def test_long_texts_are_read_whole():
    data = np.frombuffer(b"word " * 200_000, np.uint8)
    assert sum(map(len, quality.pieces(data))) == len(data)


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    n_terms, settings = 30, toxicity.Settings(k=7, block=8)
    examples = [(sorted(rng.choice(n_terms, rng.integers(0, 6), replace=False).tolist()), None) for _ in range(150)]
    examples = [(t, rng.integers(1, 5, len(t)).tolist()) for t, _ in examples]
    index = toxicity.Index(rng.uniform(0.5, 3, n_terms), examples, rng.integers(0, 2, 150).tolist(), settings)
    dense = np.zeros((150, n_terms))
    for place, i in enumerate(index.source.tolist()):
        t, w = index.unit(*examples[i])
        dense[place, t] = w
    for q in examples[:60]:
        t, w = index.unit(*q)
        v = np.zeros(n_terms)
        v[t] = w
        cos = np.round(dense @ v, 10)
        want = [x for x in np.sort(cos)[::-1][:7] if x > 0]
        assert np.round(index.nearest(*q)[1], 10).tolist() == pytest.approx(want)


def test_seeker_counts_as_term_counts():
    text = "Idiot idiots, réeuxpa réeuxment x idiot idiot"
    every = toxicity.term_counts(text)
    assert every["idio-"] == 4 and every["réeu-"] == 2 and every["réeuxp-"] == 1
    chosen = ["idiot", "réeu-", "nothing", "idio-"]
    assert toxicity.Seeker(chosen)(text) == {t: n for t, n in every.items() if t in chosen}


def test_scores_match_brute_force(spark):
    rng = np.random.default_rng(8)
    words = [f"word{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words[:30] if i % 3 else words[10:], rng.integers(1, 25))) for i in range(90)] + ["", None, "word3 " * 5000]
    labels = {i: int(i % 3 == 0) for i in range(60)}
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in enumerate(texts)], "doc_id long, text string, _terms int, _y int")
    settings = toxicity.Settings(k=5, block=8)
    out = {r.doc_id: r for r in toxicity.scored(docs, spark.createDataFrame([*labels.items()], "doc_id long, toxic int"), settings=settings).collect()}
    counts = [toxicity.term_counts(t or "") for t in texts]
    vocabulary = sorted({t for i in labels for t in counts[i]})
    share = sum(labels.values()) / len(labels)
    weight = {}
    for t in vocabulary:
        df = sum(t in c for c in counts)
        a, c = (sum(t in counts[i] for i in labels if labels[i] == y) * 1000 / sum(v == y for v in labels.values()) for y in (1, 0))
        weight[t] = (np.log((1 + len(texts)) / (1 + df)) + 1) * np.log2(2 + a / max(1, c))
    vectors = []
    for c in counts:
        v = np.array([(1 + np.log(c[t])) * weight[t] if t in c else 0.0 for t in vocabulary])
        vectors.append(v / np.linalg.norm(v) if v.any() else v)
    points = []
    for i in range(len(texts)):
        near = sorted((round(float(vectors[i] @ vectors[j]), 9) for j in labels), reverse=True)[:5]
        near = [x for x in near if x > 0]
        assert [round(e.cosine, 9) for e in out[i].evidence] == pytest.approx(near, abs=1e-8)
        assert (out[i]._terms, out[i]._y) == (7, 8)
        if near:
            cos = np.array([e.cosine for e in out[i].evidence])
            points.append(((cos @ np.array([e.label for e in out[i].evidence]) + 0.05) / (cos.sum() + 0.1), np.log(out[i].score / (1 - out[i].score))))
    x, y = np.array(points).T
    slope, offset = np.polyfit(x, y, 1)
    assert slope > 0 and np.abs(slope * x + offset - y).max() < 1e-6  # the logistic of the distance-weighted vote
    assert out[90].score == out[91].score == pytest.approx((1e-3 * share) / 1e-3, rel=1e-6)


def test_toxicity_held_out_and_edges(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-2, ""), (None, "x " * 100_000)], "doc_id long, text string")
    out = toxicity.scored(docs.unionByName(odd), labels.where(~held)).collect()
    score = {r.doc_id: r.score for r in out}
    assert len(out) == docs.count() + 4 and all(0 <= s <= 1 for s in score.values())
    told = [(score[r.doc_id] >= 0.5, r.toxic) for r in labels.where(held).collect()]
    assert sum(p and not t for p, t in told) <= 1
    assert sum(p and t for p, t in told) >= 0.5 * sum(t for _, t in told)
    none = toxicity.scored(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.scored(odd.limit(0), labels).count() == 0


def test_every_term_and_example_is_searched(spark):
    rows = [(i, f"plain{i} words here", 0) for i in range(60)] + [(100 + i, f"nasty{i} words here", 1) for i in range(60)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    asked = [(200, "nasty7"), (201, "plain7"), (202, "unheard")]  # words of one example each, and of none
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + asked, "doc_id long, text string")
    out = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert out[200].evidence[0].label == 1 and out[201].evidence[0].label == 0
    assert out[200].score > out[202].score > out[201].score and not out[202].evidence
