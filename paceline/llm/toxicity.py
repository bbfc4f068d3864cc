"""Toxicity by nearest labelled examples.

A bounded sample of labelled rows gives the examples; every term of an example is a term of the index, so
the vocabulary is bounded by the sample. Every document is turned, once, into its counts of those terms; document
frequencies are counted over all documents. A term weighs by its frequency in the text, its inverse document
frequency, and its relevance frequency (how much more of the examples of class 1 than of class 0 hold it, a
supervised factor that is never zero). The nearest examples by exact cosine of these vectors are found with an
inverted index in blocks: rare terms have postings, terms of many examples a row of weights in each block and the
largest of it. A block whose bound can't reach the k-th best cosine so far is skipped, which never changes
the result. Votes weigh by cosine; the vote is turned into a probability by logistic calibration on the
examples themselves, each scored without itself.

The index is bounded by the sample, so the job is two map-only passes and some small aggregates.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import bounded_batches, id_remainder, read_table, stored, text_or_empty, unused
from paceline.llm.quality import label_sample


@dataclass(frozen=True)
class Settings:
    #: labelled rows of each class that become examples, at most: those whose hashed ids are smallest
    per_class: int = 2000
    k: int = 31
    block: int = 64


WORD = re.compile(r"\w+")


#: Lengths of the word beginnings that are terms as well.
HEADS = (4, 6)


def term_counts(text: str) -> dict[str, int]:
    """Counts of words and of word beginnings (written ``abcd-``)."""
    counts: dict[str, int] = {}
    for word, n in Counter(WORD.findall(text.lower())).items():
        counts[word] = counts.get(word, 0) + n
        for k in HEADS:
            if len(word) > k:
                head = word[:k] + "-"
                counts[head] = counts.get(head, 0) + n
    return counts


class Seeker:
    """Counts of chosen terms only, as ``term_counts`` would give them."""

    #: words whose terms a task remembers, at most; beyond that it starts anew
    known_words = 500_000

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.place = {t: i for i, t in enumerate(terms)}
        self.of_word: dict[str, list[int]] = {}

    def numbers(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms in the list, in order, and their counts."""
        found: list[int] = []
        of_word, place = self.of_word, self.place
        if len(of_word) > self.known_words:
            of_word.clear()
        for word in WORD.findall(text.lower()):
            own = of_word.get(word)
            if own is None:
                own = of_word[word] = [place[x] for x in (word, *(word[:k] + "-" for k in HEADS if len(word) > k)) if x in place]
            found += own
        if not found:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        which = np.sort(np.array(found, np.int32))
        first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        return which[first], np.diff(first, append=len(which)).astype(np.int32)

    def __call__(self, text: str) -> dict[str, int]:
        places, counts = self.numbers(text)
        return {self.terms[i]: n for i, n in zip(places.tolist(), counts.tolist(), strict=True)}


class Index:
    """Examples as unit vectors in blocks; ``idf`` is each term's weight besides its frequency in a text. A term of few examples has postings; a term of more than an eighth of them
    has its weights in every block and, for each block, the largest of them."""

    #: documents scored at a time
    rows = 64

    def __init__(self, idf: np.ndarray, examples: list[tuple[list[int], list[int]]], labels: list[int], settings: Settings):
        self.idf, self.settings = idf, settings
        # examples with like terms stand together, so that block bounds are tight
        order = sorted(range(len(examples)), key=lambda i: (sorted(examples[i][0], key=lambda t: -idf[t])[:64], labels[i], i))
        self.labels = np.array([labels[i] for i in order], float)
        self.source = np.array(order, np.int64)
        size = settings.block
        self.blocks = -(-len(order) // size)
        units = [self.unit(*examples[i]) for i in order]
        terms = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in units)])
        weights = np.concatenate([np.zeros(0), *(w for _, w in units)])
        places = np.repeat(np.arange(len(units)), [len(t) for t, _ in units])
        held = np.bincount(terms, minlength=len(idf))
        common = np.flatnonzero(held * 8 > len(order))
        #: a common term's row of ``dense``, -1 for others
        self.row = np.full(len(idf), -1)
        self.row[common] = np.arange(len(common))
        rare = self.row[terms] < 0
        by_term = np.argsort(terms[rare], kind="stable")
        self.places, self.weights = places[rare][by_term].astype(np.int32), weights[rare][by_term]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(terms[rare], minlength=len(idf)))])
        self.dense = np.zeros((self.blocks, len(common), size))
        self.dense[places[~rare] // size, self.row[terms[~rare]], places[~rare] % size] = weights[~rare]
        self.bound = self.dense.max(axis=2).T if self.blocks else np.zeros((len(common), 0))

    def unit(self, terms: list[int], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.array(terms, np.int64)
        w = (1 + np.log(np.array(counts, float))) * self.idf[t] if len(t) else np.zeros(0)
        length = np.sqrt((w * w).sum())
        return (t, w / length) if length > 0 else (t[:0], w[:0])

    def nearest(self, terms: list[int], counts: list[int], leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a positive cosine, nearest first, ties to the earlier place.
        ``leave`` is an example's number that doesn't count."""
        return self.nearest_of([(terms, counts)], [leave])[0]

    def nearest_of(self, texts: list[tuple[list[int], list[int]]], leave: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each text."""
        out = []
        for at in range(0, len(texts), self.rows):
            out += self._some(texts[at : at + self.rows], None if leave is None else leave[at : at + self.rows])
        return out

    def _some(self, texts: list[tuple[list[int], list[int]]], leave: list[int] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        k, size, n = self.settings.k, self.settings.block, self.blocks * self.settings.block
        none = np.zeros(0, np.int64), np.zeros(0)
        if not n:
            return [none] * len(texts)
        asked = np.zeros((len(texts), self.bound.shape[0]))
        scores = np.zeros((len(texts), n))
        for i, (t, w) in enumerate(self.unit(*x) for x in texts):
            row = self.row[t]
            asked[i, row[row >= 0]] = w[row >= 0]
            t, w = t[row < 0], w[row < 0]
            first, length = self.starts[t], self.starts[t + 1] - self.starts[t]
            each = np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())
            scores[i] = np.bincount(self.places[each], np.repeat(w, length) * self.weights[each], minlength=n)
        left = [] if leave is None else [(i, int(np.flatnonzero(self.source == x)[0])) for i, x in enumerate(leave) if x >= 0]
        for i, place in left:
            scores[i, place] = 0
        # what the postings give alone is never more than the cosine
        least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.zeros(len(texts))
        most = scores.reshape(len(texts), self.blocks, size).max(axis=2) + asked @ self.bound
        for b in range(self.blocks):
            need = np.flatnonzero(most[:, b] + 1e-12 >= least)
            if len(need):
                scores[need, b * size : (b + 1) * size] += asked[need] @ self.dense[b]
        for i, place in left:
            scores[i, place] = 0
        out = []
        for own in np.round(scores, 12):
            last = np.partition(own, n - k)[n - k] if n > k else 0.0
            places = np.flatnonzero((own >= last) & (own > 0))
            places = places[np.argsort(-own[places], kind="stable")][:k]
            out.append((places, own[places]))
        return out

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Share of class 1 among the nearest, weighted by cosine, with half a vote for either class."""
        return float((cosines @ self.labels[places] + 0.05) / (cosines.sum() + 0.1)) if len(places) else 0.0


@dataclass
class Model:
    index: Index | None
    #: score of a text without any of the terms; slope and offset of the logistic calibration of the others' votes
    none: float
    slope: float
    offset: float

    def scores(self, texts: list[tuple[list[int], list[int]]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        if self.index is None:
            return [(self.none, np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        sure = lambda places, cosines: 1 / (1 + float(np.exp(-(self.slope * self.index.vote(places, cosines) + self.offset))))
        return [(sure(p, c) if len(p) else self.none, p, c) for p, c in self.index.nearest_of(texts)]


def sample_terms(sample: DataFrame) -> list[str]:
    """Every term of the sample's texts (column ``data``), those of most texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(term_counts(text).keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    counts = sample.select("data").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    return counts.sort_by([("n", "descending"), ("term", "ascending")]).column("term").to_pylist()


def restricted(docs: DataFrame, terms: list[str], into: list[str], text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the two columns ``into``: the chosen terms that each whole text holds, and their counts."""
    names = [c for c in docs.columns if c != text_col]
    kept = docs.select(*names, text_or_empty(text_col).alias(into[0]))
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeker = Seeker(sent.value)
        for batch in batches:
            own = [seeker.numbers(text) for text in batch.column(len(names)).to_pylist()]
            ends = pa.array(np.cumsum([0, *(len(t) for t, _ in own)]), pa.int32())
            ids, counts = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *x]), pa.int32())) for x in ((t for t, _ in own), (c for _, c in own)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], ids, counts], [*names, *into])

    schema = kept.select(*names, *[F.array().cast("array<int>").alias(c) for c in into]).schema
    return kept.mapInArrow(run, schema)


def lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as arrays, without a Python number for each entry."""
    flat = column.flatten().to_numpy()
    return np.split(flat, np.cumsum([0, *pc.list_value_length(column).to_pylist()])[1:-1]) if len(column) else []


def document_frequency(vectors: DataFrame, n_terms: int, terms_col: str) -> np.ndarray:
    """How many documents hold each term. Each task sums up its own, so a term of very many documents is a row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(counts))
            own[: len(counts)] += counts
            counts = own
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["t", "n"])

    found = vectors.select(terms_col).mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # a row a term
    out = np.zeros(n_terms)
    out[found.column("t").to_numpy()] = found.column("n").to_numpy()
    return out


def relevance(texts: list[tuple[np.ndarray, np.ndarray]], labels: list[int], n_terms: int) -> np.ndarray:
    """Relevance frequency of each term: log2(2 + a / max(1, c)), with a and c the examples of class 1 and 0 that hold it, per
    thousand of their class."""
    held = np.zeros((2, n_terms))
    for (terms, _), y in zip(texts, labels, strict=True):
        held[y][terms] += 1
    n0, n1 = labels.count(0), labels.count(1)
    return np.log2(2 + held[1] * (1000 / n1) / np.maximum(1, held[0] * (1000 / n0)))


def fitted(vectors: DataFrame, chosen: DataFrame, n_terms: int, share: float, settings: Settings, id_col: str, made: list[str]) -> Model:
    """The index and its calibration. ``share`` is class 1's share among all labelled rows that may be learnt from; ``made``
    names the columns of terms and counts."""
    n_docs = vectors.count()
    idf = np.log((1 + n_docs) / (1 + document_frequency(vectors, n_terms, made[0]))) + 1
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(made[0]).alias("_terms"), F.col(made[1]).alias("_counts"))
    found = rows.join(F.broadcast(chosen), "_id").orderBy("_id", "_terms", "_counts").toArrow().combine_chunks()  # bounded by the sample
    labels = found.column("_y").to_pylist()
    n1, n0 = (labels.count(y) for y in (1, 0))
    if not n1 or not n0:
        return Model(None, share, 1.0, 0.0)
    # the sample is balanced by class, so rows weigh as their class does in the corpus
    weigh = {1: share / n1, 0: (1 - share) / n0}
    texts = [*zip(*(lists(found.column(c).combine_chunks() if len(found) else found.column(c)) for c in ("_terms", "_counts")), strict=True)]
    bare = [y for y, (t, _) in zip(labels, texts, strict=True) if not len(t)]
    w1, w0 = (weigh[y] * bare.count(y) for y in (1, 0))
    none = (w1 + 1e-3 * share) / (w1 + w0 + 1e-3)
    index = Index(idf * relevance(texts, labels, n_terms), texts, labels, settings)
    votes, truth = [], []
    for y, (places, cosines) in zip(labels, index.nearest_of(texts, [*range(len(texts))]), strict=True):
        if len(places):
            votes.append(index.vote(places, cosines))
            truth.append(y)
    slope, offset = 8.0, -4.0
    x, y = np.array(votes), np.array(truth, float)
    w = np.array([weigh[t] for t in truth])
    w = w / w.sum() * len(w) if len(w) else w
    for _ in range(40):
        if not len(x):
            break
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        c = w * p * (1 - p) + 1e-6
        grad = np.array([(w * (p - y) * x).sum() + 0.02 * (slope - 8), (w * (p - y)).sum() + 0.02 * (offset + 4)])
        hess = np.array([[(c * x * x).sum() + 0.02, (c * x).sum()], [(c * x).sum(), c.sum() + 0.02]])
        slope, offset = np.array([slope, offset]) - np.linalg.solve(hess, grad)
    return Model(index, float(none), float(slope), float(offset))


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``score`` and ``evidence`` (label and cosine of the nearest examples, nearest first).

    A text with no word of any example, an empty or a null one gets the calibrated share of class 1 among such examples and
    no evidence. Without labels of both classes every text gets the known share of class 1 (0.5 if nothing is known). Whole
    texts are read, however long; equal rows score alike and all stay; an empty table stays empty; neighbours of equal
    cosine are taken in the index's own order. Columns named ``score`` and ``evidence`` are replaced, all others kept.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    share = labels.where(F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    chosen = stored(label_sample(labels, label, settings.per_class, id_col), "sample")
    sample = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("data")).join(F.broadcast(chosen), "_id")
    terms = sample_terms(sample)
    base = docs.drop("score", "evidence")
    made = unused(base, "terms", "counts")
    rows = stored(restricted(base, terms, made, text_col), "vectors")
    sent = spark.sparkContext.broadcast(fitted(rows, chosen, len(terms), 0.5 if share is None else float(share), settings, id_col, made))
    names = rows.columns[:-2]
    width = len(names)
    pairs = pa.list_(pa.struct([("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = sent.value, {}
        for batch in batches:
            texts = [*zip(lists(batch.column(width)), lists(batch.column(width + 1)), strict=True)]
            keys = [xxhash.xxh3_128_digest(t.tobytes() + c.tobytes()) for t, c in texts]
            fresh = {key: x for key, x in zip(keys, texts, strict=True) if key not in memo}
            new = {}
            for key, (score, places, cosines) in zip(fresh, model.scores([*fresh.values()]), strict=True):
                new[key] = score, [{"label": int(model.index.labels[p]), "cosine": float(x)} for p, x in zip(places, cosines, strict=True)]
            out = [memo.get(key) or new[key] for key in keys]
            if len(memo) < 20_000:
                memo |= new
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pairs)], [*names, "score", "evidence"])

    schema = rows.select(*names, F.lit(0.0).alias("score"), F.array(F.struct(F.lit(0).alias("label"), F.lit(0.0).alias("cosine"))).alias("evidence")).schema
    return rows.mapInArrow(run, schema)


def op2_toxicity_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").where(id_remainder("doc_id", 5) != 0)
    return scored(docs, labels).select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
