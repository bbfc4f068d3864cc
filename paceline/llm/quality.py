"""Quality classifier: supervised subword embeddings.

Words and character n-grams are hashed into buckets; each bucket has a learned vector, a document is
the mean of its features' vectors, and a softmax over the mean gives the class. The model is trained
with numpy stochastic gradient descent on a bounded sample of labelled rows, inside one task, and is a
few hundred kilobytes whatever the corpus holds. Scoring is one map-only pass over whole texts.

The softmax of a mean of vectors depends on each vector only through its products with the output
weights, so scoring averages those products, which gives the same score as averaging the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import bounded_batches, id_remainder, mixed, read_table, text_bytes, unused, utf8


@dataclass(frozen=True)
class Settings:
    #: labelled rows of each class that the model is fitted on, at most: those whose hashed ids are smallest
    per_class: int = 1500
    buckets: int = 1 << 16
    dims: int = 8
    ngrams: tuple[int, ...] = (2, 3, 4)
    epochs: int = 6
    #: learning rates of the output layer and of the vectors at the start; both fall to zero in a straight line. A feature's
    #: gradient is its share of the document's mean, a few thousandths, hence the larger rate of the vectors.
    rate: float = 0.6
    vector_rate: float = 12.0
    seed: int = 17


#: Bytes handled at a time, to keep the temporaries of a long text small.
PIECE = 1 << 18


def characters(raw: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes."""
    return np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")


def features(raw: np.ndarray, settings: Settings) -> np.ndarray:
    """Bucket of every word and character n-gram of one UTF-8 text, repeats included.

    N-grams stay within a word and its two bordering blanks; each n and the whole words hash apart. ASCII letters count as
    their lower case.
    """
    points = characters(raw)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    points = points + ((points >= 65) & (points <= 90)).astype(np.uint32) * np.uint32(32)
    text = np.concatenate([[np.uint32(32)], np.where(space, np.uint32(32), points), [np.uint32(32)]])
    blank = text == 32
    keep = np.ones(len(text), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])  # runs of white space count as one blank
    text, blank = text[keep], blank[keep]
    if len(text) < 2:
        return np.zeros(0, np.int64)
    mask = np.uint64(settings.buckets - 1)
    value = mixed(text.astype(np.uint64) + np.uint64(257))
    found = []
    rolled = value
    for n in range(2, max(settings.ngrams) + 1):
        if len(text) < n:
            break
        rolled = rolled[: len(text) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + value[n - 1 :]
        if n in settings.ngrams:
            inner = np.zeros(len(rolled), bool)
            for k in range(1, n - 1):
                inner |= blank[k : k + len(rolled)]
            if n == 2:
                inner = blank[:-1] & blank[1:]
            found.append((mixed(rolled[~inner] + np.uint64(n)) & mask).astype(np.int64))
    ends = np.flatnonzero(blank)
    starts, stops = ends[:-1] + 1, ends[1:]
    some = stops > starts
    if some.any():
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(len(text), 0x9E3779B97F4A7C15, np.uint64))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power)])
            back = np.cumprod(np.full(len(text), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
            words = (total[stops[some]] - total[starts[some]]) * back[starts[some]]
        found.append((mixed(words) & mask).astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces cut at white space where there is any, so that memory stays bounded."""
    at = 0
    while len(raw) - at > PIECE:
        window = raw[at + PIECE // 2 : at + PIECE]
        gaps = np.flatnonzero((window == 32) | ((window >= 9) & (window <= 13)))
        stop = at + PIECE // 2 + int(gaps[-1]) + 1 if len(gaps) else at + PIECE
        while not len(gaps) and stop > at + 1 and raw[stop] & 0xC0 == 0x80:  # not within a character
            stop -= 1
        yield raw[at:stop]
        at = stop
    yield raw[at:]


def counted(raw: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    total: dict[int, int] = {}
    parts = [np.unique(features(x, settings), return_counts=True) for x in pieces(raw)]
    if len(parts) == 1:
        return parts[0]
    for ids, n in parts:
        for i, k in zip(ids.tolist(), n.tolist(), strict=True):
            total[i] = total.get(i, 0) + k
    return np.fromiter(total.keys(), np.int64, len(total)), np.fromiter(total.values(), np.int64, len(total))


def train(texts: list[bytes], labels: list[int], share: float, settings: Settings) -> np.ndarray:
    """Softmax weight of each bucket (class 1 against class 0), and last the bias for a corpus with ``share`` of class 1."""
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1 / settings.dims, 1 / settings.dims, (settings.buckets, settings.dims))
    output, bias = np.zeros((settings.dims, 2)), np.zeros(2)
    seen = [(ids, n / n.sum(), y) for ids, n, y in ((*counted(np.frombuffer(t, np.uint8), settings), y) for t, y in zip(texts, labels, strict=True)) if len(ids)]
    steps, done = settings.epochs * max(1, len(seen)), 0
    for _ in range(settings.epochs):
        for k in rng.permutation(len(seen)).tolist():
            ids, part, y = seen[k]
            left = 1 - done / steps
            rate, vector_rate = settings.rate * left, settings.vector_rate * left
            done += 1
            mean = part @ vectors[ids]
            logit = mean @ output + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            back = output @ p
            output -= rate * np.outer(mean, p)
            bias -= rate * p
            vectors[ids] -= vector_rate * part[:, None] * back
    weight = vectors @ (output[:, 1] - output[:, 0])
    lean = bias[1] - bias[0]
    among = float(np.mean(labels)) if labels else 0.5
    if 0 < among < 1 and 0 < share < 1:  # the sample is balanced by class, the corpus isn't
        lean += np.log(share / (1 - share)) - np.log(among / (1 - among))
    return np.concatenate([weight, [lean]]).astype(np.float32)


def label_sample(labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id") -> DataFrame:
    """``_id, _y`` of at most ``per_class`` labelled ids of each class, smallest hash first. Null labels or ids don't count."""
    clean = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    ordered = [clean.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    return ordered[0].unionByName(ordered[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The model's weights, fitted on at most ``2 * settings.per_class`` labelled rows; without any it scores everything 0.5."""
    share = labels.where(F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    chosen = label_sample(labels, label, settings.per_class, id_col)  # two rows a labelled id with two texts: both are learnt from
    rows = docs.select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("data")).join(F.broadcast(chosen), "_id").select("_id", "_y", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = sorted({(i, d): y for b in batches for i, y, d in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)}.items())
        if met:
            model = train([d for (_, d), _ in met], [y for _, y in met], share if share is not None else 0.5, settings)
            yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], ["model"])

    got = rows.repartition(1).mapInArrow(run, "model binary").first()
    return np.frombuffer(got[0], np.float32) if got else np.zeros(settings.buckets + 1, np.float32)


def score(docs: DataFrame, model: np.ndarray, settings: Settings = Settings(), score_col: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with ``score_col``: the probability of class 1. A null or empty text gets the model's prior.

    Rows and other columns stay as they are, whatever their names; a column of that name is replaced. Long texts are read
    whole, in pieces; equal texts score alike; an empty table stays empty.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = docs.drop(score_col)
    sent = spark.sparkContext.broadcast(model)
    names = kept.columns
    (data,) = unused(kept, "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = sent.value[:-1].astype(np.float64)
        lean = float(sent.value[-1])
        for batch in batches:
            raw, offs = utf8(batch.column(len(names)))
            out = np.empty(batch.num_rows)
            for i in range(batch.num_rows):
                total, n = 0.0, 0
                for part in pieces(raw[offs[i] : offs[i + 1]]):
                    ids = features(part, settings)
                    total += float(weight[ids].sum())
                    n += len(ids)
                out[i] = lean + (total / n if n else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(1 / (1 + np.exp(-np.clip(out, -50, 50))))], [*names, score_col])

    schema = kept.withColumn(score_col, F.lit(0.0)).schema
    return kept.withColumn(data, text_bytes(text_col)).mapInArrow(run, schema)


def op3_quality_subword(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality").where(id_remainder("doc_id", 5) != 0)
    scored = score(docs, fit(docs, labels, settings=settings), settings)
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
