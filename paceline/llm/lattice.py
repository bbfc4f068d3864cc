"""Language-model scoring with a subword lattice.

Every word is a lattice: its arcs are the pieces of an existing subword vocabulary that match inside
it (bytes where no piece does), and, for a word met in training, one arc over the whole word. The
probability of a word is the sum over all paths, found by a forward recursion in log space; a text's
is the product over its words and its end.

* Piece weights start from the vocabulary's own scores and are re-estimated on the training words by
  expectation-maximisation: a first piece, then stop or go on with a further piece. The expected counts
  of a round are summed by Spark, so what reaches the driver is one number a piece.
* Whole-word arcs carry discounted training counts; the discounts leave the mass that the subword paths
  share, so the words' probabilities sum to at most one.

Counts cover every training document. Word counts and word scores stay in tables that grow with the
corpus. To score, documents are dealt to chunks by hash; each chunk asks for its distinct words once
(word table joined on the word, pre-aggregated per chunk, so a frequent word costs one row a chunk) and
scores its documents from the answers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import bounded_batches, id_remainder, partitions, read_table, stored, text_bytes

#: The end of a text, counted as a token: a byte string that no word equals, since words hold no blanks.
END = b" "
#: Distinct words that a task sums up before it hands them on.
HELD = 200_000
WORDS = 20_000


def words_of(data: bytes) -> list[bytes]:
    """Words of UTF-8 bytes: ASCII letters lower-cased, split at ASCII white space."""
    return data.lower().split()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, int], dict[bytes, int], list[float]]:
    """First pieces, further pieces (both with their index) and starting scores. A string that only opens longer pieces
    has index -1, so that a walk along a word can stop at the first string that is missing.

    A piece that opens with the word mark can only stand first in a word; the mark alone opens any word.
    All 256 bytes are further pieces. The file's scores fall by one with each rank, so they stand for
    ranks, and the starting weights follow Zipf's law over them.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    first, further, score = {}, {}, []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
            continue
        piece, weight = model.id_to_piece(i), -math.log(10 - model.get_score(i))
        table, body = (first, piece[1:]) if piece.startswith("▁") else (further, piece)
        if "▁" in body or any(c in " \t\n\r\x0b\x0c" for c in body):
            continue
        body = body.encode()
        if body != body.lower():
            continue
        if body not in table:
            table[body] = len(score)
            score.append(weight)
    first.setdefault(b"", len(score))
    if first[b""] == len(score):
        score.append(-math.log(10))
    low = min(score) - 2
    for b in range(256):
        if bytes([b]) not in further:
            further[bytes([b])] = len(score)
            score.append(low)
    for table in (first, further):
        for piece in [*table]:
            for n in range(1, len(piece)):
                table.setdefault(piece[:n], -1)
    return first, further, score


class Lattice:
    """Subword probabilities. ``weights`` has one log probability a piece (given that a first, or a further, piece is
    drawn), then one probability a piece that the word ends after it."""

    def __init__(self, path: str, weights: np.ndarray | None = None):
        self.first, self.further, start = vocabulary(path)
        self.size = len(start)
        if weights is None:
            weights = self.normal(np.exp(np.array(start)), np.full(self.size, 0.3))
        p, stop = np.exp(weights[: self.size]), weights[self.size :]
        self.on, self.last = (p * (1 - stop)).tolist(), (p * stop).tolist()
        #: no arc is longer, so sums further ahead are still zero
        self.reach = max(map(len, self.further)) + 1
        self.lead = max(map(len, self.first)) + 1

    def normal(self, counts: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out = np.empty(self.size)
        for table in (self.first, self.further):
            at = np.array([k for k in table.values() if k >= 0])
            out[at] = np.log(counts[at] / counts[at].sum())
        stop = stop.copy()
        stop[self.first[b""]] = 0.0
        return np.concatenate([out, stop])

    def arcs(self, word: bytes) -> list[list[tuple[int, int]]]:
        """Arcs of the word as (end, piece): first those of the first piece, then for each position those of further pieces."""
        n, further = len(word), self.further
        out = [self.opening(word)]
        for s in range(n):
            here = []
            for e in range(s + 1, n + 1):
                k = further.get(word[s:e])
                if k is None:
                    break
                if k >= 0:
                    here.append((e, k))
            out.append(here)
        return out

    def opening(self, word: bytes) -> list[tuple[int, int]]:
        table, here = self.first, [(0, self.first[b""])]
        for e in range(1, len(word) + 1):
            k = table.get(word[:e])
            if k is None:
                break
            if k >= 0:
                here.append((e, k))
        return here

    def log_probability(self, word: bytes) -> float:
        """Natural log of the summed probability of all segmentations: forward recursion, carried over to log space
        wherever the running sums leave the range of doubles."""
        n, on, last, further = len(word), self.on, self.last, self.further
        alpha, shift, total = [0.0] * n, 0.0, 0.0
        for e, k in self.opening(word):
            if e < n:
                alpha[e] += on[k]
            else:
                total += last[k]
        for s in range(n):
            a = alpha[s]
            if a < 1e-200:
                if a == 0.0:
                    continue
                end = min(n, s + max(self.reach, self.lead))
                top = max(total, *alpha[s:end])
                if top < 1e-150:
                    shift += math.log(top)
                    alpha[s:end] = [x / top for x in alpha[s:end]]
                    total /= top
                    a = alpha[s]
            for e in range(s + 1, n):
                k = further.get(word[s:e])
                if k is None:
                    break
                if k >= 0:
                    alpha[e] += a * on[k]
            else:
                k = further.get(word[s:])
                if k is not None and k >= 0:
                    total += a * last[k]
        return math.log(total) + shift if total > 0 else -math.inf

    def expected(self, word: bytes, counts: list[float], stops: list[float]) -> None:
        """Add the word's expected pieces to ``counts`` and its expected last pieces to ``stops``."""
        n, on, last = len(word), self.on, self.last
        arcs = self.arcs(word)
        alpha, total = [0.0] * (n + 1), 0.0
        for e, k in arcs[0]:
            if e < n:
                alpha[e] += on[k]
            else:
                total += last[k]
        for s in range(n):
            if a := alpha[s]:
                for e, k in arcs[s + 1]:
                    if e < n:
                        alpha[e] += a * on[k]
                    else:
                        total += a * last[k]
        if total < 1e-280:
            self.expected_long(arcs, counts, stops)
            return
        beta = [0.0] * (n + 1)
        for s in range(n - 1, -2, -1):
            a = alpha[s] if s >= 0 else 1.0
            got = 0.0
            for e, k in arcs[s + 1]:
                if e < n:
                    w = on[k] * beta[e]
                else:
                    w = last[k] / total
                    if a:
                        stops[k] += a * w
                got += w
                if a:
                    counts[k] += a * w
            if s >= 0:
                beta[s] = got


    def expected_long(self, arcs: list[list[tuple[int, int]]], counts: list[float], stops: list[float]) -> None:
        """``expected`` in log space, for words whose probability leaves the range of doubles."""
        n = len(arcs) - 1

        def log(x: float) -> float:
            return math.log(x) if x > 0 else -math.inf

        def plus(a: float, b: float) -> float:
            high, low = (a, b) if a > b else (b, a)
            return high if low == -math.inf else high + math.log1p(math.exp(low - high))

        alpha, total = [0.0, *[-math.inf] * n], -math.inf  # the start, then each place within the word
        start = lambda s: alpha[0] if s < 0 else alpha[s + 1]
        for s in range(-1, n):
            a = start(s)
            if a == -math.inf:
                continue
            for e, k in arcs[s + 1]:
                if e < n:
                    alpha[e + 1] = plus(alpha[e + 1], a + log(self.on[k]))
                else:
                    total = plus(total, a + log(self.last[k]))
        if total == -math.inf:
            return
        beta = [-math.inf] * (n + 1)
        for s in range(n - 1, -2, -1):
            a, got = start(s), -math.inf
            for e, k in arcs[s + 1]:
                w = log(self.on[k]) + beta[e] if e < n else log(self.last[k]) - total
                got = plus(got, w)
                share = math.exp(min(0.0, a + w)) if a + w > -math.inf else 0.0
                counts[k] += share
                if e >= n:
                    stops[k] += share
            if s >= 0:
                beta[s] = got


def word_counts(docs: DataFrame, training, text_col: str = "text") -> DataFrame:
    """``word, c`` for every word of every text and END; ``c`` is its count over the rows where ``training`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        other: set[bytes] = set()

        def out() -> pa.RecordBatch:
            keys = [*held, *(w for w in other if w not in held)]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([held.get(w, 0) for w in keys], pa.int64())], ["word", "c"])

        for batch in batches:
            for data, learn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if learn:
                    held.update(words_of(data))
                    held[END] += 1
                else:
                    other.update(words_of(data))
                    other.add(END)
                if len(held) + len(other) > HELD:
                    yield out()
                    held, other = Counter(), set()
        if held or other:
            yield out()

    rows = docs.select(text_bytes(text_col).alias("data"), F.coalesce(training, F.lit(False)).alias("learn"))
    return rows.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def train(words: DataFrame, path: str, rounds: int = 1) -> np.ndarray:
    """Piece weights after a warm start on an eighth of the training words and ``rounds`` of expectation-maximisation
    over all of them.

    Each distinct word counts once, not once an occurrence: the subword paths serve words that are rare or new.
    """
    spark = words.sparkSession
    lattice = Lattice(path)
    weights = None
    seen = words.where((F.col("c") > 0) & (F.col("word") != F.lit(END))).select("word")
    for part in [seen.where(F.pmod(F.xxhash64("word"), F.lit(8)) == 0), *[seen] * rounds]:
        sent = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(path, sent.value)
            counts, stops = [0.0] * lattice.size, [0.0] * lattice.size
            for batch in batches:
                for word in batch.column(0).to_pylist():
                    lattice.expected(word, counts, stops)
            yield pa.RecordBatch.from_arrays([pa.array([np.array([*counts, *stops]).tobytes()], pa.binary())], ["sums"])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    sums = np.frombuffer(x).copy() if sums is None else sums + np.frombuffer(x)
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

        near = part.mapInArrow(run, "sums binary").repartition(8).mapInArrow(total, "sums binary")  # the driver gets eight vectors of two numbers a piece
        sums = np.sum([np.frombuffer(r[0]) for r in near.collect()] or [np.zeros(2 * lattice.size)], axis=0)
        counts, stops = sums[: lattice.size], sums[lattice.size :]
        weights = lattice.normal(counts + 0.02, (stops + 0.3) / (counts + 1.0))
    return weights


def discounts(counts_of_counts: dict[int, int]) -> tuple[float, float, float]:
    """Discounts of words met once, twice and more often, from how many words have each count."""
    n = [counts_of_counts.get(k, 0) for k in range(1, 5)]
    if min(n[:2]) == 0:
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 for k in (1, 2, 3)]
    return tuple(min(k - 0.05, max(0.05, d)) for k, d in zip((1, 2, 3), found, strict=True))


def scored(docs: DataFrame, training, path: str, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, n_known, train_tokens, base_score, score`` per row, both scores as log10 of the text's probability.

    ``base_score`` is the add-0.1 unigram model, ``score`` the lattice's. A null text counts as empty: its only token is
    the end. Repeated rows and null ids all stay; without training rows every count is zero and the subword paths alone give
    scores; an empty table stays empty. Very long texts are read whole. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    words = stored(word_counts(docs, training, text_col), "words")
    total, distinct, *n = words.agg(F.sum("c"), F.count_if(F.col("c") > 0), *[F.count_if(F.col("c") == k) for k in range(1, 5)]).first()
    total, distinct = total or 0, distinct or 0
    weights = train(words, path, rounds) if total else None
    cuts = discounts(dict(enumerate(n, 1)))
    several = words.agg(F.count_if(F.col("c") >= 3)).first()[0]
    left = (cuts[0] * n[0] + cuts[1] * n[1] + cuts[2] * several) / total if total else 1.0
    sent = spark.sparkContext.broadcast(weights)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(path, sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, WORDS):
                batch = whole.slice(at, WORDS)
                out = []
                for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    known = (c - cuts[min(c, 3) - 1]) / total if c else 0.0
                    if word == END:
                        out.append(math.log10(known or (1.0 / (total + 1) if total else 0.5)))
                        continue
                    new = lattice.log_probability(word) + math.log(left)
                    # log-space sum of the whole-word arc and the subword paths
                    high, low = max(new, math.log(known)) if known else new, min(new, math.log(known)) if known else -math.inf
                    out.append((high + math.log1p(math.exp(low - high))) / math.log(10))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], ["word", "c", "lp"])

    table = stored(words.mapInArrow(price, "word binary, c long, lp double"), "priced")
    n_chunks = partitions(spark, 2)
    dealt = docs.select(id_col, F.pmod(F.xxhash64(id_col, text_col), F.lit(n_chunks)).cast("int").alias("chunk"), text_bytes(text_col).alias("data")).repartition(n_chunks, "chunk")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set[bytes]] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.setdefault(chunk, {END}).update(words_of(data))
        for chunk, own in held.items():
            listed = list(own)
            for at in range(0, len(listed), WORDS):
                some = listed[at : at + WORDS]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(some), pa.int32()), pa.array(some, pa.binary())], ["chunk", "word"])

    answers = dealt.mapInArrow(asked, "chunk int, word binary").join(table, "word").select("chunk", "word", "c", "lp")
    floor = 0.1 / (total + 0.1 * (distinct + 1))

    def settle(texts: pa.Table, answers: pa.Table) -> pa.Table:
        c = answers["c"].to_numpy()
        base = np.log10((c + 0.1) * (floor / 0.1))
        lp = answers["lp"].to_numpy()
        at = {w: i for i, w in enumerate(answers["word"].to_pylist())}
        out = {id_col: texts[id_col].combine_chunks(), "n_tokens": [], "n_known": [], "train_tokens": [total] * len(texts), "base_score": [], "score": []}
        for data in texts["data"]:
            own = np.fromiter(map(at.__getitem__, [*words_of(data.as_py()), END]), np.int64)
            out["n_tokens"].append(len(own))
            out["n_known"].append(int((c[own] > 0).sum()))
            out["base_score"].append(float(base[own].sum()))
            out["score"].append(float(lp[own].sum()))
        return pa.table(out)

    kind = docs.schema[id_col].dataType.simpleString()
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(settle, f"{id_col} {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, id_remainder("doc_id", 10) != 0, vocabulary_path())
    return out.select("doc_id", (id_remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
