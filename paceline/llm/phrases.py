"""Collocations: frequent phrases whose parts occur together more often than alone.

Words that are frequent in their language get dense numbers; other words break pieces just as punctuation does, because
no frequent phrase holds them. Phrases of numbered words are packed into keys of a fixed width (one long where all
numbers of a phrase fit into it, else a binary). Each task sorts its keys and counts runs, so what leaves it is a row for
each phrase and flush and not for each occurrence; these rows are range-partitioned by key, sorted (by radix where keys
are longs) and their runs added up. Parts of phrases are looked up by key afterwards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm.common import discard, partitions, read_table, spread_join, stored


@dataclass(frozen=True)
class Settings:
    longest: int = 3
    at_least: int = 10
    #: a phrase is covered by a longer one that occurs at least this percentage as often
    covered: int = 50
    first: int = 2000
    #: the dictionary goes to all tasks up to this many words and bytes; beyond, texts are dealt into chunks that meet the words they hold
    broadcast_words: int = 1_000_000
    broadcast_bytes: int = 32 << 20
    chunk_bytes: int = 16 << 20
    #: keys that need more bits are binaries
    long_bits: int = 63
    #: keys sorted at a time, and distinct words counted at a time, in one task
    keys: int = 1 << 22
    distinct: int = 1 << 18


OUT = "lang string, rank int, phrase string, a long, l long, r long, n long, score long"

#: Bytes lower-cased (A-Z) with tabs as spaces and all ends of pieces as line feeds; and with these as spaces too.
PIECES = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c in b"\t " else c + 32 if 65 <= c <= 90 else c for c in range(256))
WORDS = bytes(32 if c == 10 else c for c in PIECES)
SLICE = 1 << 20


def cut(raw: bytes, size: int = SLICE) -> Iterator[bytes]:
    """``raw`` in parts of about ``size`` bytes that end at spaces."""
    low = 0
    while len(raw) - low > size:
        end = raw.find(b" ", low + size)
        if end < 0:
            break
        yield raw[low:end]
        low = end
    yield raw[low:]


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The texts of each language of a batch with line feeds between them, of about a slice each or of one longer text."""
    open_: dict[str, list[bytes]] = {}
    size: Counter = Counter()
    for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
        lang, text = lang.as_py(), text.as_py()
        open_.setdefault(lang, []).append(text)
        size[lang] += len(text)
        if size[lang] > SLICE:
            yield lang, b"\n".join(open_.pop(lang))
            size[lang] = 0
    for lang, texts in open_.items():
        yield lang, b"\n".join(texts)


def prepared(documents: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return documents.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string").cast("binary"), F.lit(b"")).alias("text"))


def word_counts(texts: DataFrame, settings: Settings, group: str | None = None) -> DataFrame:
    """``lang, word, c``, partial counts by task; a null word stands for all words of the language. With ``group``, by that column too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, part), c in counts.items():
                c.pop(b"", None)
                if c:
                    n = len(c) + 1
                    columns = [pa.array([lang] * n), pa.array([*c, None], pa.binary()), pa.array([*c.values(), sum(c.values())], pa.int64()), pa.array([part] * n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "c", "part"])
            counts.clear()

        for batch in batches:
            held = batch.column(2).to_numpy() if group else np.zeros(len(batch), np.int64)
            edges = [0, *(np.flatnonzero(np.diff(held)) + 1), len(batch)]
            for low, high in zip(edges, edges[1:], strict=False):
                for lang, raw in by_lang(batch.slice(low, high - low)):
                    for some in cut(raw.translate(WORDS)):
                        counts.setdefault((lang, int(held[low])), Counter()).update(some.split(b" "))
                        if sum(map(len, counts.values())) > settings.distinct:
                            yield from flush()
        yield from flush()

    columns = ["lang", "text", *([group] if group else [])]
    return texts.select(*columns).mapInArrow(run, "lang string, word binary, c long, part long")


def dictionary(counts: DataFrame, settings: Settings) -> DataFrame:
    """``lang, word, f, id``: the frequent words with numbers from 1 on, dense but for uneven partitions, and a row with a null word for all of a language."""
    parts = partitions(counts.sparkSession)
    totals = counts.repartition(parts, "lang", "word").groupBy("lang", "word").agg(F.sum("c").alias("f")).where((F.col("f") >= settings.at_least) | F.col("word").isNull())
    made = F.monotonically_increasing_id()  # partition << 33 | row; stored at once, so that the numbers stay
    return stored(totals.sortWithinPartitions(F.desc("f")).withColumn("k", made).select("lang", "word", "f", (F.col("k") % (1 << 33) * parts + F.shiftright("k", 33) + 1).alias("id")), "words")


@dataclass(frozen=True)
class Layout:
    """Keys of ``longest`` numbers below ``2 ** bits``, unused places at the end 0: one long if they fit, else big-endian bytes."""

    longest: int
    bits: int
    long_bits: int = 63

    @property
    def narrow(self) -> bool:
        return self.longest * self.bits <= self.long_bits

    @property
    def width(self) -> int:
        return -(-self.bits // 8)

    @property
    def type(self) -> str:
        return "long" if self.narrow else "binary"

    def packed(self, ids: list[np.ndarray]) -> np.ndarray:
        """Keys of phrases, given the array of first numbers, of second ones and so on."""
        n = len(ids[0])
        if self.narrow:
            out = np.zeros(n, np.int64)
            for k in range(self.longest):
                out = (out << self.bits) | (ids[k] if k < len(ids) else 0)
            return out
        out = np.zeros((n, self.longest, self.width), np.uint8)
        for k, x in enumerate(ids):
            out[:, k] = x.astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - self.width :]
        return out.reshape(n, self.longest * self.width).view(f"S{self.longest * self.width}").reshape(n)

    def arrow(self, keys: np.ndarray) -> pa.Array:
        if self.narrow:
            return pa.array(keys)
        size = self.longest * self.width
        offsets = np.arange(len(keys) + 1, dtype=np.int32) * size
        return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(keys).tobytes())])

    def numpy(self, keys: pa.Array) -> np.ndarray:
        if self.narrow:
            return keys.to_numpy()
        size = self.longest * self.width
        return np.frombuffer(keys.buffers()[2], f"S{size}", len(keys), int(np.frombuffer(keys.buffers()[1], np.int32)[keys.offset]))

    # the same keys as columns

    def first(self, key: Column, k: int) -> Column:
        """The key of the first ``k`` words."""
        if self.narrow:
            low = self.bits * (self.longest - k)
            return F.shiftleft(F.shiftright(key, low), low)
        return F.concat(F.substring(key, 1, k * self.width), F.lit(bytes((self.longest - k) * self.width)))

    def after(self, key: Column, k: int) -> Column:
        """The key of the words after the first ``k``."""
        if self.narrow:
            return F.shiftleft(key.bitwiseAND(F.lit((1 << self.bits * (self.longest - k)) - 1)), self.bits * k)
        return F.concat(F.substring(key, 1 + k * self.width, (self.longest - k) * self.width), F.lit(bytes(k * self.width)))

    def words(self, key: Column) -> Column:
        """The number of words."""
        out = F.lit(self.longest)
        for k in range(self.longest - 1, 0, -1):
            out = F.when(key == self.first(key, k), k).otherwise(out)
        return out

    def one(self, word: Column) -> Column:
        """The key of a single number."""
        if self.narrow:
            return F.shiftleft(word, self.bits * (self.longest - 1))
        return F.concat(F.unhex(F.lpad(F.hex(word), 2 * self.width, "0")), F.lit(bytes((self.longest - 1) * self.width)))


def runs(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array and how often they occur, or the sums of ``counts``."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[begin], np.diff(begin, append=len(keys))
    return keys[begin], np.add.reduceat(counts, begin) if len(begin) else counts[:0]


def numbered(raw: bytes, ids: dict[bytes, int]) -> np.ndarray:
    """The numbers of the words of a text, 0 wherever a piece ends or a word has none."""
    out = [np.zeros(0, np.int64)]
    for some in cut(raw.translate(PIECES).replace(b"\n", b" \n ")):
        words = some.split(b" ")
        out.append(np.fromiter(map(ids.get, words, [0] * len(words)), np.int64, len(words)))
    every = np.concatenate(out)
    return every[every >= 0]  # empty words have -1


class Grams:
    """Collects keys of phrases and hands them out as counted runs, so many at a time."""

    def __init__(self, layout: Layout, limit: int):
        self.layout, self.limit, self.held, self.size = layout, limit, [], 0

    def add(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(ids), self.limit):  # a phrase belongs to the part in which it begins
            some = ids[low : low + self.limit + self.layout.longest - 1]
            for m in range(2, self.layout.longest + 1):
                begins = min(self.limit, len(some) - m + 1)
                if begins > 0:
                    places = [some[k : k + begins] for k in range(m)]
                    whole = np.logical_and.reduce([p > 0 for p in places])
                    self.held.append(self.layout.packed([p[whole] for p in places]))
                    self.size += len(self.held[-1])
            if self.size >= self.limit:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys, counts = runs(np.sort(np.concatenate(self.held)))
            self.held, self.size = [], 0
            for low in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([self.layout.arrow(keys[low : low + (1 << 17)]), pa.array(counts[low : low + (1 << 17)].astype(np.int64))], ["key", "c"])


BREAKS = {b"": -1, b"\n": 0}


def broadcast_grams(texts: DataFrame, words: DataFrame, layout: Layout, settings: Settings) -> DataFrame:
    """Counted keys by task, the dictionary (of a checked size) sent to all of them."""
    table = words.where("word is not null").select("lang", "word", "id").toArrow()
    sent = texts.sparkSession.sparkContext.broadcast([table.column(k).to_pylist() for k in range(3)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, dict[bytes, int]] = {}
        for lang, word, number in zip(*sent.value, strict=True):
            ids.setdefault(lang, dict(BREAKS))[word] = number
        grams = Grams(layout, settings.keys)
        for batch in batches:
            for lang, raw in by_lang(batch):
                yield from grams.add(numbered(raw, ids.get(lang, BREAKS)))
        yield from grams.flush()

    return texts.mapInArrow(run, f"key {layout.type}, c long")


def chunked(texts: DataFrame, settings: Settings) -> DataFrame:
    """``texts`` with a chunk: texts that follow each other in a task, up to ``chunk_bytes`` or one longer text. Stored, so that chunks stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, room = TaskContext.get().partitionId() << 33, settings.chunk_bytes
        for batch in batches:
            out = []
            for size in map(len, batch.column("text").to_pylist()):
                if room < size and room < settings.chunk_bytes:
                    chunk, room = chunk + 1, settings.chunk_bytes
                room -= size
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("text"), pa.array(out, pa.int64())], ["lang", "text", "chunk"])

    return stored(texts.mapInArrow(run, "lang string, text binary, chunk long"), "chunks")


def chunk_grams(chunks: DataFrame, words: DataFrame, layout: Layout, settings: Settings) -> DataFrame:
    """Counted keys by chunk; each chunk meets the numbers of its own words, so no task holds the dictionary."""
    held = word_counts(chunks, settings, "chunk").where("word is not null").select("lang", "word", F.col("part").alias("chunk")).distinct()
    slices = held.join(words.select("lang", "word", "id"), ["lang", "word"])

    def run(key: tuple, texts: pa.Table, own: pa.Table) -> pa.Table:
        ids: dict[str, dict[bytes, int]] = {}
        for lang, word, number in zip(own.column("lang").to_pylist(), own.column("word").to_pylist(), own.column("id").to_pylist(), strict=True):
            ids.setdefault(lang, dict(BREAKS))[word] = number
        grams, out = Grams(layout, settings.keys), []
        for batch in texts.to_batches():
            for lang, raw in by_lang(batch):
                out += grams.add(numbered(raw, ids.get(lang, BREAKS)))
        out += grams.flush()
        return pa.Table.from_batches(out, pa.schema([("key", pa.int64() if layout.narrow else pa.binary()), ("c", pa.int64())]))

    return chunks.groupBy("chunk").cogroup(slices.groupBy("chunk")).applyInArrow(run, f"key {layout.type}, c long")


def added_up(grams: DataFrame, layout: Layout, at_least: int) -> DataFrame:
    """``key, f`` of the frequent keys: range partitions, each sorted by key, and the sums of its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[np.ndarray, np.ndarray] | None = None  # the open run

        def told(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            fine = counts >= at_least
            return pa.RecordBatch.from_arrays([layout.arrow(keys[fine]), pa.array(counts[fine])], ["key", "f"])

        for batch in batches:
            keys, counts = layout.numpy(batch.column(0)), batch.column(1).to_numpy()
            if last is not None:
                keys, counts = np.concatenate([last[0], keys]), np.concatenate([last[1], counts])
            keys, counts = runs(keys, counts)
            if len(keys):
                last = keys[-1:], counts[-1:]
                yield told(keys[:-1], counts[:-1])
        if last is not None:
            yield told(*last)

    spread = grams.repartitionByRange(partitions(grams.sparkSession), "key").sortWithinPartitions("key")
    return spread.mapInArrow(run, f"key {layout.type}, f long")


def joined(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    counts = left.groupBy(key).agg(F.count("*").alias("n"))
    total = left.count()
    return spread_join(left, right, key, counts, total, by, how)


def scored(frequent: DataFrame, words: DataFrame, layout: Layout, settings: Settings) -> DataFrame:
    """``key, a, k, l, r, score`` of the candidates that no longer one covers."""
    key = F.col("key")
    size = layout.words(key)
    parts = frequent.where(size < layout.longest).unionByName(words.where("word is not null").select(layout.one(F.col("id")).alias("key"), "f"))
    cuts = None
    for k in range(1, layout.longest):
        some = frequent.where(size > k).select("key", F.col("f").alias("a"), F.lit(k).alias("k"), layout.first(key, k).alias("left"), layout.after(key, k).alias("right"))
        cuts = some if cuts is None else cuts.unionByName(some)
    with_left = joined(cuts, parts.select(key.alias("left"), F.col("f").alias("l")), "left", "key")
    both = joined(with_left, parts.select(key.alias("right"), F.col("f").alias("r")), "right", "key")
    # a is at most l and at most r, so the score is at most a million; products have at most 38 digits while a is below 10^16
    score = F.expr("cast((cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(18,0))) as long)")
    best = both.withColumn("score", score).groupBy("key").agg(F.min_by(F.struct("a", "k", "l", "r", "score"), F.struct("score", "k")).alias("best")).select("key", "best.*")
    covers = None
    for m in range(2, layout.longest):
        for at in range(layout.longest - m + 1):
            some = frequent.where(size >= max(m + 1, at + m)).select(layout.first(layout.after(key, at), m).alias("key"), F.col("f").alias("longer"))
            covers = some if covers is None else covers.unionByName(some)
    if covers is None:
        return best
    most = covers.groupBy("key").agg(F.max("longer").alias("longer"))
    return best.join(most, "key", "left").where(f"longer is null or 100 * longer < {settings.covered} * a").drop("longer")


def phrases(documents: DataFrame, settings: Settings = Settings(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The best collocations of each language, as the columns of ``OUT``.

    A null language is ``und``, a null or empty text holds no word, and other columns are not read, so their names and
    nulls don't matter. Repeated rows count each time. Very long texts are read whole and numbered in slices. Equal scores
    are ordered by how often the phrase occurs, then by its bytes. An empty table gives no rows.
    """
    spark, texts = documents.sparkSession, prepared(documents, lang_col, text_col)
    words = dictionary(word_counts(texts, settings), settings)
    known = words.where("word is not null").agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)), F.max("id")).first()
    if not known[0]:
        return spark.createDataFrame([], OUT)
    layout = Layout(settings.longest, int(known[2]).bit_length(), settings.long_bits)
    if known[0] <= settings.broadcast_words and known[1] <= settings.broadcast_bytes:
        grams = stored(broadcast_grams(texts, words, layout, settings), "grams")
    else:
        chunks = chunked(texts, settings)
        grams = stored(chunk_grams(chunks, words, layout, settings), "grams")
        discard(chunks)
    frequent = stored(added_up(grams, layout, settings.at_least), "frequent")
    discard(grams)
    found = stored(scored(frequent, words, layout, settings), "scored")
    discard(frequent)
    named = words.where("word is not null").select("id", "lang", F.col("word").cast("string").alias("word"))
    firsts = found.withColumn("one", layout.first(F.col("key"), 1))
    own = joined(firsts, named.select(layout.one(F.col("id")).alias("one"), "lang"), "one", "key").drop("one")
    # ties at the end of a language's list are settled by the phrase, so all of them are spelt out
    near = stored(own.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= settings.first).drop("place"), "near")
    discard(found)
    places = None
    for k in range(layout.longest):
        some = near.where(layout.words(F.col("key")) > k).select("key", F.lit(k).alias("at"), layout.first(layout.after(F.col("key"), k), 1).alias("one"))
        places = some if places is None else places.unionByName(some)
    spelt = joined(places, named.select(layout.one(F.col("id")).alias("one"), "word"), "one", "key")
    spelt = spelt.groupBy("key").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])).alias("phrase"))
    totals = words.where("word is null").select("lang", F.col("f").alias("n"))  # a row for each language
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = near.join(spelt, "key").withColumn("rank", place).where(F.col("rank") <= settings.first)
    out = stored(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    for table in (near, words):
        discard(table)
    return out


def op13_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(read_table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, 1 AS m, unnest(ws) AS phrase FROM w UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w
      UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 10),
cuts AS (SELECT lang, m, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM c, (VALUES (1), (2)) k(k) WHERE k < m),
s AS (SELECT cuts.*, x.f AS l, y.f AS r, 1000000 * CAST(a AS HUGEINT) * a // (CAST(x.f AS HUGEINT) * y.f) AS score FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE m = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE m = 3),
h AS (SELECT lang, phrase, max(a) AS longer FROM o GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE b.m = 3 OR longer IS NULL OR 100 * longer < 50 * b.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT r.lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r.r, n, CAST(score AS BIGINT) AS score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""
