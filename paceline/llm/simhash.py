"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are made per document in one map-only pass. Distinct fingerprints are cut into tiles by
their population count; two fingerprints within Hamming radius r have population counts within r, so
only tile pairs whose counts differ by at most r are compared, with numpy exclusive-or and bit counts.
A tile pair returns a spanning forest of its links, not all of them, so a group of many near copies
costs as many rows as it has fingerprints, and components stay exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from paceline.llm.common import bounded_batches, components, contracted, discard, mixed, partitions, read_table, spread_join, stored, unused

NUMBERS = (ByteType, ShortType, IntegerType, LongType)

#: Fingerprints of one tile, on average.
TILE = 8192
ROWS = 64


def fingerprint(data: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of UTF-8 bytes: ASCII letters lower-cased, words split at ASCII white space, shingles of ``width``
    words joined by spaces, repeats counted. Fewer words than ``width``: the whole sequence is one shingle. None: 0."""
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words)
    if n <= width:
        return xxhash.xxh64_intdigest(line, seed)
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate([[0], spaces + 1])[: n - width + 1].tolist()
    ends = np.concatenate([spaces, [len(line)]])[width - 1 :].tolist()
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(line[i:j], seed) for i, j in zip(starts, ends, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp`` per row; fp is the fingerprint as a signed long. A null or blank text has fingerprint 0."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x or b"", width, seed) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.encode(F.col(text_col), "UTF-8").alias("data")).mapInArrow(run, f"{id_col} {kind}, fp long")


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``radius`` inside tile ``a`` (b is None), or between tiles ``a`` and ``b``."""
    every = a if b is None else np.concatenate([a, b])
    shift = 0 if b is None else len(a)
    label = np.arange(len(every))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    left: list[int] = []
    right: list[int] = []
    other = every[shift:]
    for at in range(0, len(a), ROWS):
        first = at + 1 if b is None else 0  # below the diagonal each pair has been met
        if first >= len(other):
            break
        near = np.bitwise_count(a[at : at + ROWS, None] ^ other[None, first:]) <= radius
        for r in np.flatnonzero(near.any(axis=1)).tolist():
            me = at + r
            hit = np.flatnonzero(near[r]) + first + shift
            hit = hit[hit != me]
            if not len(hit):
                continue
            mine = root(int(label[me]))
            for x in np.unique(label[hit]).tolist():
                x = root(x)
                if x != mine:
                    left.append(x)
                    right.append(mine)
                    low, high = min(x, mine), max(x, mine)
                    parent[high] = low
                    mine = low
            label[hit] = mine
            label[me] = mine
    return every[left], every[right]


def bands(per_count: dict[int, int], tile: int) -> tuple[dict[int, int], list[tuple[int, int, int]]]:
    """Neighbouring population counts put together until they fill a tile: the band of each count, and for each band its
    least and largest count and the number of tiles it is cut into. ``per_count`` is bounded by the fingerprint's width."""
    band_of: dict[int, int] = {}
    found: list[list[int]] = []
    for ones in sorted(per_count):
        if not found or found[-1][2] + per_count[ones] > tile:
            found.append([ones, ones, 0])
        found[-1][1] = ones
        found[-1][2] += per_count[ones]
        band_of[ones] = len(found) - 1
    return band_of, [(lo, hi, -(-n // tile)) for lo, hi, n in found]


def tile_pairs(rows: DataFrame, key: str, ones: str, radius: int, tile: int) -> DataFrame | None:
    """``rows`` dealt to the tile pairs that may hold links: ``pair``, ``first`` (the row's tile is the pair's first), ``same``
    (a tile with itself) and the columns of ``rows``. Tiles hold ``tile`` rows on average, of like population counts; pairs
    whose counts differ by more than ``radius`` throughout are skipped. None if there are no rows."""
    per_count = {r[0]: r[1] for r in rows.groupBy(ones).count().collect()}  # a row a population count
    if not per_count:
        return None
    band_of, found = bands(per_count, tile)
    reach = [(next(k for k, o in enumerate(found) if o[1] >= lo - radius), max(k for k, o in enumerate(found) if o[0] <= hi + radius)) for lo, hi, _ in found]
    lookup = lambda x: F.create_map(*[F.lit(v) for kv in x.items() for v in kv])
    tiles_of = lookup({k: n for k, (_, _, n) in enumerate(found)})
    low, high = (lookup({k: r[side] for k, r in enumerate(reach)}) for side in (0, 1))
    dealt = rows.withColumn("band", lookup(band_of)[F.col(ones)]).withColumn("part", F.pmod(F.xxhash64(key), tiles_of[F.col("band")]).cast("int"))
    partners = F.flatten(F.transform(F.sequence(low[F.col("band")], high[F.col("band")]), lambda b: F.transform(F.sequence(F.lit(0), tiles_of[b] - 1), lambda k: F.struct(b.alias("band"), k.alias("part")))))
    both = dealt.withColumn("mine", F.struct("band", "part")).withColumn("other", F.explode(partners)).withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    return both.select(F.concat_ws(":", "lo.band", "lo.part", "hi.band", "hi.part").alias("pair"), (F.col("mine") == F.col("lo")).alias("first"), (F.col("lo") == F.col("hi")).alias("same"), *rows.columns)


def links(classes: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints in column ``fp``: within each tile pair a spanning forest."""
    spark = classes.sparkSession
    dealt = tile_pairs(classes.select("fp", F.bit_count("fp").alias("ones")), "fp", "ones", radius, tile)
    if dealt is None:
        return spark.createDataFrame([], "a long, b long")

    def compare(table: pa.Table) -> pa.Table:
        first, fps = table.column("first").to_numpy(), table.column("fp").to_numpy().view(np.uint64)
        a, b = forest(np.sort(fps[first]), None if table.column("same")[0].as_py() else np.sort(fps[~first]), radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.select("pair", "first", "same", "fp").repartition(partitions(spark, 2), "pair").groupBy("pair").applyInArrow(compare, "a long, b long")


def groups(docs: DataFrame, width: int = 4, seed: int = 42, radius: int = 4, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp, component_id`` per row; component_id is the smallest id reachable over links, itself included.

    Rows with equal fingerprints link, blank and null texts (fingerprint 0) like any other. Null ids are passed over
    when the smallest is taken; a component of null ids only has a null component_id. Repeated rows all stay.
    """
    fps = stored(fingerprints(docs, width, seed, id_col, text_col), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "classes")
    roots = components(links(classes, radius, tile))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return _labelled(fps, rooted, classes.select("fp", "n"), "fp", id_col).select(id_col, "fp", "component_id")


def _labelled(rows: DataFrame, rooted: DataFrame, counts: DataFrame, key: str, id_col: str) -> DataFrame:
    """``rows`` with ``component_id``, the least id (column ``least``) of all keys with one ``root``."""
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of_key = stored(spread_join(rooted.select(key, "root"), named.select("root", "component_id"), "root", named.select("root", "n"), rooted.count(), key).select(key, "component_id"), "labels")
    return spread_join(rows, of_key, key, counts, rows.count(), id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one of the smallest id (rows with a null id stay too).

    Rows that repeat an id are told apart by their texts: of those of the smallest id the one whose text has the smallest
    hash stays, once. An id that stands in several components is kept in each of which it is the smallest. Empty texts are
    near each other and one of them stays; an empty table stays empty; other columns stay as they are, whatever their names.
    """
    return _kept(docs, lambda rows: groups(rows, id_col="id", text_col="text", **settings), id_col, text_col)


def _kept(docs: DataFrame, group: Callable[[DataFrame], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """Decides on narrow rows: each row's key is its id and the hash of its text; ``group`` gives ``id, component_id`` of
    rows ``id, text``, here an id being that pair in one sortable string."""
    key, again = unused(docs, "key", "again")
    # as hexadecimal digits with the sign turned over, ids sort as the numbers do
    shown = lambda x: F.lpad(F.hex(x), 16, "0")
    number = isinstance(docs.schema[id_col].dataType, NUMBERS)
    rank = shown(F.col(id_col).cast("long").bitwiseXOR(F.lit(-(2**63)))) if number else F.concat(F.col(id_col).cast("string"), F.lit("\u0000"))
    mark = shown(F.xxhash64(text_col))
    keyed = docs.withColumn(key, F.concat(rank, mark))
    found = group(keyed.where(F.col(id_col).isNotNull()).select(F.col(key).alias("id"), F.col(text_col).alias("text")))
    stay = found.where("id = component_id").select(F.col("id").alias(key)).distinct()
    once = keyed.join(stay, key, "left_semi").withColumn(again, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))).where(F.col(again) == 1)
    return once.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


#: Of the wide fingerprints' 256 bits, and of the first 64 of them, so many differ at most in a pair whose similarity may be 0.8
#: or more: of large sets of shingles equal but for a fifth some 39 of 256 differ, give or take 6.
WIDE, FIRST = 64, 22
WIDE_TILE = 65536


def shingle_set(data: bytes, width: int = 5, seed: int = 42) -> np.ndarray:
    """The set of the hashes of the shingles of ``width`` words, sorted; of all words if they are fewer."""
    words = data.lower().split()
    found = {xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), seed) for i in range(max(1, len(words) - width + 1))} if words else set()
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def set_key(own: np.ndarray, seed: int = 42) -> int:
    """A key of a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.astype("<u8").tobytes(), seed)).astype(np.int64))


#: Shingles are counted by so many slots of the range of their hashes, held in blocks.
SLOTS, SLOT_BLOCK = 1 << 20, 1024


def slots(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(20)).astype(np.int64) % SLOTS


def rare_shingles(own: np.ndarray, often: np.ndarray, least: float) -> np.ndarray:
    """Those shingles of a set that come first in the order by how often their slot is met, then by hash: so many that two sets with a Jaccard
    similarity of ``least`` share one of theirs, whatever the order. None where only an equal set is similar enough."""
    n = len(own)
    if n == 0 or (least * n > n - 1 and least * (n + 1) > n):
        return own[:0]
    return own[np.lexsort((own, often[slots(own)]))[: n - int(np.ceil(least * n - 1e-9)) + 1]]


def wide(own: np.ndarray, seed: int = 42) -> tuple[int, bytes]:
    """A key of a set of shingles, and its SimHash of 256 bits."""
    ones = np.zeros(256, np.int64)
    with np.errstate(over="ignore"):
        for k in range(0, len(own), 4096):
            part = np.stack([mixed(own[k : k + 4096] + np.uint64(c)) for c in (1, 2, 3, 4)], axis=1).astype("<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return set_key(own, seed), np.packbits(ones * 2 > len(own), bitorder="little").tobytes()


def near_wide(a: np.ndarray, b: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Places and distance of all pairs of near fingerprints (rows of four words) inside ``a`` or between ``a`` and ``b``, whose places follow
    those of ``a``, for so many rows of ``a`` at a time, with the first of them."""
    both = a if b is None else np.concatenate([a, b])
    shift = 0 if b is None else len(a)
    first = np.ascontiguousarray(both[shift:, 0])
    for at in range(0, len(a), ROWS):
        i, j = np.nonzero(np.bitwise_count(a[at : at + ROWS, 0, None] ^ first[None]) <= FIRST)
        i, j = i + at, j + shift
        if b is None:
            i, j = i[i < j], j[i < j]
        far = np.bitwise_count(both[i] ^ both[j]).sum(axis=1, dtype=np.int64)
        near = far <= WIDE
        yield at, i[near], j[near], far[near]


def wide_forest(a: np.ndarray, b: np.ndarray | None, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of near pairs of different groups: a spanning forest in which each row offers its closest of each group."""
    size = len(a) + (0 if b is None else len(b))
    label = np.unique(group, return_inverse=True)[1]
    parent = np.arange(size)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return int(x)

    left, right = [], []
    for at, i, j, far in near_wide(a, b):
        other = label[i] != label[j]
        i, j, far = i[other], j[other], far[other]
        order = np.lexsort((far, i))
        i, j = i[order], j[order]
        cuts = np.searchsorted(i, np.arange(at, min(at + ROWS, len(a)) + 1))
        for me, x0, x1 in zip(range(at, at + ROWS), cuts[:-1].tolist(), cuts[1:].tolist(), strict=False):
            if x0 == x1:
                continue
            hit = j[x0:x1]
            mine = root(int(label[me]))
            for x, k in zip(*(y.tolist() for y in np.unique(label[hit], return_index=True)), strict=True):
                if (x := root(x)) != mine:
                    left.append(me)
                    right.append(int(hit[k]))
                    parent[x] = mine
            label[hit] = label[me] = mine
    return np.array(left, np.int64), np.array(right, np.int64)


def order_of(far: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A number by which partners are taken in turn: by distance, then by a mixture of their keys."""
    return (far.astype(np.int64) << 54) | (mixed(keys.view(np.uint64)) >> np.uint64(10)).astype(np.int64)


#: Shingles of a set are counted by so many parts of the range of hashes.
PARTS = 512


def part_counts(own: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each part, at most 65,535, a number that then stands for any number."""
    return np.minimum(np.bincount((own % np.uint64(PARTS)).astype(np.int64), minlength=PARTS), 65_535).astype("<u2").tobytes()


def may_reach(counts: np.ndarray, sizes: np.ndarray, me: np.ndarray, other: np.ndarray, least: float) -> np.ndarray:
    """Whether two sets can have a Jaccard similarity of ``least``: they share at most the smaller count of each part. Never false for a pair that has it."""
    out = np.ones(len(me), bool)
    for low in range(0, len(me), 4096):
        i, j = me[low : low + 4096], other[low : low + 4096]
        shared = np.minimum(counts[i], counts[j])
        bound = np.where((shared == 65_535).any(axis=1), np.minimum(sizes[i], sizes[j]), shared.sum(axis=1, dtype=np.int64))
        out[low : low + 4096] = bound >= least * (sizes[i] + sizes[j] - bound) - 1e-6
    return out


def wide_next(a: np.ndarray, b: np.ndarray | None, group: np.ndarray, keys: np.ndarray, after: np.ndarray, most: int, can=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its next ``most`` near rows of other groups in turn, those behind its number ``after`` and for which ``can`` (places of both, if given) holds:
    places of both and the number."""
    size = len(keys)
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def first_few(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        me, other, turn = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((turn, me))
        me, other, turn = me[order], other[order], turn[order]
        begins = np.searchsorted(me, np.arange(size))
        few = np.arange(len(me)) - begins[me] < most if len(me) else np.zeros(0, bool)
        return me[few], other[few], turn[few]

    waiting = 0
    for _, i, j, far in near_wide(a, b):
        for me, other in ((i, j), (j, i)):
            turn = order_of(far, keys[other])
            fine = np.flatnonzero((group[me] != group[other]) & (turn > after[me]))
            if can is not None and len(fine):
                fine = fine[can(me[fine], other[fine])]
            held.append((me[fine], other[fine], turn[fine]))
            waiting += len(fine)
        if waiting > 1 << 20:  # so the rows held are bounded
            held, waiting = [first_few(held)], 0
    return first_few(held)


#: Small blocks are put together to units of so many rows, on average.
UNIT = 4096


def block_pairs(rows: DataFrame, tile: int) -> DataFrame:
    """``rows`` (with ``key`` and ``block``) dealt so that any two of one block meet, as ``pair``, ``first``, ``same`` and the other columns of ``rows``, as
    ``tile_pairs`` does. Small blocks share a unit; one of more than ``tile`` rows is a unit of its own, cut into tiles that meet two by two. A key is
    once in a unit."""
    sizes = rows.groupBy("block").agg(F.count("*").alias("n"))
    units = max(1, -(-rows.count() // min(UNIT, tile)))
    large = F.broadcast(sizes.where(F.col("n") > tile).select("block", (F.ceil(F.col("n") / tile)).cast("int").alias("parts_of")))  # at most a row a tile
    own = rows.join(large, "block", "left").withColumn("unit", F.when(F.col("parts_of").isNull(), F.concat(F.lit("u"), F.pmod(F.xxhash64("block"), F.lit(units)))).otherwise(F.col("block").cast("string")))
    own = own.drop("block").dropDuplicates(["unit", "key"]).withColumn("parts_of", F.coalesce("parts_of", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("key"), F.col("parts_of")).cast("int"))
    both = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts_of") - 1))).withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    return both.select(F.concat_ws(":", "unit", "lo", "hi").alias("pair"), (F.col("mine") == F.col("lo")).alias("first"), (F.col("lo") == F.col("hi")).alias("same"), *(c for c in rows.columns if c != "block"))


def candidates(rows: DataFrame, tile: int = WIDE_TILE) -> DataFrame:
    """Pairs ``a, b`` of near keys, from ``rows`` (``key, wide, group, block``): of each block at least a spanning forest."""
    dealt = block_pairs(rows, tile)

    def compare(table: pa.Table) -> pa.Table:
        n, keys, group, fps, _ = unpacked(table)
        i, j = wide_forest(fps[:n], None if table.column("same")[0].as_py() else fps[n:], group)
        return pa.table({"a": np.minimum(keys[i], keys[j]), "b": np.maximum(keys[i], keys[j])})

    return dealt.repartition(partitions(rows.sparkSession, 2), "pair").groupBy("pair").applyInArrow(compare, "a long, b long")


def unpacked(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a tile pair, those of its first tile (so many) first and else in an order of their keys: keys, groups, fingerprints, and the order."""
    first, keys = table.column("first").to_numpy(), table.column("key").to_numpy()
    order = np.lexsort((mixed(keys.view(np.uint64)), ~first))
    fps = np.frombuffer(b"".join(table.column("wide").to_pylist()), "<u8").reshape(-1, 4)[order]
    return int(first.sum()), keys[order], table.column("group").to_numpy()[order], fps, order


def next_partners(rows: DataFrame, most: int, tile: int = WIDE_TILE, least: float = 0.8) -> DataFrame:
    """``key, partner, turn``: for each row of ``rows`` (``key, wide, group, block, after``) its next ``most`` near rows of other groups in its block. Where rows
    have ``size`` and ``parts`` too, only those whose sets can be similar by ``least``."""
    columns = ["key", "wide", "group", "block", "after", *(c for c in ("size", "parts") if c in rows.columns)]
    dealt = block_pairs(rows.select(columns), tile)

    def compare(table: pa.Table) -> pa.Table:
        n, keys, group, fps, order = unpacked(table)
        can = None
        if "parts" in table.column_names:
            sizes = table.column("size").to_numpy()[order].astype(np.int64)
            counts = np.frombuffer(b"".join(table.column("parts").to_pylist()), "<u2").reshape(-1, PARTS)[order]
            can = lambda me, other: may_reach(counts, sizes, me, other, least)
        me, other, turn = wide_next(fps[:n], None if table.column("same")[0].as_py() else fps[n:], group, keys, table.column("after").to_numpy()[order], most, can)
        return pa.table({"key": keys[me], "partner": keys[other], "turn": turn})

    found = dealt.repartition(partitions(rows.sparkSession, 2), "pair").groupBy("pair").applyInArrow(compare, "key long, partner long, turn long")
    place = F.row_number().over(Window.partitionBy("key").orderBy("turn"))  # a few of each tile pair
    return found.withColumn("place", place).where(F.col("place") <= most).drop("place")


def _in_blocks(classes: DataFrame, blocks: DataFrame) -> DataFrame:
    """``key, wide, group, block`` of the classes in blocks (``node, root``, where a root is no node of its own or its own)."""
    of = blocks.select(F.col("node").alias("key"), F.col("root").alias("block")).union(blocks.select("root", "root")).distinct()
    return classes.select("key", "wide", "group").join(of, "key")


def similar(docs: DataFrame, least: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text", tile: int = WIDE_TILE) -> DataFrame:
    """``id_col, component_id`` per row: components of links between texts whose sets of shingles have a Jaccard similarity
    of ``least`` or more. Ids as in ``groups``, but an id must name one text, as ``keep_one_similar`` sees to.

    Two similar texts share one of their rarest fifth of shingles (``rare_shingles``: for any ``least`` that part in which they
    must), so only texts that share one of these meet, and the work grows with the texts and not with their pairs. Near
    fingerprints among them only propose; each proposed pair is confirmed on the whole sets, which are made anew for the texts
    of proposed pairs. The first round proposes a spanning forest of each set of texts that share a rare shingle, which joins
    large groups by few pairs; its components are the blocks that no similar pair crosses. Then inside its block
    each text proposes its near texts outside its own group in turn, from the closest on, in rounds of 1, 4, 16 ... at a
    time, until it has none left; it then takes no part in later rounds. From the second of these rounds on, pairs whose
    sets can't be similar by their counts of shingles in parts of the range of hashes are left out, so families that stay
    below ``least`` end soon. Every pair of near fingerprints in a block is confirmed, refuted, or inside one group already,
    and no near pair is passed over."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(id_col, F.encode(F.col(text_col), "UTF-8").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, with ``at`` null, and after them the counts of all slots that were met, in blocks numbered by ``at``."""
        met, schema = np.zeros(SLOTS, np.int64), None
        for batch in batches:
            sets = [shingle_set(x or b"", width) for x in batch.column(1).to_pylist()]
            for one in sets:
                np.add.at(met, slots(one), 1)
            own = [wide(x) for x in sets]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for k, _ in own], pa.int64()), pa.array([f for _, f in own], pa.binary()), pa.nulls(len(own), pa.int32())], [id_col, "key", "wide", "at"])
            schema = out.schema
            yield out
        held = met.reshape(-1, SLOT_BLOCK)
        some = np.flatnonzero(held.any(axis=1))
        for k in range(0, len(some), 64):
            part = some[k : k + 64]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), schema.field(0).type), pa.nulls(len(part), pa.int64()), pa.array([held[x].astype("<i8").tobytes() for x in part], pa.binary()), pa.array(part, pa.int32())], schema=schema)

    def summed(table: pa.Table) -> pa.Table:
        whole = np.sum([np.frombuffer(x, "<i8") for x in table.column("wide").to_pylist()], axis=0)
        return pa.table({"at": table.column("at").slice(0, 1), "met": pa.array([whole.astype("<i8").tobytes()], pa.binary())})

    def rare_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x or b"", width) for x in batch.column(0).to_pylist()]
            rare = [rare_shingles(x, often, least) for x in sets]
            keys = np.repeat(np.array([set_key(x) for x in sets], np.int64), list(map(len, rare)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *rare]).view(np.int64)), pa.array(keys)], ["shingle", "key"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(x or b"", width).view(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["key", "shingles"])

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(x or b"", width) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([part_counts(x) for x in own], pa.binary())], ["key", "size", "parts"])

    def confirmed(pairs: DataFrame) -> DataFrame:
        """``a, b, holds``, stored."""
        asked = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(classes, "key").select("key", F.col("least").alias(id_col))
        sets = stored(texts.join(asked, id_col).select("key", "data").mapInArrow(sets_of, "key long, shingles array<long>").dropDuplicates(["key"]), "sets")
        one, two = (sets.select(F.col("key").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab")
        common = F.size(F.array_intersect("a_set", "b_set"))
        told = stored(pairs.join(one, "a").join(two, "b").select("a", "b", (common >= least * (F.size("a_set") + F.size("b_set") - common)).alias("holds")), "told")
        discard(sets)
        return told

    def regrouped(told: DataFrame) -> DataFrame:
        """``classes`` with the groups that the links of ``told`` join; links are between members, groups are named by their roots."""
        name = classes.select("key", "group")
        ends = told.where("holds").select("a", "b").join(name.select(F.col("key").alias("a"), F.col("group").alias("x")), "a").join(name.select(F.col("key").alias("b"), F.col("group").alias("y")), "b")
        roots = components(contracted(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))))
        sizes = classes.groupBy("group").agg(F.count("*").alias("n"))
        moved = spread_join(classes, roots.withColumnRenamed("node", "group"), "group", sizes, total, "key", "left")
        return stored(moved.select("key", "least", "wide", F.coalesce("root", "group").alias("group")), "classes")

    wides = stored(texts.mapInArrow(run, f"{id_col} {kind}, key long, wide binary, at int"), "wide")
    rows = wides.where("at is null")
    classes = stored(rows.groupBy("key").agg(F.min(id_col).alias("least"), F.min("wide").alias("wide"), F.count("*").alias("n"), F.col("key").alias("group")), "classes")
    counts = stored(classes.select("key", "n"), "counts")
    total = counts.count()
    often = np.zeros((SLOTS // SLOT_BLOCK, SLOT_BLOCK), np.int64)
    for r in wides.where("at is not null").select("at", "wide").groupBy("at").applyInArrow(summed, "at int, met binary").collect():  # SLOTS numbers, however many texts
        often[r["at"]] = np.frombuffer(r["met"], "<i8")
    often = np.minimum(often, 2**31 - 1).astype(np.int32).reshape(-1)
    shared = texts.select("data").mapInArrow(rare_of, "shingle long, key long").groupBy("shingle").agg(F.array_sort(F.collect_set("key")).alias("keys")).where(F.size("keys") > 1).select("keys").distinct()
    # sets of keys of one family mostly begin with the same key, so they come to one block
    meets = stored(shared.select(F.get("keys", F.lit(0)).alias("block"), F.explode("keys").alias("key")).distinct(), "meets")
    pairs = stored(candidates(meets.join(classes.select("key", "wide", "group"), "key"), tile).distinct(), "pairs")
    discard(meets)
    blocks = stored(components(contracted(pairs)), "blocks")
    told, seen, active, parts, most, spent = confirmed(pairs), [], None, None, 1, [wides, counts, blocks]
    while True:
        discard(pairs)
        if not told.where("holds").isEmpty():  # else the groups are as they were
            before = classes
            classes = regrouped(told)
            discard(before)
        seen.append(told)
        if active is None:
            marks = stored(_in_blocks(classes, blocks), "marks")  # texts outside are in no near pair
            open_blocks = marks.groupBy("block").agg(F.min("group").alias("a"), F.max("group").alias("b")).where("a < b").select("block")
            going = marks.join(open_blocks, "block", "left_semi").withColumn("after", F.lit(-1).cast("long"))
            spent.append(marks)
        else:
            if parts is None:  # of the texts that are still active, which only become fewer
                ids = active.join(classes, "key").select("key", F.col("least").alias(id_col))
                parts = stored(texts.join(ids, id_col).select("key", "data").mapInArrow(parts_of, "key long, size long, parts binary").dropDuplicates(["key"]), "parts")
                spent.append(parts)
            going = _in_blocks(classes.join(active, "key", "left_semi"), blocks).join(active, "key").join(parts, "key")
        going = stored(going, "going")  # it is read more than once
        found = stored(next_partners(going, most, tile, least), "found")
        discard(going)
        if active is not None:
            discard(active)
        active = stored(found.groupBy("key").agg(F.max("turn").alias("after")), "active")
        asked = seen[0].select("a", "b")
        for other in seen[1:]:
            asked = asked.union(other.select("a", "b"))
        pairs = stored(found.select(F.least("key", "partner").alias("a"), F.greatest("key", "partner").alias("b")).distinct().join(asked, ["a", "b"], "left_anti"), "pairs")
        discard(found)
        if active.isEmpty():
            break
        told = confirmed(pairs)
        most *= 4  # each round costs the driver some twenty small jobs
    for table in (pairs, active, *seen):
        discard(table)
    out = stored(_labelled(rows.select(id_col, "key"), classes.select("key", "least", F.col("group").alias("root")), counts, "key", id_col).select(id_col, "component_id"), "similar")
    for table in (*spent, classes):
        discard(table)
    return out


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``keep_one`` by the components of ``similar``."""
    return _kept(docs, lambda rows: similar(rows, id_col="id", text_col="text", **settings), id_col, text_col)


def op8_simhash_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
