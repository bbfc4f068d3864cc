"""Removal of repeated passages by sorting suffixes, deep-shallow fashion.

Wanted: every 50-byte string of a document that also starts in a document with a smaller id. All such
strings are found without sorting the corpus in one place:

1. Every 50-byte window picks an anchor: the least hash among its 20-byte strings. Equal windows pick
   equal anchors, and neighbouring windows mostly the same, so a run of windows is one record: its
   anchor, a fingerprint of its whole context (the bytes that its windows cover), document and place.
   A task hands on one record for each (anchor, context), that of the smallest document; the others lie
   in a larger document than a copy of the same bytes, so their bytes are known to go.
2. Records meet by anchor. Equal contexts leave the smallest document; where different contexts share an
   anchor, their bytes are fetched, one copy of each context.
3. The suffixes that start at those contexts' windows are sorted to a depth of 50 bytes: multikey
   quicksort on eight-byte characters down to a shallow depth, then a blind trie for each group that
   still shares its prefix. Runs of equal 50-byte prefixes give each window's smallest document.

Records travel as packed arrays, one for each task and part that share any, so a shuffle moves about twenty
bytes a record and never more rows than records. The number of parts follows the bytes of the texts, not the
session's partitions. No key is gathered whole: copies are combined before the shuffle, and an anchor with
very many contexts is split by its windows' hashes, of which each task sends the smallest document's only.

Two contexts count as equal if the 48 bits of their anchor and the 64 bits of their fingerprint are; the
windows of all other contexts are compared byte by byte. Of n records that share an anchor by pairs some
n * crowd / 2, a wrong match has the chance n * crowd / 2**65: below one in a thousand for 10**13 records
(a hundred terabytes) at a mean crowd of 1000.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import bounded_batches, mixed, read_table, stored, text_bytes, unused, utf8


@dataclass(frozen=True)
class Settings:
    length: int = 50
    anchor: int = 20
    #: bytes that the quicksort orders before blind tries take over; a multiple of 8
    shallow: int = 32
    #: different contexts of one anchor beyond which its windows are split by hash
    crowd: int = 4096
    #: text bytes of one part at first; parts grow to sixteen times that before there are more than 20,000 of them
    part_bytes: int = 1 << 22

    def parts(self, total: int) -> int:
        size = max(self.part_bytes, min(16 * self.part_bytes, total // 20_000))
        return max(1, -(-total // size))


PIECE = 1 << 19
NONE = np.iinfo(np.int64).max

# ---------------------------------------------------------------- anchors


def rolled(raw: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n``-byte string, built by doubling."""
    have = {1: mixed(raw.astype(np.uint64) + np.uint64(1))}
    size = 1
    while size * 2 <= n:
        h = have[size]
        have[size * 2] = _joined(h[: len(h) - size], h[size:])
        size *= 2
    done, out = size, have[size]
    while done < n:
        step = max(s for s in have if s <= n - done)
        m = len(raw) - done - step + 1
        out = _joined(out[:m], have[step][done : done + m])
        done += step
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    return x ^ (x >> np.uint64(29))


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    out, size = h, 1
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    if size < width:
        rest = width - size
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


def runs(raw: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in one document: (anchor, context, start, windows). No run is longer than the
    windows that one anchor can serve, so contexts are bounded."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(raw) < s.length:
        return none
    reach = s.length - s.anchor + 1
    parts = []
    for at in range(0, len(raw) - s.length + 1, PIECE):
        piece = raw[at : at + PIECE + s.length - 1]
        sixteen = rolled(piece, 16)
        tail = s.anchor - 16
        keys = _joined(sixteen[: len(piece) - s.anchor + 1], rolled(piece, tail)[16 : 16 + len(piece) - s.anchor + 1]) if tail else sixteen
        least = sliding_least(mixed(keys), reach)
        edge = np.flatnonzero(least[1:] != least[:-1]) + 1
        start = np.concatenate([[0], edge])
        count = np.diff(np.concatenate([start, [len(least)]]))
        if count.max() > reach:  # repetitive text: the same anchor again and again
            cut = [(b, min(reach, n - k)) for b0, n in zip(start.tolist(), count.tolist(), strict=True) for k in range(0, n, reach) for b in (b0 + k,)]
            start, count = (np.array(x) for x in zip(*cut, strict=True))
        end = start + count + s.length - 1
        context = mixed(count.astype(np.uint64) + np.uint64(77))
        for at_block in (start, start + 16, start + 32, end - 32, end - 16):
            context = _joined(context, sixteen[at_block])
        parts.append((mixed(least[start] + np.uint64(5)) & np.uint64((1 << 48) - 1), mixed(context), start + at, count))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


#: An anchor's 48 bits decide who meets (a chance meeting costs a comparison only); contexts are equal if both fields are.
RECORD = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("start", "<u4"), ("windows", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("start", "<u4"), ("end", "<u4")])
WANT = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("anchor", "<u8"), ("crowd", "<u4"), ("start", "<u4"), ("windows", "u1")])


def packed(rows: np.ndarray) -> bytes:
    """Rows in order of document and place, column after column: differences for what rises, six bytes for anchors, and
    compression for all but the hashes."""
    names = rows.dtype.names
    rows = rows[np.lexsort((rows["start"], rows["doc"]))]
    plain, steps = [], []
    for k in names:
        x = np.ascontiguousarray(rows[k])
        if k == "anchor":
            plain.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
        elif k == "context":
            plain.append(x.tobytes())
        else:
            steps.append(np.diff(x, prepend=x.dtype.type(0)).tobytes() if k != "windows" else x.tobytes())
    small = zstandard.ZstdCompressor(level=1).compress(b"".join(steps))
    return len(rows).to_bytes(8, "little") + len(small).to_bytes(8, "little") + small + b"".join(plain)


def unpacked(data: bytes, kind: np.dtype) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    out = np.empty(n, kind)
    small, at, low = zstandard.ZstdDecompressor().decompress(data[16 : 16 + size]), 16 + size, 0
    for k in kind.names:
        if k == "anchor":
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(n, 6)
            out[k], at = wide.reshape(-1).view("<u8"), at + 6 * n
        elif k == "context":
            out[k], at = np.frombuffer(data, "<u8", n, at), at + 8 * n
        else:
            x = np.frombuffer(small, kind[k], n, low)
            out[k], low = np.cumsum(x, dtype=x.dtype) if k != "windows" else x, low + kind[k].itemsize * n
    return out


def least_of_groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records sorted by anchor, context and document, and for each the smallest document of its (anchor, context)."""
    rows = rows[np.lexsort((rows["doc"], rows["context"], rows["anchor"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["context"][1:] != rows["context"][:-1])
    return rows, rows["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]


def stretches(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """Each value of a sorted array, with the start and end of its stretch."""
    if not len(sorted_):
        return []
    cuts = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)]])
    return list(zip(sorted_[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def spans_of(rows: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(rows), SPAN)
    out["doc"], out["tag"], out["start"] = rows["doc"], rows["tag"], rows["start"]
    out["end"] = rows["start"] + (rows["windows"].astype(np.uint32) + np.uint32(length - 1))
    return out


def merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching spans of a document as one."""
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans["start"], spans["tag"], spans["doc"]))]
    own = np.concatenate([[True], (spans["doc"][1:] != spans["doc"][:-1]) | (spans["tag"][1:] != spans["tag"][:-1])])
    group = np.cumsum(own).astype(np.int64) << 33
    reach = np.maximum.accumulate(group + spans["end"])
    new = own.copy()
    new[1:] |= (group[1:] + spans["start"][1:]) > reach[:-1]
    first = np.flatnonzero(new)
    out = spans[first]
    out["end"] = (reach[np.concatenate([first[1:] - 1, [len(spans) - 1]])] - group[first]).astype(np.uint32)
    return out


# ---------------------------------------------------------------- deep-shallow sorting


#: Groups of at most so many suffixes are ordered by all their remaining characters at once.
SMALL = 512


def multikey(words: np.ndarray, order: np.ndarray, depth: int, upto: int) -> list[tuple[int, int]]:
    """Multikey quicksort of ``order`` by the columns ``depth`` to ``upto`` of ``words`` (rows of eight-byte characters):
    three-way partitioning on one character at a time. Sorts in place; returns the groups that are equal throughout."""
    equal: list[tuple[int, int]] = []
    todo = [(0, len(order), depth)]
    while todo:
        lo, hi, d = todo.pop()
        if hi - lo < 2:
            continue
        if d == upto:
            equal.append((lo, hi))
            continue
        own = order[lo:hi]
        if hi - lo <= SMALL:  # small: order all remaining characters at once
            rest = words[own, d:upto]
            by = np.lexsort(rest.T[::-1])
            order[lo:hi] = own[by]
            rest = rest[by]
            edge = np.flatnonzero((rest[1:] != rest[:-1]).any(axis=1)) + 1
            first = np.concatenate([[0], edge])
            last = np.concatenate([edge, [hi - lo]])
            some = np.flatnonzero(last - first > 1)
            equal += zip((lo + first[some]).tolist(), (lo + last[some]).tolist(), strict=True)
            continue
        key = words[own, d]
        a, b, c = key[0], key[len(key) // 2], key[-1]
        pivot = max(min(a, b), min(max(a, b), c))
        less, same = key < pivot, key == pivot
        n_less, n_same = int(less.sum()), int(same.sum())
        order[lo:hi] = np.concatenate([own[less], own[same], own[~(less | same)]])
        todo += [(lo, lo + n_less, d), (lo + n_less, lo + n_less + n_same, d + 1), (lo + n_less + n_same, hi, d)]
    return equal


class BlindTrie:
    """A blind trie over strings of one length: inner nodes hold only the depth at which their branches part and the byte
    each branch begins with. To insert a string, go down blindly to a leaf, compare with that leaf's string once to find
    where they part, and open the path there. Equal strings share a leaf."""

    __slots__ = ("root", "strings")

    def __init__(self):
        self.root, self.strings = None, []

    def insert(self, string: bytes) -> int:
        """The string's leaf: the number of the first equal string."""
        node = self.root
        if node is None:
            self.strings.append(string)
            self.root = 0
            return 0
        while node.__class__ is list:
            branches = node[1]
            nxt = branches.get(string[node[0]])
            node = nxt if nxt is not None else next(iter(branches.values()))
        other = self.strings[node]
        if other == string:
            return node
        lo, hi = 0, len(string)
        while lo < hi:  # the first byte at which they part
            mid = (lo + hi + 1) >> 1
            if string[:mid] == other[:mid]:
                lo = mid
            else:
                hi = mid - 1
        leaf = len(self.strings)
        self.strings.append(string)
        node, parent = self.root, None
        while node.__class__ is list and node[0] < lo:
            parent, node = node, node[1][string[node[0]]]
        if node.__class__ is list and node[0] == lo:
            node[1][string[lo]] = leaf
        else:
            fork = [lo, {other[lo]: node, string[lo]: leaf}]
            if parent is None:
                self.root = fork
            else:
                parent[1][string[parent[0]]] = fork
        return leaf

    def ordered(self) -> list[int]:
        """Leaves in the order of their strings."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if node.__class__ is list:
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
            elif node is not None:
                out.append(node)
        return out


def deep_shallow(text: np.ndarray, starts: np.ndarray, length: int, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``length`` bytes, and for each in that order whether it differs
    from the one before."""
    n, width = len(starts), -(-shallow // 8)
    words = np.empty((n, width), np.uint64)
    for k in range(width):
        word = np.zeros(n, np.uint64)
        for j in range(8):
            word = (word << np.uint64(8)) | text[starts + (8 * k + j)]
        words[:, k] = word
    order = np.arange(n)
    groups = multikey(words, order, 0, width)
    new = np.ones(n, bool)
    body = text.tobytes()
    for lo, hi in groups:
        trie, leaves = BlindTrie(), []
        own = order[lo:hi].tolist()
        for i in own:
            at = int(starts[i])
            leaves.append(trie.insert(body[at + shallow : at + length]))
        rank = {leaf: k for k, leaf in enumerate(trie.ordered())}
        by = sorted(range(hi - lo), key=lambda k: rank[leaves[k]])
        order[lo:hi] = [own[k] for k in by]
        for k in range(1, hi - lo):
            if leaves[by[k]] == leaves[by[k - 1]]:
                new[lo + k] = False
    return order, new


# ---------------------------------------------------------------- the job


def mark_of(text_col: str) -> Column:
    """The text's 64-bit hash, never null: tells rows of one id apart."""
    return F.xxhash64(text_col)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """``docs`` with the join key of its rows, and the key's two names. Both joins read exactly this, so that Spark shuffles
    the texts once for both. A null id becomes the smallest long: nothing is ever removed from the smallest id."""
    key, mark = unused(docs, "key", "mark")
    return docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), mark: mark_of(text_col)}), key, mark


def matched(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, value: str, how: str) -> DataFrame:
    """``docs`` joined with the column ``value`` of ``found`` (``id, tag`` and that), whose name must not be one of theirs."""
    left, key, mark = keyed(docs, id_col, text_col)
    other_id, other_tag = unused(left, "other_id", "other_tag")
    side = found.select(F.col("id").alias(other_id), F.col("tag").alias(other_tag), value)
    return left.join(side, (left[key] == side[other_id]) & (left[mark] == side[other_tag]), how)


def document_spans(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """``id, tag, spans``: packed spans of removed bytes per document; documents without any are missing."""
    spark = docs.sparkSession
    bounded_batches(spark)
    length, table = s.length, docs.where(F.col(id_col).isNotNull())
    n_parts = s.parts(table.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)
    rows = table.select(F.col(id_col).cast("long").alias("id"), mark_of(text_col).alias("tag"), text_bytes(text_col).alias("data")).where(F.octet_length("data") >= length)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows, least = least_of_groups(np.concatenate(held))
            keep = rows["doc"] == least
            gone = merged(spans_of(rows[~keep], length))
            kept = rows[keep]
            part = (kept["anchor"] % np.uint64(n_parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            kept, part = kept[by], part[by]
            blobs = [(p, packed(kept[a:b]), b"") for p, a, b in stretches(part)]
            if len(gone):
                blobs.append((int(kept["doc"][0]) % n_parts, b"", packed(gone)))
            for at in range(0, len(blobs), 32):
                p, r, g = zip(*blobs[at : at + 32], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(r, pa.binary()), pa.array(g, pa.binary())], ["part", "records", "gone"])

        for batch in batches:
            raw, offs = utf8(batch.column(2))
            for i, (doc, mark) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                anchor, context, start, windows = runs(raw[offs[i] : offs[i + 1]], s)
                own = np.empty(len(anchor), RECORD)
                own["anchor"], own["context"], own["doc"], own["tag"], own["start"], own["windows"] = anchor, context, doc, mark, start, windows
                held.append(own)
                size += len(own)
                if size > 1_500_000:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    def meet(table: pa.Table) -> pa.Table:
        """Records of one hash partition: spans known to go, and contexts whose suffixes must be sorted."""
        gone = [unpacked(x, SPAN) for x in table["gone"].to_pylist() if x]
        parts = [unpacked(x, RECORD) for x in table["records"].to_pylist() if x]
        want = np.zeros(0, WANT)
        if parts:
            rows, least = least_of_groups(np.concatenate(parts))
            del parts
            keep = rows["doc"] == least
            gone.append(spans_of(rows[~keep], length))
            rows = rows[keep]
            new = np.ones(len(rows), bool)
            new[1:] = rows["anchor"][1:] != rows["anchor"][:-1]
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            low, high = np.minimum.reduceat(rows["doc"], first), np.maximum.reduceat(rows["doc"], first)
            fresh = np.ones(len(rows), bool)
            fresh[1:] = new[1:] | (rows["context"][1:] != rows["context"][:-1])
            contexts = np.add.reduceat(fresh.astype(np.int64), first)
            rows, crowd = rows[(low < high)[group]], contexts[group][(low < high)[group]]
            want = np.empty(len(rows), WANT)
            for k in ("doc", "tag", "anchor", "start", "windows"):
                want[k] = rows[k]
            want["crowd"] = np.minimum(crowd, 2**32 - 1)
        return dealt(merged(np.concatenate(gone)) if gone else np.zeros(0, SPAN), want)

    def dealt(spans: np.ndarray, want: np.ndarray) -> pa.Table:
        """Rows for the buckets of their documents, one packed row a bucket."""
        blobs: dict[int, list[bytes | None]] = {}
        for k, rows in enumerate((spans, want)):
            bucket = (mixed(rows["doc"].astype(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            rows, bucket = rows[by], bucket[by]
            for p, a, b in stretches(bucket):
                blobs.setdefault(p, [None, None])[k] = packed(rows[a:b])
        return pa.table({"bucket": pa.array(list(blobs), pa.int32()), "spans": pa.array([b[0] for b in blobs.values()], pa.binary()), "want": pa.array([b[1] for b in blobs.values()], pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        """One row a document: its merged spans and what it must be asked for."""
        blobs: dict[tuple[int, int], list[bytes | None]] = {}
        for k, (name, kind) in enumerate((("spans", SPAN), ("want", WANT))):
            parts = [unpacked(x, kind) for x in table[name].to_pylist() if x]
            if not parts:
                continue
            rows = np.concatenate(parts)
            rows = merged(rows) if k == 0 else rows[np.lexsort((rows["start"], rows["tag"], rows["doc"]))]
            edge = np.flatnonzero((rows["doc"][1:] != rows["doc"][:-1]) | (rows["tag"][1:] != rows["tag"][:-1])) + 1
            cuts = [0, *edge.tolist(), len(rows)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    blobs.setdefault((int(rows["doc"][a]), int(rows["tag"][a])), [None, None])[k] = packed(rows[a:b])
        ids, tags = zip(*blobs, strict=True) if blobs else ((), ())
        return pa.table({"id": pa.array(ids, pa.int64()), "tag": pa.array(tags, pa.int64()), "spans": pa.array([b[0] for b in blobs.values()], pa.binary()), "want": pa.array([b[1] for b in blobs.values()], pa.binary())})

    def gathered(buckets: DataFrame) -> DataFrame:
        return buckets.repartition(n_parts, "bucket").groupBy("bucket").applyInArrow(gather, "id long, tag long, spans binary, want binary")

    records = rows.mapInArrow(anchors, "part int, records binary, gone binary").repartition(n_parts, "part")
    met = stored(gathered(records.groupBy("part").applyInArrow(meet, "bucket int, spans binary, want binary")), "met")
    wanted = met.where("want is not null").select("id", "tag", "want")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut the contexts out of the texts and deal them to buckets. Of equal windows of a crowded anchor a task hands on
        the smallest document's; the others lie in a larger document, so they are known to go."""
        held: dict[int, list[tuple]] = {}
        least: dict[bytes, int] = {}
        crowded: list[tuple] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            gone: dict[int, list[tuple]] = {}
            for doc, mark, at, window in crowded:
                bucket = int.from_bytes(hashlib.blake2b(window, digest_size=6).digest(), "little") % n_parts
                if doc == least[window]:
                    held.setdefault(bucket, []).append((doc, mark, at, window))
                else:
                    gone.setdefault(bucket, []).append((doc, mark, at, at + length))
            for bucket in held.keys() | gone.keys():
                doc, mark, start, text = zip(*held.get(bucket, ()), strict=True) if bucket in held else ((), (), (), ())
                columns = np.array(doc, "<i8"), np.array(mark, "<i8"), np.array(start, "<u4"), np.array([len(x) for x in text], "<u2")
                known = packed(merged(np.array(gone[bucket], SPAN))) if bucket in gone else b""
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in columns), pa.array([b"".join(text)], pa.binary()), pa.array([known], pa.binary())], ["bucket", "docs", "tags", "starts", "sizes", "texts", "gone"])

        for batch in batches:
            ids, marks, texts, asked = (batch.column(k) for k in place)
            raw, offs = utf8(texts)
            for i, (doc, mark, wants) in enumerate(zip(ids.to_pylist(), marks.to_pylist(), asked.to_pylist(), strict=True)):
                whole = raw[offs[i] : offs[i + 1]].tobytes()
                for w in unpacked(wants, WANT).tolist():
                    _, _, anchor, crowd, start, windows = w
                    size += windows + length
                    if crowd <= s.crowd:
                        held.setdefault(anchor // n_parts % n_parts, []).append((doc, mark, start, whole[start : start + windows + length - 1]))
                        continue
                    size += windows * length
                    for at in range(start, start + windows):
                        window = whole[at : at + length]
                        crowded.append((doc, mark, at, window))
                        least[window] = min(least.get(window, doc), doc)
                if size > 24_000_000:
                    yield from out()
                    held, least, crowded, size = {}, {}, [], 0
        yield from out()

    (want,) = unused(docs, "want")
    joined = matched(docs, wanted.withColumnRenamed("want", want), id_col, text_col, want, "inner")
    width = len(docs.columns)
    place = [width, width + 1, docs.columns.index(text_col), joined.columns.index(want)]
    contexts = joined.mapInArrow(fetch, "bucket int, docs binary, tags binary, starts binary, sizes binary, texts binary, gone binary")

    def sort(table: pa.Table) -> pa.Table:
        col = lambda k, kind: np.concatenate([np.frombuffer(x, kind) for x in table[k].to_pylist()])
        doc, mark, start, size = col("docs", "<i8"), col("tags", "<i8"), col("starts", "<u4").astype(np.int64), col("sizes", "<u2").astype(np.int64)
        text = np.frombuffer(b"".join(table["texts"].to_pylist()), np.uint8)
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        n_windows = size - length + 1
        owner = np.repeat(np.arange(len(doc)), n_windows)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        order, new = deep_shallow(text, base[owner] + inner, length, s.shallow)
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(doc[owner[order]], first)[np.cumsum(new) - 1] if len(order) else np.zeros(0, np.int64)
        gone = order[least < doc[owner[order]]]
        spans = np.empty(len(gone), SPAN)
        spans["doc"], spans["tag"] = doc[owner[gone]], mark[owner[gone]]
        spans["start"] = start[owner[gone]] + inner[gone]
        spans["end"] = spans["start"] + np.uint32(length)
        known = [unpacked(x, SPAN) for x in table["gone"].to_pylist() if x]
        return dealt(merged(np.concatenate([spans, *known])), np.zeros(0, WANT))

    sorted_ = gathered(contexts.repartition(n_parts, "bucket").groupBy("bucket").applyInArrow(sort, "bucket int, spans binary, want binary"))
    every = met.where("spans is not null").select("id", "tag", "spans").unionByName(sorted_.select("id", "tag", "spans"))
    return every.groupBy("id", "tag").agg(F.collect_list("spans").alias("spans"))


def remove_repeats(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``kept`` (the bytes that stay, concatenated) and ``removed`` (start and end of each maximal removed run,
    in bytes of the UTF-8 text). A null text counts as empty. A row with a null id is neither smaller nor larger than
    others: it stays whole and removes nothing. Rows of equal id don't remove each other's bytes; equal rows fare alike.
    Texts shorter than the length stay whole, an empty table stays empty. A long text is read in pieces and its records are
    dealt out like those of many texts. Columns named ``kept`` and ``removed`` are replaced; all others stay as they are.
    """
    base = docs.drop("kept", "removed")
    (spans,) = unused(base, "spans")
    found = document_spans(base, settings, id_col, text_col).withColumnRenamed("spans", spans)
    joined = matched(base, found, id_col, text_col, spans, "left").select(*base.columns, spans)
    at = base.columns.index(text_col)
    width = len(base.columns)
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for text, blobs in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist(), strict=True):
                data = (text or "").encode()
                rows = merged(np.concatenate([unpacked(x, SPAN) for x in blobs])) if blobs else np.zeros(0, SPAN)
                cuts = list(zip(rows["start"].tolist(), rows["end"].tolist(), strict=True))
                edges = [0, *(x for c in cuts for x in c), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                removed.append([{"start": a, "end": b} for a, b in cuts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(kept, pa.binary()), pa.array(removed, pairs)], [*batch.schema.names[:width], "kept", "removed"])

    schema = base.select("*", F.lit(b"").alias("kept"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))).alias("removed")).schema
    return joined.mapInArrow(run, schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    lengths = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return out.select("doc_id", (F.octet_length("kept") + lengths).cast("long").alias("n_bytes"), lengths.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
