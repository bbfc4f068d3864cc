"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never end up inside a token,
so a cut between the two is certain. Each pre-token is cut at all such pairs; the fragments are encoded
independently of each other and their ids are concatenated. Fragments repeat far more often than
texts, so a worker keeps the ids of those it has met (a bounded memo that never changes a result).

The job is map-only: no shuffle, one small vocabulary read per Python worker from its path.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.llm.common import bounded_batches, read_table

# Fixed value: the pre-tokenisation pattern that byte-level vocabularies of this kind are built for.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's memo before it is emptied.
MEMO = 400_000
#: Texts of one output batch.
SLICE = 128


def printable_bytes() -> dict[str, int]:
    """Vocabulary files spell each byte as one printable character: itself if printable, else the next free one from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ForcedBoundaryBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = printable_bytes()
        raw = lambda piece: bytes(byte_of[c] for c in piece)
        vocab = {raw(piece): i for piece, i in spec["model"]["vocab"].items()}
        self.id_of = vocab
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for piece, i in vocab.items():
            self.bytes_of[i] = piece
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.rank = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            left, right = (raw(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank.setdefault((vocab[left], vocab[right]), (k, vocab[left + right]))
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        inside = np.zeros((256, 256), bool)
        for piece in vocab:
            a = np.frombuffer(piece, np.uint8)
            inside[a[:-1], a[1:]] = True
        #: pairs that may stand inside a token; every other pair is a forced boundary
        self.inside = frozenset(bytes(p) for p in np.argwhere(inside).astype(np.uint8))
        self.pattern = regex.compile(PRETOKEN)
        self.cut_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.of_pretoken: dict[str, bytes] = {}
        self.of_fragment: dict[bytes, tuple[int, ...]] = {}

    def fragments(self, data: bytes) -> list[bytes]:
        inside, out, start = self.inside, [], 0
        for i in range(1, len(data)):
            if data[i - 1 : i + 1] not in inside:
                out.append(data[start:i])
                start = i
        out.append(data[start:])
        return out

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Ids of one fragment: the pair of lowest rank merges first, the leftmost of equals."""
        known = self.id_of.get(data)
        ids = [self.byte_id[b] for b in data]
        if len(ids) < 2:
            return tuple(ids)
        rank = self.rank
        if len(ids) <= 48:
            while len(ids) > 1:
                best, at = None, -1
                for i in range(len(ids) - 1):
                    r = rank.get((ids[i], ids[i + 1]))
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                ids[at : at + 2] = [best[1]]
                if len(ids) == 1 and ids[0] == known:
                    break
            return tuple(ids)
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            (_, new), i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return tuple(x for x in ids if x >= 0)

    def pretoken(self, word: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        ids: list[int] = []
        for part in self.fragments(word.encode("utf-8", "surrogatepass")):
            got = self.of_fragment.get(part)
            if got is None:
                got = self.merged(part)
                if len(part) <= 64:
                    if len(self.of_fragment) >= MEMO:
                        self.of_fragment.clear()
                    self.of_fragment[part] = got
            ids.extend(got)
        packed = np.array(ids, "<u4").tobytes()
        if len(word) <= 32:
            if len(self.of_pretoken) >= MEMO:
                self.of_pretoken.clear()
            self.of_pretoken[word] = packed
        return packed

    def plain(self, text: str, out: list[bytes]) -> None:
        memo, fresh = self.of_pretoken, self.pretoken
        out += [memo.get(w) or fresh(w) for w in self.pattern.findall(text)]

    def encode(self, text: str) -> bytes:
        out: list[bytes] = []
        if self.cut_special is None or not any(x in text for x in self.special):
            self.plain(text, out)
        else:
            for part in self.cut_special.split(text):
                if part in self.special:
                    out.append(np.array([self.special[part]], "<u4").tobytes())
                elif part:
                    self.plain(part, out)
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with ``ids_col`` (binary, little-endian unsigned 32-bit ids) and ``decoded_col`` (the ids decoded again).

    A null text counts as empty and gives no ids. Strings of added tokens in a text become those tokens, as the
    vocabulary's library reads them. Repeated rows stay; other columns are carried through, and columns of the
    two result names are replaced. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.drop(ids_col, decoded_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids_col, T.BinaryType()), T.StructField(decoded_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ids = [bpe.encode(x or "") for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())], [*batch.schema.names, ids_col, decoded_col])

    return kept.mapInArrow(run, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe_forced_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, tokenizer_path()).select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
