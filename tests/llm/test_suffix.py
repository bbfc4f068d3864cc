import hashlib
import random
from collections import Counter

import numpy as np

from paceline.llm import suffix


def brute(rows, length):
    """Kept bytes and runs per row, by sets of strings."""
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        if i is not None:
            for k in range(len(data) - length + 1):
                w = data[k : k + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        if i is not None:
            for k in range(len(data) - length + 1):
                if first[data[k : k + length]] < i:
                    gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        runs = [k for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1])]
        out.append((i, kept, len(runs)))
    return out


def same(spark, rows, settings=suffix.Settings()):
    docs = spark.createDataFrame([(i, t, "z", 1, 2, 3) for i, t in rows], "doc_id long, text string, kept string, key int, want int, SPANS int")
    got = [(r.doc_id, bytes(r.kept), len(r.removed)) for r in suffix.remove_repeats(docs, settings).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute(rows, settings.length), key=key)


def test_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(3)]
    rows = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 60)
            parts += [s[a : a + rng.randint(40, 120)], word()]
        rows.append((i, " ".join(parts)))
    rows += [(50, rows[3][1]), (50, rows[3][1]), (51, None), (52, ""), (None, rows[3][1]), (53, "ab" * 400), (54, "x" + "ab" * 300), (55, "a" * 49), (56, "a" * 50), (57, "a" * 50), (56, "other text under one id " * 5)]
    same(spark, rows)
    same(spark, rows, suffix.Settings(crowd=1))
    same(spark, rows, suffix.Settings(crowd=1, part_bytes=300))


def test_the_query_gives_the_contract_s_columns(spark, tmp_path):
    text = "the same long passage of text that stands in two documents and then goes on"
    rows = [(1, text), (2, "before it. " + text + " and after"), (3, None), (4, "short"), (5, text)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suffix.op4_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, kept, runs in brute(rows, 50):
        whole = (dict(rows)[i] or "").encode()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(whole), len(whole) - len(kept), runs, hashlib.sha256(kept).hexdigest())


def test_the_number_of_parts_follows_the_bytes(spark):
    s = suffix.Settings()
    assert [s.parts(n) for n in (0, 1, s.part_bytes, s.part_bytes + 1)] == [1, 1, 1, 2]
    assert s.parts(10**14) <= 10**14 // (16 * s.part_bytes) + 1


def test_empty(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deep_shallow_orders_suffixes():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1000:1400] = text[100:500]
    starts = np.arange(0, 2900)
    order, new = suffix.deep_shallow(text, starts, 50, 16)
    body = text.tobytes()
    strings = [body[s : s + 50] for s in starts[order].tolist()]
    assert strings == sorted(strings)
    assert new.tolist() == [True, *(a != b for a, b in zip(strings, strings[1:], strict=False))]


def test_blind_trie_sorts_and_finds_equals():
    strings = [b"banana", b"bandan", b"apples", b"banana", b"zzzzzz", b"bananb", b"aaaaaa"]
    trie = suffix.BlindTrie()
    leaves = [trie.insert(s) for s in strings]
    assert leaves[3] == leaves[0]
    assert [trie.strings[k] for k in trie.ordered()] == sorted(set(strings))


def test_multikey_quicksort_beyond_the_small_case():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 40, (9000, 2)).astype(np.uint64)
    order = np.arange(9000)
    groups = suffix.multikey(words, order, 0, 2)
    rows = [tuple(r) for r in words[order].tolist()]
    assert rows == sorted(rows)
    assert len(order) > suffix.SMALL
    assert sorted(b - a for a, b in groups) == sorted(n for n in Counter(rows).values() if n > 1)
