import numpy as np
import xxhash

from paceline.llm import simhash


def slow(text, width=4):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels(fps, radius):
    lab = list(range(len(fps)))
    while True:
        new = [min(lab[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= radius) for i in range(len(fps))]
        if new == lab:
            return lab
        lab = new


def test_fingerprint_by_definition():
    for text in ("", "  \t ", "one", "A b C", "a b c d", "The cat sat on the mat and the cat sat on the hat", "é\x0bü x\x85y z w v", "w " * 3000):
        assert simhash.fingerprint(text.encode()) == slow(text)


def test_forest_keeps_components():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << k) for k in range(0, 40, 3)]]))
    a, b = simhash.forest(fps, None, 2)
    assert len(a) < len(fps)
    assert all(int(x) in fps.tolist() and int(y) in fps.tolist() for x, y in zip(a, b, strict=True))
    parent = {int(x): int(x) for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        parent[root(x)] = root(y)
    want = labels([int(x) for x in fps], 2)
    got = [root(int(x)) for x in fps]
    assert all((want[i] == want[j]) == (got[i] == got[j]) for i in range(len(fps)) for j in range(i))


def test_groups_match_brute_force(spark):
    body = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    texts = [None, "", body, body, body + " phi", body.upper(), "other words entirely here now", " ", body * 40, body * 40 + " end"]
    rows = [(i + 10, t, "x") for i, t in enumerate(texts)] + [(12, body, "x"), (None, body, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    for tile in (8192, 2):
        got = sorted(((r.doc_id or -1), r.fp & (2**64 - 1), r.component_id) for r in simhash.groups(docs, tile=tile).collect())
        fps = [slow(t or "") for _, t, _ in rows]
        lab = labels(fps, 4)
        want = sorted(((i or -1), fps[k], min(rows[j][0] for j in range(len(rows)) if lab[j] == lab[k] and rows[j][0] is not None)) for k, (i, _, _) in enumerate(rows))
        assert got == want
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for *_, c in want})
    assert sum(r.doc_id is None for r in kept) == 1


def test_empty_table(spark):
    assert simhash.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = ["", None, "one two", "one two"]
    for n in (12, 60, 300, 1000):
        for share in (0.01, 0.02, 0.03, 0.04):
            base = [f"w{x}" for x in rng.integers(0, 5000, n)]
            texts.append(" ".join(base))
            for _ in range(4):
                texts.append(" ".join(f"r{rng.integers(5000)}" if rng.random() < share else w for w in base))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    lab = list(range(len(texts)))
    while True:
        new = [min(lab[j] for j in range(len(texts)) if near(sets[i], sets[j])) for i in range(len(texts))]
        if new == lab:
            break
        lab = new
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    narrow = {r.doc_id: r.component_id for r in simhash.groups(docs).collect()}
    assert sum(narrow[i] != lab[i] for i in range(len(texts))) > 5  # op8's setting misses many
    for tile in (32768, 30):
        got = {r.doc_id: r.component_id for r in simhash.similar(docs, tile=tile).collect()}
        assert got == dict(enumerate(lab))
    assert sorted(r.doc_id for r in simhash.keep_one_similar(docs).collect()) == sorted(set(lab))


def test_of_rows_with_one_id_no_text_is_lost(spark):
    one, two = "the first text of some words that goes on for a while", "quite another text which shares no shingle with the first one at all"
    rows = [(3, one, 1), (5, two, 2), (5, one, 3), (-7, None, 4), (8, "", 5), (9, two, 6)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, key int").repartition(3)
        for keep in (simhash.keep_one, simhash.keep_one_similar):
            assert sorted((r.doc_id, r.text) for r in keep(docs).select("doc_id", "text").collect()) == [(-7, None), (3, one), (5, two)]
            assert keep(docs).columns == docs.columns


def test_bands_cover_all_counts_and_reach_all_partners():
    band_of, found = simhash.bands({0: 5, 3: 10, 4: 1, 60: 30}, 12)
    assert [(lo, hi) for lo, hi, _ in found] == [(0, 0), (3, 4), (60, 60)] and band_of == {0: 0, 3: 1, 4: 1, 60: 2}
    assert [n for *_, n in found] == [1, 1, 3]


def test_the_query_gives_the_contract_s_columns(spark, tmp_path):
    body = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    spark.createDataFrame([(4, body), (2, body), (7, None), (9, "else")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in simhash.op8_simhash_tiled(spark, str(tmp_path)).collect())
    assert got == [(2, f"{slow(body):016x}", 2), (4, f"{slow(body):016x}", 2), (7, "0" * 16, 7), (9, f"{slow('else'):016x}", 9)]


def test_very_long_texts_are_read_whole(spark):
    rng = np.random.default_rng(9)
    words = [f"w{x}" for x in rng.integers(0, 50_000, 200_000)]
    text, near = " ".join(words), " ".join([*words[:199_990], *["changed"] * 10])
    docs = spark.createDataFrame([(1, text), (2, near), (3, "short"), (4, text)], "doc_id long, text string")
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.groups(docs).collect()}
    assert got[1][0] == slow(text) and got[2][0] == slow(near) and got[4] == got[1]
    assert {r.doc_id: r.component_id for r in simhash.similar(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_families_at_the_border_lose_no_link(spark):
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(12):
        n, rate = int(rng.integers(60, 500)), rng.uniform(0.012, 0.022)
        base = [f"w{x}" for x in rng.integers(0, 5000, n)]
        texts += [" ".join(f"r{rng.integers(5000)}" if rng.random() < rate else w for w in base) for _ in range(9)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = {k: top(k) for k in range(len(texts))}
    assert 12 < len(set(want.values())) < len(texts)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar(docs).collect()} == want


def test_partners_come_in_turn_and_none_is_passed_over():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    a = np.stack([base ^ np.array([1 << int(k), 0, 0, 0], np.uint64) for k in rng.integers(0, 60, 14)])
    keys, group = np.arange(14, dtype=np.int64) * 7919, np.array([0, 1] * 7)
    after, offered = np.full(14, -1, np.int64), set()
    for most in (1, 2, 4, 8):
        me, other, turn = simhash.wide_next(a, None, group, keys, after, most)
        offered |= {(int(x), int(y)) for x, y in zip(me, other, strict=True)}
        np.maximum.at(after, me, turn)
    assert offered == {(x, y) for x in range(14) for y in range(14) if group[x] != group[y]}
    assert not len(simhash.wide_next(a, None, group, keys, after, 8)[0])


def test_counts_by_parts_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(12)
    sets = []
    for n in (1, 5, 40, 300, 3000):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for share in (0, 0.05, 0.1, 0.11, 0.12, 0.2, 0.5):
            new = base.copy()
            new[: int(n * share)] = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
            sets.append(np.unique(new))
    counts = np.frombuffer(b"".join(map(simhash.part_counts, sets)), "<u2").reshape(len(sets), -1)
    sizes = np.array(list(map(len, sets)))
    i, j = np.triu_indices(len(sets), 1)
    can = simhash.may_reach(counts, sizes, i, j, 0.8)
    similar = np.array([len(np.intersect1d(sets[x], sets[y])) >= 0.8 * len(np.union1d(sets[x], sets[y])) for x, y in zip(i, j, strict=True)])
    assert can[similar].all() and similar.sum() > 20 and (~can).sum() > 0.8 * (~similar).sum()


def test_similar_sets_share_a_rare_shingle():
    rng = np.random.default_rng(3)
    often = rng.integers(0, 4, simhash.SLOTS).astype(np.int32)
    met = 0
    for n in (4, 5, 9, 10, 40, 300):
        for new in range(n // 4 + 1):
            for extra in range(n // 4 + 1):
                base = rng.integers(0, 2**63, n + extra + new, dtype=np.uint64)
                a, b = np.unique(base[: n + extra]), np.unique(np.concatenate([base[: n - new], base[n + extra :]]))
                both = len(np.intersect1d(a, b))
                if len(a) != len(b) and both >= 0.8 * (len(a) + len(b) - both) or len(a) == len(b) and both >= 0.8 * (2 * len(a) - both) and both < len(a):
                    met += 1
                    assert len(np.intersect1d(simhash.rare_shingles(a, often, 0.8), simhash.rare_shingles(b, often, 0.8)))
    assert met > 100


def test_rows_dealt_grow_with_the_rows(spark):
    for n in (20_000, 80_000):
        rows = spark.range(n).selectExpr("id as key", "id div 4 as block")
        dealt = simhash.block_pairs(rows, simhash.WIDE_TILE)
        assert dealt.count() == n and dealt.groupBy("pair").count().agg({"count": "max"}).first()[0] < 4 * simhash.UNIT
    one = simhash.block_pairs(spark.range(1000).selectExpr("id as key", "7L as block"), 300)  # a large block meets itself by tiles
    met = {(a, b) for r in one.groupBy("pair").agg({"key": "collect_list"}).collect() for a in r[1] for b in r[1]}
    assert len(met) == 1000 * 1000


def test_contracted_links_have_the_same_components(spark):
    from paceline.llm.common import components, contracted

    edges = [(k, k + 1) for k in range(0, 90)] + [(200 - k, 199 - k) for k in range(0, 50)] + [(7, 7), (300, None), (95, 200)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    want = {(r.node, r.root) for r in components(df).collect()}
    assert want == {(k, 0) for k in range(1, 91)} | {(k, 95) for k in range(150, 201)}
    for at_once in (1, 20, 1 << 18):
        assert {(r.node, r.root) for r in components(contracted(df, at_once)).collect()} == want
    stars = contracted(spark.createDataFrame(edges[:90], "a long, b long").coalesce(1)).collect()
    assert {(r.a, r.b) for r in stars} == {(k, 0) for k in range(1, 91)}


def test_links_to_the_root_settle_in_one_round(spark, monkeypatch):
    from paceline.llm import common

    made, stored = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name="table": made.append(name) or stored(df, name))
    star = spark.createDataFrame([(k, 0) for k in range(1, 20)], "a long, b long")
    assert common.components(star).count() == 19
    assert made == ["edges"] * 2
