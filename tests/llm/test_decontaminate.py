from paceline.llm import decontaminate as D

ITEM = "Then Alice bought 12 apples for 30 dollars and gave 12 apples to her good friend at the old market today"
LIKE = "so then Bob bought {} apples for {} and gave {} apples to her good friend at the old market today yes"


def test_reparameterised_questions(spark):
    rows = [
        (1, "x y z " + ITEM), (2, LIKE.format(15, "99 euros", 15)), (3, LIKE.format(15, "99 euros", 16)), (4, LIKE.format(15, "99 km", 15)), (5, None), (6, ""), (None, ITEM), (7, "clean words " * 3000),
        (8, "word " * 5000 + ITEM), (9, ITEM.lower()), (1, "x y z " + ITEM), (10, "gave 12 apples to her"),
    ]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(0, ITEM, 1), (1, None, 1), (2, "", 1), (None, ITEM, 1), (3, "12 13 14", 1)], "item_id long, text string, doc_id int")
    for settings in (D.Settings(), D.Settings(broadcast_windows=0)):
        got = {(r.doc_id, r.item_id): r.exact for r in D.leaks(docs, bench, settings).collect()}
        assert got.keys() == {(1, 0), (2, 0), (None, 0), (8, 0), (9, 0)}
        assert got[1, 0] and not got[2, 0]
    assert sorted(r.doc_id or 0 for r in D.drop_leaked(docs, bench).collect()) == [3, 4, 5, 6, 7, 10]
    assert D.leaks(docs.limit(0), bench).count() == 0
    assert D.leaks(docs, bench.limit(0)).count() == 0


def test_short_items_are_one_window(spark):
    docs = spark.createDataFrame([(1, "we say tiny little item here"), (2, "tiny item")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, "Tiny little item")], "item_id long, text string")
    assert [r.doc_id for r in D.leaks(docs, bench).collect()] == [1]


def test_whole_items_are_found_and_nothing_else(spark):
    import re

    from tests.conftest import SMALL

    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in plain(r.text)}
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()} == want


def test_each_occurrence_is_judged_by_itself(spark):
    two = LIKE.format(15, "99 euros", 15) + " and " + LIKE.format(17, "98 euros", 17)
    stray = LIKE.format(15, "99 euros", 15) + " " + "clean words " * 30 + "gave 77 apples to her good friend at the old market"
    rows = [(1, two), (2, stray), (3, LIKE.format(15, "99 euros", 16) + " and " + LIKE.format(17, "98 km", 17))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    assert sorted((r.doc_id, r.exact) for r in D.leaks(docs, bench).collect()) == [(1, False), (2, False)]


def test_names_do_not_depend_on_what_stands_before(spark):
    bench = spark.createDataFrame([(0, "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have?"), (1, "What is the longest river here?"), (2, "12 + 13 = 25")], "item_id long, text string")
    rows = [
        (1, "Bob has 5 apples. Bob buys 3 more. How many apples does Bob have?"), (2, "see, question: What is the longest river here?"),
        (3, "we know 12 + 13 = 25 of course"), (4, "we know 12 + 14 = 26 of course"), (5, "Bob has 5 apples. Ann buys 3 more. How many apples does Eve have?"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for settings in (D.Settings(), D.Settings(broadcast_windows=0)):
        assert sorted((r.doc_id, r.item_id) for r in D.leaks(docs, bench, settings).collect()) == [(1, 0), (2, 1), (3, 2)]


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    docs = spark.createDataFrame([(1, ITEM, 1, 2), (1, "clean", 1, 2), (None, ITEM, 1, 2), (None, "clean", 1, 2)], "doc_id long, text string, leaked_id int, text_hash int")
    left = D.drop_leaked(docs, spark.createDataFrame([(0, ITEM)], "item_id long, text string"))
    assert left.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "clean"), (1, "clean")]


def test_reparameterised_items_match_brute_force(spark):
    """Numbers and names of known items are replaced, some consistently, some not; a plain Python judge decides each text."""
    import random
    import re

    rng = random.Random(6)
    names, goods = ["Alice", "Robert", "Natalia", "Olaf", "Priya"], ["apples", "clips", "marbles"]
    shape = "On monday {a} sold {x} {g} to some friends at the fair and then {a} gave away {y} {g} more so how many {g} did {a} hand over before the fair came to an end"
    items = {k: (names[k], 10 + k, 40 + k, goods[k]) for k in range(3)}
    bench = spark.createDataFrame([(k, shape.format(a=a, x=x, y=y, g=g)) for k, (a, x, y, g) in items.items()], "item_id long, text string")
    rows, want = [], set()
    for i in range(40):
        k = rng.randrange(3)
        a, g = rng.choice(names), rng.choice(goods)
        text = shape.format(a=a, x=rng.randint(2, 99), y=rng.randint(2, 99), g=g)
        broken = rng.random() < 0.4
        if broken:  # one of the name's three places holds another name
            others = [n for n in names if n != a]
            at = rng.choice([m.start() for m in re.finditer(a, text)])
            text = text[:at] + rng.choice(others) + text[at + len(a) :]
        rows.append((i, "some words before it " + text + " and some words after it"))
        # a judge without windows: the same words around the slots, and the item's own name among the readings or one alone
        for j, (b, x, y, h) in items.items():
            pattern = re.escape(shape.format(a="A", x=1, y=2, g=h)).replace("A\\ ", "([A-Z][a-z]+)\\ ").replace("\\ 1\\ ", "\\ ([0-9]+)\\ ").replace("\\ 2\\ ", "\\ ([0-9]+)\\ ")
            m = re.search(pattern, rows[-1][1])
            if m:
                who = {m.group(n) for n in (1, 3, 5)}
                if len(who) == 1 or b in who:
                    want.add((i, j))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    strict = D.Settings(coverage=1.0)
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, bench, strict).collect()}
    assert want and got == want
    assert got == {(r.doc_id, r.item_id) for r in D.leaks(docs, bench, D.Settings(coverage=1.0, broadcast_windows=0)).collect()}


def test_the_first_test_loses_nothing(spark):
    from tests.conftest import SMALL

    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    quick, slow = (sorted(map(tuple, D.leaks(docs, bench, s).collect())) for s in (D.Settings(coverage=0.2), D.Settings(coverage=0.2, broadcast_windows=0)))
    assert quick == slow and quick
