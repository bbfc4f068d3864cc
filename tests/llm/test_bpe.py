import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from paceline.llm import bpe

HARD = ["", " ", "<|endoftext|>a <|endoftext|>", "a" * 3000, "é½²Ⅷ x'll DON'T", "東京 😀👨‍👩‍👧", "1234567890" * 40, "\x00\x85 x", "x\n\n  y  ", "ßäöü" * 200]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


def test_ids_equal_the_library(library):
    own = bpe.tokenizer(bpe.tokenizer_path())
    rng = random.Random(5)
    texts = HARD + ["".join(rng.choice("ab cé.,'1\n!<|") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want
        assert own.decode(own.encode(text)) == library.decode(want, skip_special_tokens=False)


def test_cuts_stand_in_no_token():
    own = bpe.tokenizer(bpe.tokenizer_path())
    assert any(len(own.fragments(w)) > 1 for w in (b"q\xc3\xa9\xff\x00z", b"\xf5\xf6\xf7"))
    for word in (b"hello", "früh".encode(), b"\xff\xfe\x00abc"):
        assert b"".join(own.fragments(word)) == word


def test_frame(spark):
    rows = [(1, None, 5), (1, None, 5), (None, "hi there", 6), (3, "x" * 5000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids int")
    out = bpe.encode(docs, bpe.tokenizer_path()).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in out) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert bpe.encode(docs.limit(0), bpe.tokenizer_path()).count() == 0
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(bytes(next(r for r in out if r.doc_id == 1).token_ids)).hexdigest()


def test_very_long_texts_equal_the_library(library, spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab cé.,'1\n!<|") for _ in range(150_000)), "x" * 120_000, "日本 " * 60_000]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    for r in bpe.encode(docs, bpe.tokenizer_path()).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == want and r.decoded == texts[r.doc_id]
