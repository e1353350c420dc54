import hashlib
import os
import random

import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from korpusflow.llm import bpe  # noqa: E402

VOCAB = P.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "\n", " \n", "a", " a", "a ", "a  b", "a \n b", "a\n\n b", "don't we'll", "x y   z　w", "\x1c\x1d a\x1f b\x85c", "naïve café ñ ß",
    "<|endoftext|>", "a<|endoftext|>b <|endoftext|> c", "日本語 テキスト", "🙂🙂 ok", "a​b", "١٢٣ ½ Ⅷ", "y" * 3000, "ab" * 700 + " " + "zq!?" * 300, "é e", "᠎ x", "tab\tsep\t \tend ", "²³ x²", "﻿q",
]


def test_matches_library():
    ours, theirs = bpe.load(VOCAB), Tokenizer.from_file(VOCAB)
    rng = random.Random(5)
    letters = "ab cde\n\t' .,!é ß日🙂0 9<|>_ 'sre"
    texts = ODD + ["".join(rng.choices(letters, k=rng.randrange(1, 80))) for _ in range(3000)]
    for text in texts:
        got = list(memoryview(ours.encode(text)).cast("i"))
        assert got == theirs.encode(text, add_special_tokens=False).ids, repr(text)


def test_short_and_long_merge_agree():
    ours = bpe.load(VOCAB)
    rng = random.Random(6)
    for _ in range(200):
        raw = bytes(rng.choice(b"theandingxq") for _ in range(rng.randrange(0, 60)))
        assert ours.merge_short(raw) == ours.merge_long([ours.byte_ids[b] for b in raw])


def test_columns_and_digests(spark):
    rows = [(1, "The thing is. <|endoftext|>", 7), (1, "The thing is. <|endoftext|>", 7), (2, None, None), (None, "", 1), (3, "x " * 5000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded long")
    encoded = bpe.encode(df, VOCAB)
    assert encoded.columns == ["doc_id", "text", "decoded", "ids"]
    back = {(r.doc_id, r.decoded) for r in bpe.decode(encoded, VOCAB).select("doc_id", "decoded").collect()}
    assert back == {(1, rows[0][1]), (2, ""), (None, ""), (3, rows[4][1])}
    theirs = Tokenizer.from_file(VOCAB)
    for r, (doc_id, text, _) in zip(bpe.token_digests(df.coalesce(1), VOCAB).collect(), rows):
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.token_digests(df.limit(0), VOCAB).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_whole_table_against_library(spark):
    from korpusflow.llm.registry import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    theirs = Tokenizer.from_file(VOCAB)
    got = QUERIES["op2_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = theirs.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
