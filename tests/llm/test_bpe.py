import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tidewater.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ours():
    return bpe.SegmentTreeBpe(bpe.read_ranks(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


TEXTS = [
    "", " ", "a", "Hello world's end", "x" * 5000, "ab" * 3000, "\n\n  \t tail  ", "naïve Éa 東京 🙂🙂",
    "12345678901234567890", "!!!???###" * 40, "<|endoftext|>", "é" * 200, "a\x1cb\x85c　d", "0x" + "f0" * 100,
]


def test_matches_tiktoken(ours, theirs):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abcdeé ñ\n'sT1.") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    assert [x.tolist() for x in ours.encode_texts(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_long_and_short_trees_agree(ours):
    rng = random.Random(7)
    pieces = [bytes(rng.choice(b"abcdeht in") for _ in range(rng.randint(2, 64))) for _ in range(500)]
    assert [np.frombuffer(x, "<i4").tolist() for x in ours.encode_short(pieces)] == [ours.encode_long(p) for p in pieces]


def test_memo_bound_changes_nothing(ours, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    texts = ["some words here again", "other words there again and again"]
    assert [x.tolist() for x in ours.encode_texts(texts)] == [theirs.encode_ordinary(t) for t in texts]


def test_frame_round_trip(spark, theirs):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(99, None, 1, "x"), (0, "", 1, "x"), (None, "null id", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    out = bpe.encode(docs, PATH, P.PATTERN, with_decoded=True)
    got = bpe.digests(out).collect()
    assert len(got) == len(rows)
    want = sorted(
        (str(i), len(x := theirs.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t, *_ in rows
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    texts = bpe.encode(docs, PATH, P.PATTERN, with_decoded=True, with_text=True)
    assert sorted(map(str, bpe.digests(texts).collect())) == sorted(map(str, got))
    again = bpe.decode(out.drop("decoded"), PATH)
    assert {(r.doc_id, bytes(r.decoded)) for r in again.collect()} == {(i, (t or "").encode()) for i, t, *_ in rows}


def test_empty_frame(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, PATH, P.PATTERN).collect() == []
