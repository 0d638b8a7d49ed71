import base64
import random

import pytest
import tiktoken

from quillon.llm import bpe

PATH = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def both():
    data = open(PATH, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return bpe.Encoder(bpe.load_ranks(data)), tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", ["Hello, world!  Two  spaces\n\n\tx", "naïve Ünïcödé 漢字かな العربية", "<|endoftext|> is text", "a" * 5000, "ab" * 3001 + "😀" * 50, " ", "​\x00"])
def test_equals_the_reference_encoder(both, text):
    ours, theirs = both
    assert ours.encode(text) == theirs.encode_ordinary(text)


def test_random_texts(both):
    ours, theirs = both
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("abcdeeee  tthh'sß漢0123.,!\n") for _ in range(rng.randrange(200)))
        assert ours.encode(t) == theirs.encode_ordinary(t)


def test_rank_queue_orders_by_rank_then_position():
    q = bpe.RankQueue(50_257)
    rng = random.Random(2)
    items = {(rng.randrange(50_257), rng.randrange(99)) for _ in range(500)}
    for r, p in items:
        q.push(r, p)
    out = []
    while (x := q.pop()) is not None:
        out.append(x)
    assert out == sorted(items)


def test_long_pretoken_is_fast(both):
    import time

    t = time.time()
    both[0].encode("q7x" * 200_000)
    assert time.time() - t < 30


def test_documents(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hi there"), (3, "hi there")], "doc_id long, text string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_documents(df).collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got[2][1]) == 2
    assert bpe.encode_documents(df.limit(0)).count() == 0
    n = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df).collect()}
    assert n == {1: 0, 2: 0, 3: 2}
