import base64
import os
import random

import pytest

from codelattice.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.BYTE_BPE_50K), reason="no vocabulary here")
PARTS = ["a", "aaaa", "ab", " ", "  ", "\n", "\t", "'s", "'ll", "'", "1234", "é", "日本", "😀", "!!", "==", "the", "ing", "_", "-----", "\u00a0", "\r\n", "х", "<|endoftext|>", "\u0000", "﻿"]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_against_the_library_whole_and_in_parts(reference):
    rnd, enc, dec = random.Random(5), encode.Encoder(), encode.Decoder()
    for _ in range(400):
        s = "".join(rnd.choice(PARTS) * rnd.choice([1, 1, 2, 30]) for _ in range(rnd.randint(0, 40)))
        want = reference.encode_ordinary(s)
        assert enc.encode(s) == want and dec.decode(want) == s
        out, i = [], 0
        while i < len(s):
            j = i + rnd.choice([1, 2, 5, 300])
            out += enc.feed(s[i:j])
            i = j
        assert out + enc.finish() == want


def test_long_runs_need_bounded_state(reference):
    rnd, enc = random.Random(6), encode.Encoder()
    for s in ("a" * 150_000, " " * 100_000 + "x", "=-" * 60_000, base64.b64encode(rnd.randbytes(60_000)).decode(), "0123456789" * 9_000):
        out, most = [], 0
        for i in range(0, len(s), 1000):
            out += enc.feed(s[i : i + 1000])
            most = max(most, len(enc.merger.data) + len(enc.tail))
        assert out + enc.finish() == reference.encode_ordinary(s)
        assert most < 2 * encode.RUN + 8 * enc.vocab.lookahead


def test_the_lookahead_is_the_longest_tokens(reference):
    v = encode.vocabulary(encode.BYTE_BPE_50K)
    assert v.lookahead == max(map(len, v.bytes.values())) == 128


def test_decoder_joins_characters_across_tokens():
    enc, dec = encode.Encoder(), encode.Decoder()
    out = "".join(dec.feed([i]) for i in enc.encode("日本語 😀 é")) + dec.finish()
    assert out == "日本語 😀 é"


def test_frame(spark):
    df = spark.createDataFrame([(1, "the cat", 9), (2, "", 9), (3, None, 9), (None, "the cat", 9), (1, "the cat", 9)], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id or 0), list(r.ids)) for r in encode.encode_texts(df, "doc_id", "text").collect())
    assert got == [(0, [1169, 3797]), (1, [1169, 3797]), (1, [1169, 3797]), (2, []), (3, [])]
    assert encode.encode_texts(df.limit(0), "doc_id", "text").count() == 0
    assert sorted(r.n_tokens for r in encode.token_lengths(df, ["doc_id"], "text").collect()) == [0, 0, 2, 2, 2]
