import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from orrery.llm.bpe import Codec, Prefix, Vocabulary, encoded

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return Codec(Vocabulary.load(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def theirs(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.vocabulary.ranks, special_tokens={})


def test_random_texts_as_the_library(codec, theirs):
    rnd = random.Random(3)
    letters = "aabe  \n\t\r\x1c\x85\u3000\xa0éß²½Ⅷ中😀's'll'RE12.,!?_-\x00"
    for n in (5, 20, 200):
        for _ in range(1500):
            text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, n)))
            assert codec.encode(text) == theirs.encode_ordinary(text), repr(text)


def test_edges_and_long_texts(codec, theirs):
    for text in ("", " ", "   ", "a \n", "x" * 3000, " " * 3000, "ab " * 20000, "<|endoftext|>", "a\n \nb", "'S 's"):
        assert codec.encode(text) == theirs.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text


def test_every_prefix_append_and_edit(codec):
    v, rnd = codec.vocabulary, random.Random(5)
    for _ in range(60):
        piece = "".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(1, 300))).encode()
        grown = Prefix(v)
        for i in range(0, len(piece), 7):
            grown.append(piece[i : i + 7])
        for size in range(len(piece) + 1):
            if size % 9 == 0:
                assert grown.tokens(size) == v.merged(piece[:size])
        a, b = sorted(rnd.sample(range(len(piece) + 1), 2))
        new = "".join(rnd.choice("abst") for _ in range(rnd.randint(0, 9))).encode()
        grown.replace(a, b, new)
        assert grown.piece == piece[:a] + new + piece[b:]
        assert grown.last == Prefix(v, grown.piece).last


def test_edit_near_the_front_of_a_long_piece_stays_local(codec):
    piece = Prefix(codec.vocabulary, b"thereintheword" * 400)
    assert piece.replace(10, 12, b"xyz") < 1500
    assert piece.last == Prefix(codec.vocabulary, piece.piece).last


def test_rows(spark, codec):
    docs = spark.createDataFrame([(1, "a b", "x"), (None, None, "y"), (1, "a b", "x"), (4, "", None)], "doc_id bigint, text string, n_tokens string")
    rows = encoded(docs, PATH, P.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 0), (1, 2), (1, 2), (4, 0)]
    assert all(r.ids_sha256 == empty == r.decoded_sha256 for r in rows if not r.n_tokens)
    assert next(r for r in rows if r.n_tokens).decoded_sha256 == hashlib.sha256(b"a b").hexdigest()
    assert encoded(docs.limit(0), PATH, P.PATTERN).count() == 0
