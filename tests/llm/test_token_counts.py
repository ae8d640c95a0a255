import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from orrery.llm.token_counts import MARK, Counter, counted, counter, vocabulary

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer(Unigram(vocabulary(PATH), unk_id=0, byte_fallback=True))


def test_as_the_library(theirs):
    rnd, c = random.Random(1), counter(PATH)
    letters = "aabcdeeinorst   \n\té 中😀.,'1☃"
    assert c.cut is not None and c.bytes_known
    for n in (3, 12, 60, 400):
        for _ in range(400):
            text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, n)))
            assert c.count(text) == len(theirs.encode(MARK + text.replace(" ", MARK)).ids), repr(text)
    for text in ("", " ", "the " * 20000, "x" * 5000, " " * 999, "<s></s><unk>", MARK * 3):
        assert c.count(text) == len(theirs.encode(MARK + text.replace(" ", MARK)).ids)


def test_ties_and_unknown_runs():
    for fallback in (False, True):
        pieces = [("<unk>", 0.0), *[(f"<0x{b:02X}>", -9.0) for b in range(256) if fallback], ("a", -1.0), ("aa", -2.0), ("ab", -3.0), ("aab", -4.0), ("b", -2.0), ("aaab", -5.0), ("bx", -2.5)]
        library, c, rnd = Tokenizer(Unigram(pieces, unk_id=0, byte_fallback=fallback)), Counter(pieces), random.Random(2)
        for _ in range(2000):
            text = "".join(rnd.choice("aaabbxé") for _ in range(rnd.randint(1, 14)))
            assert c.viterbi(text) == len(library.encode(text).ids), text


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (None, None, 2), (1, "a b", 1), (3, "", 1)], "doc_id bigint, text string, n_tokens int")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counted(docs, PATH).collect()) == [(0, 1), (1, 2), (1, 2), (3, 1)]
    assert counted(docs.limit(0), PATH).count() == 0
