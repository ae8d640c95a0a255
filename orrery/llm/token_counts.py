"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton lists every piece of the vocabulary that ends at each character; dynamic
programming keeps, for each end, the best score and the number of tokens on the best path, and no
path. Ties fall as in the tokenizers library's unigram model: of paths with equal scores into an end,
the one whose last piece begins first stays, and a character that no piece covers alone counts as
unknown at the lowest score less 10. Unknown characters fall back to bytes, one token for each byte.

A text is prefixed with a space and its spaces become the word mark. Pieces hold marks only in front,
so no piece crosses from another character to a mark: the text is cut there, and a worker remembers
the counts of the parts that it met.

The vocabulary's scores are whole numbers and sums of them are exact, so cutting cannot change a tie.

Defined results: a null or empty text has the tokens of the bare word mark in front; repeated rows
stay; columns besides doc_id and text are not read; an empty table gives no rows; texts of any length
are counted whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orrery.llm.common import Memo, pieces, small_batches, table, tidy

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes that a worker may remember of parts and their counts.
MEMORY = 32 << 20


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(Memo):
    """Part of a text -> its number of tokens."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__(MEMORY)
        self.automaton = ahocorasick.Automaton()
        known: dict[str, float] = {}
        for piece, score in pieces:  # of a piece that is there twice, the later one counts
            if piece:
                known[piece] = score
        for piece, score in known.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes_known = all(f"<0x{b:02X}>" in known for b in range(256))
        #: Texts may be cut in front of a mark only if no piece has a mark behind another character.
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if not any(MARK in p.lstrip(MARK) for p in known) else None

    def __missing__(self, part: str) -> int:
        n = self.viterbi(part)
        self.keep(part, n)
        return n

    def viterbi(self, part: str) -> int:
        """Tokens on the best path over part."""
        size, lowest = len(part), float("-inf")
        ending: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, (length, score) in self.automaton.iter(part):
            ending[end].append((length, score))
        best, count = [0.0] + [lowest] * size, [0] * (size + 1)
        # whether the last token on the best path is a run of unknown characters, which is one token without bytes
        in_run = [False] * (size + 1)
        for end in range(1, size + 1):
            top, tokens, run, alone = lowest, 0, False, False
            # longest first: of equal scores the piece that begins first stays
            for length, score in ending[end - 1]:
                alone = alone or length == 1
                if (value := best[end - length] + score) > top:
                    top, tokens, run = value, count[end - length] + 1, False
            if not alone and (value := best[end - 1] + self.unknown) > top:
                top, run = value, True
                if self.bytes_known:
                    tokens = count[end - 1] + len(part[end - 1].encode("utf-8", "surrogatepass"))
                else:
                    tokens = count[end - 1] + (not in_run[end - 1])
            best[end], count[end], in_run[end] = top, tokens, run
        return count[size]

    def count(self, text: str | None) -> int:
        marked = MARK + (text or "").replace(" ", MARK)
        if self.cut is None or not self.bytes_known:
            return self.viterbi(marked)
        return sum(map(self.__getitem__, self.cut.findall(marked)))


@cache
def counter(path: str) -> Counter:
    """One for each worker and vocabulary."""
    return Counter(vocabulary(path))


def counted(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and n_tokens of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        yield from tidy(lambda rows: counts(known, rows), known)(batches)

    def counts(known: Counter, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            n = [known.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 32k pieces, read as a unigram vocabulary."""
    import public_tokenizers

    return counted(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
