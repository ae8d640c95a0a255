"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text, BPE ends in one token that is fixed by the prefix alone. So the
encoder keeps one number for each prefix, its last token: a new byte is appended by finding the one
token that ends there and may stand behind the last token of the prefix before it, and the encoding
of any prefix is read off by walking back. Whether two tokens may stand side by side is decided from
their merge trees: neither tree may hold, on the common border, a pair that would have merged before
the merges that made the two tokens.

``Prefix`` is one piece that grows, shrinks and changes in place; ``Codec`` encodes whole texts as
the tiktoken library would (each match of the pattern by itself, a match that is a token at once) and
decodes; ``encoded`` runs it over a DataFrame.

Defined results: a null text is encoded as the empty text: no ids; repeated rows stay; other columns
of the table are not read; an empty table gives no rows; a text is never cut, however long.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import cache, cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from orrery.llm.common import Memo, pieces, small_batches, table, tidy

#: Bytes that a worker may remember of encoded chunks, of matches inside them and of pairs of tokens.
CHUNKS, MATCHES, PAIRS = 64 << 20, 16 << 20, 32 << 20
#: A space between two other white space characters, or one of two that end a text: there, tokens cross spaces.
CROSSING = re.compile(r" (?<=\s )(?:\s|\Z)")
OUT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Vocabulary:
    """Token bytes by rank, and which tokens may be neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._halves: dict[int, tuple[int, int] | None] = {}
        #: Pairs of tokens, left << 32 | right.
        self.pairs = Memo(PAIRS)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a})

    def merged(self, piece: bytes, below: int | None = None) -> list[int]:
        """Ranks of the parts of piece after all merges of rank under below, lowest rank first, then leftmost."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get, top = self.ranks.get, len(self.tokens) + len(self.ranks) + 1 if below is None else below
        while len(parts) > 1:
            best, at = min((get(parts[i] + parts[i + 1], top), i) for i in range(len(parts) - 1))
            if best >= top:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token; None for a single byte, or for a token that merges don't make."""
        if token not in self._halves:
            parts = self.merged(self.tokens[token], token)
            self._halves[token] = tuple(parts) if len(parts) == 2 else None
        return self._halves[token]

    def made(self, token: int) -> bool:
        """Whether the merges make token out of its bytes."""
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def beside(self, left: int, right: int) -> bool:
        """Whether BPE leaves left and right side by side."""
        known = self.pairs.get(left << 32 | right)
        if known is None:
            known = self._stay_apart(left, right)
            self.pairs.keep(left << 32 | right, known)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        # Undo merges at the border, the later one first. A pair met on the way would have merged at
        # its own rank, unless the merge undone last came first: at equal ranks the leftmost goes first,
        # which hides a pair behind a merge on its left, but not behind one on its right.
        tokens, get, halves = self.tokens, self.ranks.get, self.halves
        limit = len(self.ranks) + len(tokens) + 1
        while get(tokens[left] + tokens[right], limit) >= limit:
            a, b = halves(left), halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]
        return False

    @cached_property
    def matcher(self) -> ahocorasick.Automaton:
        """Finds every token that the merges can make; bytes stand as the characters of the same numbers."""
        out = ahocorasick.Automaton()
        for token, text in self.tokens.items():
            if self.made(token):
                out.add_word(text.decode("latin-1"), (token, len(text)))
        out.make_automaton()
        return out

    def last_tokens(self, piece: bytes, last: list[int]) -> None:
        """Extends last, the last token of each prefix of piece, over all of piece."""
        done, known, beside = len(last), self.pairs, self.beside
        for at, (token, size) in self.matcher.iter(piece.decode("latin-1"), max(0, done - self.longest)):
            if at >= done:
                start = at + 1 - size
                if not start or known.get(pair := last[start - 1] << 32 | token) or (pair not in known and beside(last[start - 1], token)):
                    last.append(token)
                    done += 1
                    if done <= at:
                        break
        if done < len(piece):
            raise ValueError("the vocabulary lacks a byte")


class Prefix:
    """A piece of bytes and, for each of its prefixes, the last token of the prefix's encoding."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Exact: what stands is not looked at again but for the tokens that reach over the border."""
        self.piece += more
        self.vocabulary.last_tokens(self.piece, self.last)

    def truncate(self, size: int) -> None:
        self.piece = self.piece[:size]
        del self.last[size:]

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts new in place of piece[start:end]; returns how many prefixes were worked out anew.

        Prefixes before the edit stand. Behind it, once as many tokens in a row as the longest token
        has bytes come out as before, all the rest would, and is kept.
        """
        tail, old = self.piece[end:], self.last[end:]
        self.truncate(start)
        self.append(new)
        worked, same = len(new), 0
        for i in range(len(tail)):
            self.append(tail[i : i + 1])
            worked += 1
            same = same + 1 if self.last[-1] == old[i] else 0
            if same >= self.vocabulary.longest:
                self.piece += tail[i + 1 :]
                self.last += old[i + 1 :]
                break
        return worked

    def tokens(self, size: int | None = None) -> list[int]:
        """The encoding of the first size bytes."""
        at, out = len(self.piece) if size is None else size, []
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class _Chunks(Memo):
    """Ids, as little-endian unsigned 32-bit integers, of chunks."""

    def __init__(self, codec: Codec):
        super().__init__(CHUNKS)
        self.codec = codec

    def __missing__(self, chunk: str) -> bytes:
        matches = self.codec.pattern.findall(chunk)
        out = self.codec.ids(chunk) if matches == [chunk] else b"".join(map(self.codec.match, matches))
        self.keep(chunk, out)
        return out


class Codec:
    """Encodes and decodes texts."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.chunks, self.matches = _Chunks(self), Memo(MATCHES)
        #: Whether a space always starts a match, so that texts can be cut at spaces.
        self.by_space = self.pattern.findall("a bc 1 .") == ["a", " bc", " 1", " ."]

    def ids(self, text: str) -> bytes:
        """Ids of one match of the pattern."""
        piece = text.encode("utf-8", "surrogatepass")
        whole = self.vocabulary.ranks.get(piece)
        ids = [whole] if whole is not None else Prefix(self.vocabulary, piece).tokens()
        return struct.pack(f"<{len(ids)}I", *ids)

    def match(self, text: str) -> bytes:
        """Ids of one match of the pattern, remembered."""
        found = self.matches.get(text)
        if found is None:
            found = self.ids(text)
            self.matches.keep(text, found)
        return found

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_space or CROSSING.search(text):
            return b"".join(map(self.match, self.pattern.findall(text)))
        first, *rest = text.split(" ")
        get = self.chunks.__getitem__
        return get(first) + b"".join([get(" " + x) for x in rest])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "surrogatepass")


@cache
def codec(path: str, pattern: str) -> Codec:
    """One for each worker, vocabulary and pattern."""
    return Codec(Vocabulary.load(path), pattern)


def encoded(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes they decode to; with_ids: the ids too, as bytes."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        yield from tidy(lambda rows: coded(c, rows), c.chunks, c.matches, c.vocabulary.pairs)(batches)

    def coded(c: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            n, ids_sha, text_sha, ids = [], [], [], []
            for text in batch.column(1):
                out = c.encode_bytes(text.as_py() or "")
                n.append(len(out) // 4)
                ids_sha.append(hashlib.sha256(out).hexdigest())
                text_sha.append(hashlib.sha256(c.decode_bytes(np.frombuffer(out, "<u4").tolist())).hexdigest())
                if with_ids:
                    ids.append(out)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, OUT + (", ids binary" if with_ids else ""))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded."""
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
