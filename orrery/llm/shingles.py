"""Hashes of word shingles, for many texts at once, in numpy."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

_ONE, _TWO = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text whose words are split at once.
SPAN = 1 << 20
#: Fixed key of the words' hashes, so that numbers of one table mean the same words in another.
KEY = b"orrery.words"
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _ONE
    x = (x ^ (x >> np.uint64(27))) * _TWO
    return x ^ (x >> np.uint64(31))


def _spans(text: bytes) -> Iterator[bytes]:
    """text, cut at white space into spans of SPAN bytes, or of one longer word."""
    at = 0
    while len(text) - at > SPAN:
        gap = _GAP.search(text, at + SPAN)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:]


def word_hash(word: bytes) -> int:
    """64 bits of BLAKE2b: unlike a polynomial's, no texts are known that collide."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8, key=KEY).digest(), "little")


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, lower-casing A-Z, and each word's text.

    Words become numbers by a dictionary of this call, and each distinct word is hashed once.
    """
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    parts, counts = [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        for span in _spans(text.lower()):
            words = span.split()
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            counts[i] += len(words)
    hashes = np.fromiter(map(word_hash, numbers), np.uint64, len(numbers))
    return hashes[np.concatenate(parts)], np.repeat(np.arange(len(texts)), counts)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of one with fewer words than width, all words as one shingle."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words, owner = word_hashes(raw)
    counts = np.bincount(owner, minlength=len(raw))
    first = np.concatenate([[0], np.cumsum(counts)])
    if len(words) >= width:
        windows = len(words) - width + 1
        total = np.zeros(windows, np.uint64)
        for i in range(width):
            total = mixed(total + words[i : i + windows])
    else:
        total = np.zeros(0, np.uint64)
    out = []
    for i, n in enumerate(counts):
        if n >= width:
            out.append(np.unique(total[first[i] : first[i] + n - width + 1]))
        elif n:
            one = np.uint64(n)
            for w in words[first[i] : first[i] + n]:
                one = mixed(np.array([one], np.uint64) + w)[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(members: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each hash function over members: 32 bits each."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(members), 2048):
        least = np.minimum(least, (members[i : i + 2048, None] * factors).min(0))
    return (least >> np.uint64(32)).astype(np.uint32)


def factors(count: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, (1 << 64) - 1, count, np.uint64) | np.uint64(1)
