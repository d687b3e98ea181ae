"""Hashes of words and word runs of many texts at once, over numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

from weirworks.llm.cuckoo import mix

# An odd base and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
CHUNK_BYTES = 1 << 20
WORD_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


@lru_cache(maxsize=2)
def _powers(count: int, base: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def powers(count: int, base: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; at least ``count`` of them."""
    return _powers(1 << max(10, (count - 1).bit_length()), base)


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many words each text has.

    A word is a run of ASCII letters and digits and of bytes above 127.
    """
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = WORD_BYTES[data]
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), BASE)[: len(data)], out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * powers(len(data), INVERSE)[start])
    ends = np.cumsum(lengths)
    counts = np.diff(np.r_[0, np.searchsorted(start, ends)])
    return hashes, counts


def chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Lower-cased texts in bytes, about a megabyte at a time (a longer text by itself): first, last, texts."""
    first, held, size = 0, [], 0
    for n, text in enumerate(texts):
        data = (text or "").lower().encode("utf-8", "replace")
        if held and size + len(data) > CHUNK_BYTES:
            yield first, n, held
            first, held, size = n, [], 0
        held.append(data)
        size += len(data)
    if held:
        yield first, first + len(held), held


def shingle_sets(texts: Sequence[str | None], words: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``words`` words.

    A text with fewer words has one run of all of them, a text without words has none.
    """
    for _, _, part in chunks(texts):
        hashes, counts = word_hashes(part)
        weights = [mix(np.array([n + 1], np.uint64))[0] | np.uint64(1) for n in range(words)]
        whole = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for n, weight in enumerate(weights):
            whole += hashes[n : n + len(whole)] * weight
        whole = mix(whole)
        at = 0
        for count in counts:
            if count >= words:
                yield np.unique(whole[at : at + count - words + 1])
            elif count:
                short = (hashes[at : at + count] * np.array(weights[:count], np.uint64)).sum(dtype=np.uint64)
                yield mix(np.array([short + np.uint64(count)], np.uint64))
            else:
                yield np.array([], np.uint64)
            at += count
