"""Cutting texts into overlapping pieces such that equal 50-byte strings fall in pieces with the same anchor.

Of the 16-byte strings inside a 50-byte string, the one with the smallest upper half of a hash (the first of equals) is its anchor. All
50-byte strings around one anchor form a piece. Equal strings have equal anchors, so a repeat is found by looking only
at pieces of one anchor, and no repeat is missed.
"""

from __future__ import annotations

import numpy as np

from weirworks.llm.cuckoo import mix
from weirworks.llm.hashing import BASE, INVERSE, powers

WINDOW, KEY = 50, 16
SPAN = WINDOW - KEY + 1
HALF = SPAN // 2  # a 50-byte string has so many bytes or more beside its anchor, on one side at least
PLACE = np.uint64(0xFFFFFFFF)


def pieces(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The pieces of all texts, in order: doc (number of the text), lo and hi (first and last place of a 50-byte string
    with this anchor), at (place of the anchor), anchor and whole (hashes of the anchor and of all bytes from lo to the end of the last string),
    left and right (hashes of the anchor with the 17 bytes before and after it; 0 where the piece has fewer)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = b"".join(texts) + b"\0" * 16
    n = len(joined) - 16
    none = np.array([], np.int64)
    if n < WINDOW:
        return {"doc": none, "lo": none, "hi": none, "at": none} | {k: none.astype(np.uint64) for k in ("anchor", "whole", "left", "right")}
    eight = np.empty(n, np.uint64)
    for s in range(8):
        eight[s::8] = np.frombuffer(joined, "<u8", count=len(eight[s::8]), offset=s)
    keys = mix(eight[: n - 15] * np.uint64(BASE) + mix(eight[8 : n - 7]))
    # The upper half of a hash with its place below it: the smallest number is the first of the smallest hashes.
    best, have = (keys & ~PLACE) | np.arange(len(keys), dtype=np.uint64), 1
    while have < SPAN:
        step = min(have, SPAN - have)
        best = np.minimum(best[step:], best[:-step])
        have += step
    chosen = (best & PLACE).astype(np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    # A piece ends where the anchor changes; windows across two texts are cut off and left out.
    new = np.empty(len(chosen), bool)
    new[0] = True
    np.not_equal(chosen[1:], chosen[:-1], out=new[1:])
    long_enough = lengths >= WINDOW
    new[starts[long_enough]] = True
    beyond = ends[long_enough] - WINDOW + 1
    new[beyond[beyond < len(new)]] = True
    lo = np.flatnonzero(new)
    hi = np.r_[lo[1:] - 1, len(chosen) - 1]
    doc = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, np.searchsorted(lo, ends)]))
    inside = lo + WINDOW <= ends[doc]
    lo, hi, doc = lo[inside], hi[inside], doc[inside]
    anchor_at = chosen[lo]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(joined, np.uint8, n).astype(np.uint64) + np.uint64(1)) * powers(n, BASE)[:n], out=sums[1:])
    back = powers(n, INVERSE)
    whole = mix((sums[hi + WINDOW] - sums[lo]) * back[lo] + mix(((hi - lo) * 64 + (anchor_at - lo)).astype(np.uint64)))

    def side(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        held = (a >= lo) & (b <= hi + WINDOW)
        out = np.zeros(len(lo), np.uint64)
        a, b = a[held], b[held]
        out[held] = mix((sums[b] - sums[a]) * back[a]) | np.uint64(1)
        return out

    start = starts[doc]
    out = {"doc": doc, "lo": lo - start, "hi": hi - start, "at": anchor_at - start, "anchor": keys[anchor_at], "whole": whole}
    return out | {"left": side(anchor_at - HALF, anchor_at + KEY), "right": side(anchor_at, anchor_at + KEY + HALF)}


def shared_parts(strings: list[bytes], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces, each with one anchor, what may hold a 50-byte string of another document: number, start and stop.

    Next to its anchor, such a string holds 17 bytes or more on one side. So where a piece's 17 bytes before the anchor
    are those of no other document, only the strings that begin at most 17 bytes before it count, and the other way round.
    """
    p = pieces(strings)
    at, n = p["at"], np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings), np.uint8)
    start = np.cumsum(n) - n
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), BASE)[: len(data)], out=sums[1:])

    def shared(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        ok = np.flatnonzero((low >= 0) & (high <= n))
        a, b = (start + low)[ok], (start + high)[ok]
        key = mix((sums[b] - sums[a]) * powers(len(data), INVERSE)[a])
        order = np.lexsort((doc[ok], key))
        k, d = key[order], doc[ok][order]
        new = np.r_[True, k[1:] != k[:-1]][: len(k)]
        group = np.cumsum(new) - 1
        begins = np.flatnonzero(new)
        several = np.minimum.reduceat(d, begins) < np.maximum.reduceat(d, begins) if len(d) else new
        out = np.zeros(len(n), bool)
        out[ok[order]] = several[group]
        return out

    left, right = shared(at - HALF, at + KEY), shared(at, at + KEY + HALF)
    low = np.where(left, 0, np.maximum(0, at - HALF))
    high = np.where(right, n, np.minimum(n, at - HALF + WINDOW))
    keep = np.flatnonzero((left | right) & (high - low >= WINDOW))
    return keep, low[keep], high[keep]
