"""Burrows-Wheeler transforms of string collections over numpy arrays, merged without sorting suffixes again.

A collection is stored end to end, each string closed by a 0 (symbols are bytes plus 1). ``transform`` sorts the suffixes
of one shard. ``merge`` interleaves the transforms of several shards: it begins with the shards one after the other and
reorders the interleave by one more symbol of context in every round. The round in which two neighbours first part is
their common prefix, so the prefix lengths come with the merge.
"""

from __future__ import annotations

import numpy as np

BASE = 257


def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys (not negative) in order, and the stable order itself.

    Where both fit into one number, a key is sorted with its place behind it, which is much faster than sorting places.
    """
    bits = max(1, len(keys) - 1).bit_length()
    if int(keys.max(initial=0)) >> (63 - bits):
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    both = np.sort((keys << bits) | np.arange(len(keys)))
    return both >> bits, both & ((1 << bits) - 1)


def _named(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the number of each value among them."""
    ordered, order = in_order(values)
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    names = np.empty(len(values), np.int64)
    names[order] = np.cumsum(new) - 1
    return ordered[new], names


def collection(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the strings end to end, and for each place the number of its string and the place in it."""
    data = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8).astype(np.int16) + 1
    lengths = np.array([len(s) + 1 for s in strings])
    data[np.cumsum(lengths) - 1] = 0
    number = np.repeat(np.arange(len(strings)), lengths)
    return data, number, np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def transform(data: np.ndarray, number: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The shard's transform and its suffix order, by doubling the compared length up to the longest string.

    Equal suffixes stand in the order of their strings. The symbol before a string's first one is its own end. The
    transform holds the ``step`` symbols before each suffix as one number in base ``BASE``.
    """
    n = len(data)
    last = np.flatnonzero(data == 0)
    end = last[number]
    longest = int(np.diff(np.r_[-1, last]).max())
    here = np.arange(n)
    # As many symbols as fit beside a place make the first key; places behind a string's end count as 0.
    used, code = _named(data.astype(np.int64))
    wide = max(1, (len(used) - 1).bit_length())
    span = max(1, (63 - max(1, n - 1).bit_length()) // wide)
    left = end - here
    key = np.zeros(n, np.int64)
    for k in range(span):
        key <<= wide
        key[: n - k] |= np.where(left[: n - k] >= k, code[k:], 0)
    while True:
        ordered, order = in_order(key)
        if span >= longest:
            break
        rank = np.empty(n, np.int64)
        new = np.zeros(n, np.int64)
        new[1:] = ordered[1:] != ordered[:-1]
        rank[order] = np.cumsum(new)
        # A string's end makes its suffixes differ from longer ones, so what lies behind it is not looked at.
        key = rank * (n + 1)
        if span < n:
            key[: n - span] += np.where(left[: n - span] >= span, rank[span:] + 1, 0)
        span *= 2
    before = here - 1
    before[np.r_[0, last[:-1] + 1]] = last
    symbol, at = np.zeros(n, np.int64), order
    for k in range(step):
        at = before[at]
        symbol += data[at].astype(np.int64) * BASE**k
    return symbol, order


def merge(shards: list[np.ndarray], depth: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' transforms, and the common prefix of each suffix with the one before it.

    The interleave names the shard of every suffix of the whole in order; common prefixes count up to ``depth`` in whole
    steps. In a round, each shard's symbols are read in the order found so far and dealt out stably by symbol: that orders
    all suffixes by ``step`` symbols more, as these stand before a suffix whose place is known. Two neighbours part in
    the round in which they begin with different symbols or went on with suffixes that had parted. Ends of strings differ.
    """
    used, names = _named(np.concatenate(shards))
    total = len(names)
    ends = np.zeros(len(used), bool)
    for k in range(step):
        ends |= used // BASE**k % BASE == 0
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) <= 256 else np.int32), [len(s) for s in shards])
    prefix = np.full(total, depth, np.int16)
    group = np.zeros(total, np.int32)
    parted = np.zeros(total, bool)
    symbols = names.copy()
    for n in range(0, depth, step):
        if len(shards) > 1:
            symbols[np.argsort(interleave, kind="stable")] = names
        symbol, deal = in_order(symbols)
        interleave, before = interleave[deal], group[deal]
        edge = ends[symbol]
        edge[0] = True
        edge[1:] |= (symbol[1:] != symbol[:-1]) | (before[1:] != before[:-1])
        prefix[edge & ~parted] = n
        parted |= edge
        group = np.cumsum(parted, dtype=np.int32)
    return interleave, prefix
