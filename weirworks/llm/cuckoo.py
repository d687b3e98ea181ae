"""A cuckoo filter over numpy arrays: buckets of four 16-bit fingerprints, filled and probed a batch at a time."""

from __future__ import annotations

import numpy as np

WAYS = 4
LOAD = 0.8
# Odd multipliers that mix 64-bit values (fixed values of a published finaliser).
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_1
        x = (x ^ (x >> np.uint64(27))) * MIX_2
        return x ^ (x >> np.uint64(31))


class CuckooFilter:
    """Never denies a key that it holds; takes a key that it does not hold for one in about 1 of 8,000 probes.

    ``slots`` is a matrix of buckets and ways; 0 is an empty slot. A key's second bucket follows from the first one
    and the fingerprint, so entries move and leave without the key.
    """

    def __init__(self, slots: np.ndarray):
        self.slots = slots
        self.mask = np.int64(len(slots) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1
        while buckets * WAYS * LOAD < keys:
            buckets *= 2
        return cls(np.zeros((buckets, WAYS), np.uint16))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, WAYS).copy())

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(hashes.astype(np.uint64))
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, (h & np.uint64(self.mask)).astype(np.int64)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(np.uint64)).astype(np.int64) & self.mask)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        prints, at = self._places(hashes)
        both = (self.slots[at] == prints[:, None]) | (self.slots[self._other(at, prints)] == prints[:, None])
        return both.any(axis=1)

    def add(self, hashes: np.ndarray) -> bool:
        """Put in every key (each once). False if there was no room; the filter must then be made anew, larger."""
        prints, at = self._places(hashes)
        luck = np.random.default_rng(len(hashes))
        for turn in range(600):
            if not len(prints):
                return True
            order = np.argsort(at, kind="stable")
            prints, at = prints[order], at[order]
            first = np.r_[0, np.flatnonzero(np.diff(at)) + 1]
            rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
            open_ways = np.argsort(self.slots[at] != 0, axis=1, kind="stable")
            free = (self.slots[at] == 0).sum(axis=1)
            fits = rank < free
            self.slots[at[fits], open_ways[fits, rank[fits]]] = prints[fits]
            prints, at, lead = prints[~fits], at[~fits], (rank == free)[~fits]
            if turn >= 2 and len(prints):  # both buckets are full: one newcomer a bucket takes the place of an entry
                way = luck.integers(0, WAYS, int(lead.sum()))
                prints = prints.copy()
                out = self.slots[at[lead], way].copy()
                self.slots[at[lead], way] = prints[lead]
                prints[lead] = out
            at = self._other(at, prints)
        return not len(prints)

    def remove(self, hashes: np.ndarray) -> None:
        """Take out one entry of each key; every key must be held."""
        for p, a in zip(*self._places(hashes), strict=True):
            for b in (a, self._other(np.array([a]), np.array([p]))[0]):
                ways = np.flatnonzero(self.slots[b] == p)
                if len(ways):
                    self.slots[b, ways[0]] = 0
                    break


def filled(hashes: np.ndarray) -> CuckooFilter:
    """A filter of these keys, made larger until all have room."""
    size = len(hashes)
    while True:
        out = CuckooFilter.sized(size)
        if out.add(hashes):
            return out
        size = max(8, len(out.slots) * WAYS)
