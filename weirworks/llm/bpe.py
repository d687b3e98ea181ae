"""Byte-pair encoding and decoding by forced boundaries.

A pair of neighbouring symbols that occurs inside no token of the vocabulary can never be merged across, whatever the
merge order: the pair is a certain cut. A word falls into fragments at its cuts; each fragment is encoded for itself,
remembered, and the ids are put together again. Encoding a fragment costs the square of its length, so the cuts also
keep very long "words" cheap, and fragments repeat far more often than words.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from weirworks.llm.common import arrow_slices, col, fresh

# Entries remembered in a worker (twice as many at most, as the last full memory is kept too), and the symbols from which on a fragment is merged by a heap.
CHUNK_MEMORY, FRAGMENT_MEMORY, LONG = 150_000, 75_000, 48
# White space to split() but not to the vocabulary's pattern.
SEPARATORS = regex.compile("[\x1c-\x1f]")


class Memory(dict):
    """Remembers what ``make`` gave for a key. When it is full it forgets what was not asked for since it was last full."""

    def __init__(self, make: Callable[[str], tuple[int, ...]], most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> tuple[int, ...]:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = self.copy()
                self.clear()
            self[key] = out
        return out


# The letters and numbers of Unicode 16, which the tokenizer files' engine counts and Python 3.13 does not
# assign, and the capitals that the engine puts in lower case and Python 3.13 does not (first, last, distance).
UNICODE_16 = {
    "L": [
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
        (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
        (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
        (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ],
    "N": [
        (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
        (0x1E5F1, 0x1E5FA),
    ],
}
LATER_CAPITALS = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]
TO_LOWER = {chr(c): chr(c + step) for first, last, step in LATER_CAPITALS for c in range(first, last + 1)}
LATER = re.compile("[" + "".join(TO_LOWER) + "]")


@lru_cache(maxsize=2)
def newer(kind: str) -> str:
    """Ranges of letters (L) or numbers (N) of the regex library that the tokenizer files' engine does not count.

    That is what Python does not assign and Unicode 16 did not add.
    """
    free = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    added = {c for first, last in UNICODE_16[kind] for c in range(first, last + 1)}
    runs: list[list[int]] = []
    for c in map(ord, regex.findall(rf"\p{{{kind}}}", free)):
        if c not in added:
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"{chr(first)}-{chr(last)}" for first, last in runs)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next free one."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class BytePairs:
    """A tokenizer read from a JSON vocabulary file: merges, word ends, the pattern that splits words, added tokens."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: n for n, pair in enumerate(pairs)}
        self.shown = dict(enumerate(byte_symbols()))
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # The files' engine takes \s as the white space of Unicode, without the separators U+001C to U+001F.
        words = split["pattern"]["Regex"].replace("[^\\s", "[^\\p{White_Space}")
        self.pattern = regex.compile(words, regex.V0)
        # For texts with characters that the engine does not count, which are rare: the same without them, at length.
        later = {kind: newer(kind) for kind in "LN"}
        self.newer = re.compile(f"[{later['L']}{later['N']}]")
        for kind, ranges in later.items():
            words = words.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{ranges}]]")
        self.careful = regex.compile(words, regex.V1)
        # Whether the pattern takes any run of letters for one word.
        self.letters = "[\\p{L}]+|" in split["pattern"]["Regex"]
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        # Pairs of neighbouring symbols inside some token, apart from those whose second symbol ends a word.
        self.inside, self.inside_end = set(), set()
        for token in self.ids:
            body, ends = (token[: -len(self.end)], True) if self.end and token.endswith(self.end) and len(token) > len(self.end) else (token, False)
            pairs_of = [body[n : n + 2] for n in range(len(body) - 1)]
            if ends and pairs_of:
                self.inside_end.add(pairs_of.pop())
            self.inside.update(pairs_of)
        self.texts = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        self.no_decoder = spec.get("decoder") is None
        # The same by id, for many ids at once.
        size = max(self.texts, default=-1) + 1
        self.table = pa.array([self.texts.get(i, "") for i in range(size)], pa.string())
        self.spelled = np.array([i in self.texts for i in range(size)], bool)
        self.chunks = Memory(self._chunk, CHUNK_MEMORY)
        self.words = Memory(self.word, FRAGMENT_MEMORY)
        self.fragments = Memory(self._fragment, FRAGMENT_MEMORY)

    def normal(self, text: str) -> str:
        if "NFC" in self.steps and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if "Lowercase" in self.steps:
            # Letter by letter: a sigma that ends a word gets no form of its own.
            if not text.isascii():
                text = LATER.sub(lambda m: TO_LOWER[m.group()], text.replace("Σ", "σ"))
            text = text.lower()
        return text

    def cut(self, word: str) -> list[str]:
        """The fragments of a word in byte symbols; the mark of the word's end closes the last one."""
        out, start, last, inside = [], 0, len(word) - 1, self.inside
        for at in range(1, last):
            if word[at - 1 : at + 1] not in inside:
                out.append(word[start:at])
                start = at
        if last and word[last - 1 :] not in (self.inside_end if self.end else inside):
            out.append(word[start:last])
            start = last
        out.append(word[start:] + self.end)
        return out

    def _fragment(self, fragment: str) -> tuple[int, ...]:
        if self.end and fragment.endswith(self.end) and len(fragment) > len(self.end):
            body = fragment[: -len(self.end)]
            return self.merged((*body[:-1], body[-1] + self.end))
        return self.merged(tuple(fragment))

    def merged(self, fragment: tuple[str, ...]) -> tuple[int, ...]:
        """The ids of one fragment: the leftmost pair of lowest rank is joined, until no pair is left."""
        if len(fragment) > LONG:
            return self._merged_long(fragment)
        parts, rank_of, none = list(fragment), self.ranks.get, len(self.ranks)
        ranks = [rank_of(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            lowest = min(ranks)
            if lowest == none:
                break
            at = ranks.index(lowest)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of((parts[at], parts[at + 1]), none)
            if at:
                ranks[at - 1] = rank_of((parts[at - 1], parts[at]), none)
        return tuple([self.ids[p] for p in parts if p in self.ids])

    def _merged_long(self, fragment: tuple[str, ...]) -> tuple[int, ...]:
        """The same with a heap over linked parts, for fragments whose square would hurt."""
        parts: list[str | None] = list(fragment)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(self.ranks[pair], at) for at, pair in enumerate(zip(fragment, fragment[1:], strict=False)) if pair in self.ranks]
        heapify(heap)
        while heap:
            rank, at = heappop(heap)
            then = after[at]
            if parts[at] is None or then >= len(parts) or self.ranks.get((parts[at], parts[then])) != rank:
                continue
            parts[at], parts[then] = parts[at] + parts[then], None
            after[at] = after[then]
            if after[at] < len(parts):
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < len(parts) and (pair := (parts[left], parts[after[left]])) in self.ranks:
                    heappush(heap, (self.ranks[pair], left))
        return tuple([self.ids[p] for p in parts if p is not None and p in self.ids])

    def word(self, word: str) -> tuple[int, ...]:
        fragments = self.cut(word.encode("utf-8", "replace").decode("latin-1").translate(self.shown))
        if len(fragments) == 1:
            return self.fragments[fragments[0]]
        return tuple(chain.from_iterable(map(self.fragments.__getitem__, fragments)))

    def encode(self, text: str) -> list[int]:
        """Ids of a text. Added tokens that it spells out are taken as such."""
        if not text:
            return []
        out: list[int] = []
        at = 0
        for m in self.specials.finditer(text) if self.specials and "<" in text else ():
            self._encode_plain(text[at : m.start()], out)
            out.append(self.added[m.group()])
            at = m.end()
        self._encode_plain(text[at:] if at else text, out)
        return out

    def _encode_plain(self, text: str, out: list[int]) -> None:
        """No word of the pattern holds white space, so what stands between white space is encoded, and remembered, whole."""
        plain = self.normal(text)
        if SEPARATORS.search(plain):
            out += self._chunk(plain)
        else:
            out += chain.from_iterable(map(self.chunks.__getitem__, plain.split()))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        if chunk.isalpha() and self.letters:
            return self.word(chunk)
        pattern = self.careful if self.newer.search(chunk) else self.pattern
        return tuple(chain.from_iterable(map(self.words.__getitem__, pattern.findall(chunk))))

    def decode(self, ids) -> str:
        """The text of ids. Without a decoder in the file, that is the tokens with a space between any two.

        Ids outside the vocabulary have no text.
        """
        texts = self.texts
        return (" " if self.no_decoder else "").join([texts[i] for i in ids if i in texts])


@lru_cache(maxsize=4)
def _loaded(vocabulary: str) -> BytePairs:
    return BytePairs(vocabulary)


def read_vocabulary(path: str) -> str:
    """The tokenizer file, read once on the driver; it goes to the tasks with their code (about a megabyte)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _sent(df: DataFrame, vocabulary: str):
    return df.sparkSession.sparkContext.broadcast(vocabulary)


def _texts(coder: BytePairs, offsets: np.ndarray, flat: np.ndarray) -> pa.Array:
    """The texts of rows of ids, which stand end to end."""
    table = coder.table
    inside = (flat >= 0) & (flat < len(table))
    inside[inside] = coder.spelled[flat[inside]]
    if not inside.all():  # ids outside the vocabulary have no text
        offsets = np.r_[0, np.cumsum(inside)][offsets]
        flat = flat[inside]
    tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), table.take(pa.array(flat)))
    return pc.binary_join(tokens, " " if coder.no_decoder else "")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the column ``ids`` (array<int>). A null or empty text has no ids; no rows are moved.

    ``decoded`` names a further column for the text that the ids give back, as ``decode`` has it. Columns of these names
    in ``docs`` are replaced; all others pass through as they are, whatever their types and nulls.
    """
    sent = _sent(docs, read_vocabulary(path))
    new = {ids.lower()} | ({decoded.lower()} if decoded else set())
    kept = [c for c in docs.columns if c.lower() not in new]
    (body,) = fresh(docs, "bpe_text")
    out = docs.select(*[col(docs, c) for c in kept], col(docs, text).cast("string").alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(sent.value)
        for batch in arrow_slices(batches):
            found = [coder.encode(t or "") for t in batch.column(len(kept)).to_pylist()]
            offsets = np.r_[0, np.cumsum([len(f) for f in found], dtype=np.int64)].astype(np.int64)
            flat = np.fromiter(chain.from_iterable(found), np.int32, count=int(offsets[-1]))
            columns = [*batch.columns[: len(kept)], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))]
            if decoded:
                columns.append(_texts(coder, offsets, flat))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids, *([decoded] if decoded else [])])

    fields = [StructField(ids, ArrayType(IntegerType())), *([StructField(decoded, StringType())] if decoded else [])]
    return out.mapInArrow(run, StructType([*[f for f in docs.schema if f.name in kept], *fields]))


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in the column ``text``; null ids give an empty text."""
    sent = _sent(encoded, read_vocabulary(path))
    kept = [c for c in encoded.columns if c.lower() != text.lower()]
    (body,) = fresh(encoded, "bpe_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(sent.value)
        for batch in arrow_slices(batches):
            rows = pa.concat_arrays([batch.column(len(kept))])
            sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy().astype(np.int64)
            flat = pc.fill_null(rows.flatten(), -1).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], _texts(coder, np.r_[0, np.cumsum(sizes)], flat)], names=[*kept, text])

    out = encoded.select(*[col(encoded, c) for c in kept], col(encoded, ids).cast("array<int>").alias(body))
    return out.mapInArrow(run, StructType([*[f for f in encoded.schema if f.name in kept], StructField(text, StringType())]))
