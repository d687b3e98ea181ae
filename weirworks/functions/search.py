"""Ranked search for a short query over name, type and keyword columns of any table."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores by how a query matches. A substring of the name loses one point per position.
NAME_PREFIX, NAME_PART, TYPE_PART = 1000, 900, 800
KEYWORD_EQUAL, KEYWORD_PREFIX, KEYWORD_PART = 780, 760, 700
NAME_LETTERS, TYPE_LETTERS, TYPO = 600, 550, 500
# One typo for queries up to this length, two beyond.
SHORT_QUERY = 4


def plain(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def plain_column(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def letters_in_order(query: str, text: Column) -> Column:
    return text.rlike(".*".join(re.escape(ch) for ch in query))


def _swap(text: str, at: int) -> str:
    return text[:at] + text[at + 1] + text[at] + text[at + 2 :]


def close_to(query: str, word: Column, typos: int) -> Column:
    """Whether ``word`` is at most ``typos`` (1 or 2) edits from the query; swapping neighbours is one edit.

    Insertions, deletions and substitutions are a Levenshtein distance. A swap leaves its two letters next to
    each other, so with a swap at a known place the word is a fixed middle between two parts, of which one may
    hold the other edit.
    """
    swaps = range(len(query) - 1)
    tests = [F.levenshtein(F.lit(query), word, typos).between(0, typos), word.isin([_swap(query, i) for i in swaps]) if swaps else F.lit(False)]
    if typos == 2:
        twice = {_swap(_swap(query, i), j) for i in swaps for j in swaps if abs(i - j) > 1}
        if twice:
            tests.append(word.isin(sorted(twice)))
        for i in swaps:
            middle, before, after = query[i + 1] + query[i], query[:i], query[i + 2 :]
            tail = F.substr(word, F.lit(i + 3))
            head = F.left(word, F.length(word) - F.lit(len(middle + after)))
            tests.append(word.startswith(before + middle) & F.levenshtein(F.lit(after), tail, 1).between(0, 1))
            tests.append(word.endswith(middle + after) & F.levenshtein(F.lit(before), head, 1).between(0, 1))
    return reduce(lambda a, b: a | b, tests)


def score(query: str, name: Column, kind: Column, keywords: Column | None = None) -> Column:
    """Higher is better; NULL means no match. Ties of tiers are settled by the order of the tiers."""
    q = plain(query)
    if not q:
        return F.lit(0)
    n, t = plain_column(name), plain_column(kind)
    words = F.transform(keywords, plain_column) if keywords is not None else F.array().cast("array<string>")
    at = F.instr(n, q)
    holding = F.get(F.filter(words, lambda w: w.contains(q)), F.lit(0))
    every = F.concat(F.split(n, " "), F.array(F.replace(t, F.lit(" "), F.lit(""))), words)
    typos = 1 if len(q) <= SHORT_QUERY else 2
    return (
        F.when(at == 1, NAME_PREFIX)
        .when(at > 1, F.lit(NAME_PART) - (at - 1))
        .when(t.contains(q), TYPE_PART)
        .when(holding == q, KEYWORD_EQUAL)
        .when(holding.startswith(q), KEYWORD_PREFIX)
        .when(holding.isNotNull(), KEYWORD_PART)
        .when(letters_in_order(q, n), NAME_LETTERS)
        .when(letters_in_order(q, t), TYPE_LETTERS)
        .when(F.exists(every, lambda w: close_to(q, w, typos)), TYPO)
    )
