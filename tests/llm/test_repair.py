import hashlib
import random
import re
import zlib

import pytest
from helpers_llm import SMALL  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from weirworks.llm import repair
from weirworks.llm.queries import QUERIES

BLANK = " \t\n\x0b\x0c\r"
END = (0, repair.NEVER, repair.NEVER, 0)


def brute(rows):
    """All states after each row with their cheapest edits (cost, then initials), rows given as (role, text)."""
    seen, codes = set(), []
    for role, text in rows:
        body = text.strip(BLANK)
        codes.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
        seen.add((role, text))

    def inserted(best):
        for _ in range(3):
            for state, (cost, edits, out) in list(best.items()):
                to, role = ("a", "assistant") if state == "u" else ("u", "user")
                new = (cost + 5, edits + "I", (*out, role + ":"))
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = {"": (0, "", ())}
    for (role, text), code in zip(rows, codes, strict=True):
        best, new = inserted(best), {}

        def put(state, found, new=new):
            if state not in new or found[:2] < new[state][:2]:
                new[state] = found

        for state, (cost, edits, out) in best.items():
            put(state, (cost + 2, edits + "D", out))
            if code in ("b", "d"):
                continue
            more = 5 if code == "t" else 0
            if role[:1] and role[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[state]:
                put(role[:1], (cost + more, edits + "K", (*out, f"{role}:{text}")))
            to, given_role = ("a", "assistant") if state == "u" else ("u", "user")
            put(to, (cost + more + 1, edits + "R", (*out, f"{given_role}:{text}")))
        best = new
    cost, edits, out = min((v for k, v in inserted(best).items() if k in ("", "a")), key=lambda v: v[:2])
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return codes.count("b"), codes.count("d"), codes.count("t"), illegal, cost, edits, hashlib.sha256("\n".join(out).encode()).hexdigest()


def whole_brute(rows):
    """rows: (conv, turn, role, text) as they are; damage, order, faults and repair."""
    held = {}
    shown = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        held.setdefault(conv, [])
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else shown(role), "" if kind == 1 else re.sub("[.!?]", "", shown(text)) if kind == 2 else shown(text)
        held[conv] += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, said in held.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = [r[0] for r in said if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *brute([r[1:] for r in said])))
    return sorted(out, key=repr)


def found(df):
    rows = repair.damaged(df).withColumnRenamed("conv", "conv_id")
    return sorted(map(tuple, repair.repair(rows, df).collect()), key=repr)


def rows_of(codes):
    role = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    return [(role.get(c.lower(), "user"), "" if c in "bd" else f"{n}" + ("" if c.isupper() else ".")) for n, c in enumerate(codes)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ssuuuaaaoSUAOb", max_size=14))
def test_search_against_all_paths(codes):
    cost, edits, _ = repair.cheapest(codes, repair.START, END, True)
    assert (cost, edits) == brute(rows_of(codes))[4:6]


def test_ends_that_cannot_be_reached():
    only_system = [repair.NEVER] * 4
    only_system[repair.SYSTEM] = 0
    assert repair.cheapest("uaua", repair.START, only_system, False) is None
    assert repair.cheapest("uasa", repair.START, only_system, False) == (6, "DDKD", repair.SYSTEM)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_repair"](spark, SMALL).collect()), key=repr) == whole_brute(rows)


SCHEMA = "conv_id long, turn long, role string, text string"


def made(count, seed):
    luck = random.Random(seed)
    return [
        (luck.choice([1, 2**60 + 1, None]), luck.choice([None, *range(count)]), luck.choice(["user", "assistant", "system", "tool", None, "", "a"]), luck.choice(["Yes.", "No", " \n", None, "", f"{n}!", "ü?"]))
        for n in range(count)
    ]


@pytest.mark.parametrize("most", [128, 3])
def test_odd_rows_whole_and_in_segments(spark, monkeypatch, most):
    monkeypatch.setattr(repair, "WHOLE_ROWS", most)
    rows = made(300, 5) + [(7, 0, "user", "x"), (8, None, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", key string, n int")
    assert found(df) == whole_brute(rows)


def test_a_conversation_with_most_rows(spark):
    luck = random.Random(2)
    hot = [(1, n, luck.choice(["user", "assistant"]), luck.choice([f"{n}.", f"{n}", "Same."])) for n in range(3_000)]
    rows = hot + [(n, t, ("user", "assistant")[t % 2], "Fine.") for n in range(2, 30) for t in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == whole_brute(rows)


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    dropped = next(n for n in range(1000) if zlib.crc32(f"5:{n}".encode()) % 20 == 0)
    got = found(spark.createDataFrame([(5, dropped, "user", "x.")], SCHEMA))
    assert got == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
