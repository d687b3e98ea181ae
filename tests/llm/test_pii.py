import hashlib
import random
import re

from helpers_llm import SMALL, no_docs, odd_docs, small_docs  # noqa: F401

from weirworks.llm import pii
from weirworks.llm.queries import QUERIES

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        twice = [int(c) * (1 + n % 2) for n, c in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), n, k, m.end()) for n, (k, p) in enumerate(FORMS.items()) for m in re.finditer(p, text or "") if good(k, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def spans(df):
    return {r.doc_id: (r.base, r.spans) for r in pii.find(df).select("doc_id", pii.listed("base").alias("base"), pii.listed("spans").alias("spans")).collect()}


def test_query(spark, small_docs):  # noqa: F811
    got = {r.doc_id: r for r in QUERIES["op1_pii"](spark, SMALL).collect()}
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        base = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in FORMS] == [base.count(f"{k}:") for k in FORMS]
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))


def test_odd_strings(spark):
    luck = random.Random(3)
    pool = [*"0123456789..@@+-- ()aZ_%é😀\n\t", "4111111111111111", "1.2.3.4", "+1 (555) 555-1234", "a@b.co", "256", "12"]
    docs = [(i, "".join(luck.choice(pool) for _ in range(luck.randint(0, 40)))) for i in range(4_000)]
    docs += [(90_001, "1 2" * 5_000), (90_002, "a." * 100 + "@b" + ".c" * 9_000)]
    # Long runs stay linear: none of these holds anything.
    runs = [(95_001, "a" * 500_000), (95_002, "+" * 200_000), (95_003, "9" * 500_000), (95_004, "300." * 50_000), (95_005, "12 7 " * 50_000)]
    got = spans(spark.createDataFrame(docs + runs, "doc_id long, text string").repartition(4))
    assert [i for i, t in docs if got[i][0] != brute(t)] == [] and all(got[i][0] == "" for i, _ in runs)


def test_contexts_find_what_the_form_does_not(spark):
    known = ["+1 555 123 4567", "+44 20 7946 0958", "+49 301 234 5678", "+33 1 23 45 67 89"]
    docs = [(i, f"please call my number {p} today") for i, p in enumerate([*known, "555-123-9999", "2024-01", "12"])]
    docs += [(50, "the total was 555 of 777-888-999 parts"), (51, "I said: call my number 555.123.1111 today"), (52, "tel 555-123-9999")]
    got = {i: s for i, (b, s) in spans(spark.createDataFrame(docs, "doc_id long, text string")).items() if b != s}
    assert got == {4: "phone:22:34", 51: "phone:23:35", 52: "phone:4:16"}


def chain():
    """300 documents in which a pattern without a seed counts only by values that another pattern found before."""
    luck = random.Random(8)
    word = lambda: "".join(luck.choice("abcdefghij") for _ in range(6))
    form = [f"+1 555 {100 + n} 1000" for n in range(40)]
    first = [f"555-{200 + n}-2000" for n in range(8)]
    second = [f"555-{300 + n}-3000" for n in range(4)]
    third = [f"555-{400 + n}-4000" for n in range(2)]
    said = [("please dial", v) for v in [*form, *first]] + [("office desk", v) for v in [*first, *second]] + [("night bell", v) for v in [*second, *third]]
    said += [("order code", f"{n}-{n}-{n}") for n in range(100, 160)] + [("order code", v) for v in first[:2]]
    texts = [f"{word()} {word()} {before} {v} {word()} {word()}" for before, v in said]
    texts += [" ".join(word() for _ in range(12)) for _ in range(300 - len(texts))]
    return list(enumerate(texts)), form, first, second, third


def rounds(docs, least=3, pattern=0.5, value=0.5):
    """The values found after each round, by plain code, for two words before and one word on either side."""
    links = {}
    for _, text in docs:
        m = re.search(r"(\+1 555 \d+ 1000|\d+-\d+-\d+)", text)
        if m:
            before, after = text[: m.start()].split(), text[m.end() :].split()
            for p in (f"{before[-2]} {before[-1]} _", f"{before[-1]} _ {after[0]}"):
                links.setdefault(p, set()).add(m.group())
    seed = lambda v: v.startswith("+")
    found, out = {}, []
    while True:
        score = {}
        for vs in links.values():
            count = sum(seed(v) for v in vs) + sum(v in found for v in vs)
            trust = min(0.99, (sum(seed(v) for v in vs) + sum(found.get(v, 0) for v in vs)) / len(vs))
            if count >= least and trust >= pattern:
                for v in vs:
                    if not seed(v):
                        score[v] = 1 - (1 - score.get(v, 0)) * (1 - trust)
        now = {v: s for v, s in score.items() if s >= value}
        if len(now) == len(found):
            return out
        found = now
        out.append(set(now))


def test_rounds_follow_a_chain(spark):
    docs, form, first, second, third = chain()
    steps = rounds(docs)
    assert len(docs) == 300 and steps[0] == set(first) and steps[1] == {*first, *second} and steps[-1] >= {*first, *second}
    got = spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    more = {i for i, (base, every) in got.items() if base != every}
    assert more == {i for i, t in docs if any(v in t for v in steps[-1])}


def test_odd_rows(odd_docs, no_docs):  # noqa: F811
    got = spans(odd_docs)
    assert len(got) == 9 and got[8][0] == "email:5:19,phone:23:40,ip:42:50,card:52:71" and got[3] == ("", "")
    assert pii.find(no_docs).count() == 0
