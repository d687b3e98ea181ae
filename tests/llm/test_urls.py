import hashlib
import math
import re
from collections import Counter

from conftest import plan
from helpers_llm import SMALL, con, same_as_sql  # noqa: F401

from weirworks.llm import urls
from weirworks.llm.queries import QUERIES, URL_RULES

ODD = [
    (1, "HTTPS://Www.Example.ORG/en/1?q#f"),
    (1, "HTTPS://Www.Example.ORG/en/1?q#f"),
    (2, None),
    (3, ""),
    (4, "no-scheme.org/x"),
    (5, "a://b://c.org/d"),
    (6, "x://ORG/"),
    (7, "x://org"),
    (8, "x://notorg/a"),
    (9, "x://example.org/es/ü😀#/"),
    (None, "x://example.org/es"),
    (2**60 + 1, "x://a.com/de/" + "é" * 3_000),
    (11, "x://host.net?/fr/"),
    (12, "x://b.com/fr/\n2"),
]


def brute(rows):
    rules = [tuple(r) for r in URL_RULES]
    judged = []
    for page, url in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = m.groups() if m else ("", "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        judged.append((page, host, path, max(fit, key=lambda r: len(r[0] + r[1])) if fit else None))

    def spelled(text):
        whole = "\x02" * 5 + text + "\x03"
        return [whole[n - 5 : n + 1] for n in range(5, len(whole))]

    held = lambda text: hashlib.md5(text.encode()).hexdigest()[0] < "4"
    seen = {"allow": Counter(), "block": Counter()}
    for text, verdict in {(h + p, r[2]) for _, h, p, r in judged if r and not held(h + p)}:
        for gram in spelled(text):
            seen[verdict].update(gram[-n:] for n in range(1, 7))
    whole = {v: Counter() for v in seen}
    kinds = {v: Counter(g[:-1] for g in seen[v]) for v in seen}
    for v in seen:
        for gram, n in seen[v].items():
            whole[v][gram[:-1]] += n

    def chance(v, gram):
        p = 1 / 256
        for n in range(1, 7):
            g = gram[-n:]
            if whole[v][g[:-1]]:
                p = (seen[v][g] + kinds[v][g[:-1]] * p) / (whole[v][g[:-1]] + kinds[v][g[:-1]])
        return p

    def score(text):
        each = [math.floor((math.log(chance("allow", g)) - math.log(chance("block", g))) * 1e6 + 0.5) for g in spelled(text)]
        return math.floor(sum(each) / (len(each) * 1000))

    marks = [(max(-20_000, min(20_000, score(h + p))), r[2] == "allow") for _, h, p, r in judged if r and held(h + p)]
    good = sum(a for _, a in marks)
    least = 0
    if 0 < good < len(marks):

        def right(b):
            return sum(a and s >= b for s, a in marks) * (len(marks) - good) + sum(not a and s < b for s, a in marks) * good

        least = max({s for s, _ in marks}, key=lambda b: (right(b), -abs(b), -b))
    return [(i, h, p, r and r[0] + r[1], r[2] if r else "allow" if score(h + p) >= least else "block") for i, h, p, r in judged]


def found(df):
    return sorted(map(tuple, urls.judge(df, URL_RULES).collect()), key=repr)


def test_query_against_sql(spark, con):  # noqa: F811
    same_as_sql(spark, con, "op11_urls")


def test_odd_urls(spark):
    df = spark.createDataFrame([(*r, "h", 1.0) for r in ODD * 3], "page_id long, url string, host string, score double")
    got = found(df)
    assert got == sorted(brute(ODD * 3), key=repr)
    said = {r[0]: r for r in got}
    assert said[1][1:] == ("www.example.org", "/en/1", "example.org/en/1", "block")
    assert said[2][1:4] == said[3][1:4] == said[4][1:4] == ("", "", None)
    assert said[5][1:4] == ("b:", "//c.org/d", None) and said[6][3:] == ("org/", "allow") and said[7][3] is None and said[8][3] is None
    assert said[2**60 + 1][4] == "block" and said[11][1:3] == ("host.net", "")


def test_both_ways_to_the_scores_agree(spark, monkeypatch):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    usual = found(pages)
    monkeypatch.setattr(urls, "HOT", 1)  # no gram is frequent
    assert found(pages) == usual
    monkeypatch.setattr(urls, "HOT", 10**9)  # every gram is
    assert found(pages) == usual


def test_no_rows_and_no_rules(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    assert urls.judge(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in urls.judge(pages, []).collect()} == {"allow"}
    one_kind = urls.judge(pages, [urls.Rule("com", "/", "block")]).collect()
    assert {r.verdict for r in one_kind if r.rule} == {"block"} and len(one_kind) == pages.count()


def test_no_python_in_the_plan(spark):
    assert "Python" not in plan(QUERIES["op11_urls"](spark, SMALL))
