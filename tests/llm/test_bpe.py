import random

import pytest
from helpers_llm import no_docs, odd_docs, small_docs  # noqa: F401

from weirworks.llm import bpe
from weirworks.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    path = tokenizer_path()
    return bpe.BytePairs(bpe.read_vocabulary(path)), tokenizers.Tokenizer.from_file(path)


def check(pair, text):
    own, theirs = pair
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids, text
    assert own.decode(ids) == theirs.decode(ids, skip_special_tokens=False), text


def test_odd_texts(pair):
    pieces = "a B é É İ Σ ς ß ﬁ ́ 's 'LL 've 1 ٣ ½ ² <|endoftext|> <|startoftext|> <| |> 中 😀 - ... !! \x00 ǅ K _ the ing th".split(" ")
    luck = random.Random(1)
    for _ in range(3_000):
        check(pair, "".join(luck.choice([*pieces, " ", "\n", "\t", "\x1c", "\x85", "​", "　"]) for _ in range(luck.randint(0, 12))))


def test_long_fragments(pair):
    luck = random.Random(2)
    for size in (49, 60, 200, 3_000):
        check(pair, "".join(luck.choice("aabcdeé") for _ in range(size)))
    assert len(pair[0].encode("ab" * 100_000)) == len(pair[1].encode("ab" * 100_000, add_special_tokens=False).ids)


def test_cuts_are_certain(pair):
    own = pair[0]
    for word in ("qzxj", "hello", "don", "zqa"):
        for fragment in own.cut(word):
            assert fragment
    assert "".join(own.cut("qzxj")).removesuffix(own.end) == "qzxj"


def test_query_against_the_library(spark, small_docs, pair):
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    out = bpe.encode(small_docs.select("doc_id", "text"), tokenizer_path(), decoded="back").collect()
    for r in out:
        ids = pair[1].encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.back == pair[1].decode(ids, skip_special_tokens=False)


def test_odd_rows(odd_docs, no_docs):
    out = bpe.decode(bpe.encode(odd_docs, tokenizer_path(), ids="key"), tokenizer_path(), ids="key", text="row")
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "source", "key", "row"] and len(got) == 9
    assert got[3].key == [] and got[3].row == "" and got[4].key == []
    assert bpe.encode(no_docs, tokenizer_path()).count() == 0


def test_every_code_point(pair):
    """One of many of those all agree on; every one that Unicode's versions differ on."""
    own, theirs = pair
    rare = [c for c in map(chr, range(0x110000)) if own.newer.match(c) or c in bpe.TO_LOWER or bpe.unicodedata.category(c) == "Cn" and c.isprintable()]
    usual = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 37 == 0)]
    added = [chr(c) for kind in bpe.UNICODE_16.values() for first, last in kind for c in range(first, last + 1)]
    texts = [f"b{c}b 1{c}1 .{c}" for c in [*rare, *usual, *added]]
    for text, other in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text) == other.ids, text


def test_memory_keeps_what_is_asked_for():
    made = []
    memory = bpe.Memory(lambda key: made.append(key) or (len(key),), 3)
    for key in ("a", "b", "c", "d", "a", "e", "f", "a", "g"):
        assert memory[key] == (1,)
    assert made.count("a") == 1 and len(memory) <= 3
