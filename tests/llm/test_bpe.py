import base64
import random

import pytest
import tiktoken

from cinelode.llm import bpe

TEXTS = ["", None, " ", "Hello world", "don't  stop\n\n now", "a" * 3000, "ab" * 1500, "のぞみ字幕ムシリコ", "🫠🫠 é ﷺ", "<|endoftext|> x", "1234567890 99.5%", "\t\r\n  ", "é" * 700, "xyzzyqwkjz" * 200, "\ud800 lone"]


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks().splitlines())}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_public_library(public):
    rng = random.Random(1)
    words = "the of lantern dubbing 字幕 Снег 12 , . ! don't we've \n".split(" ")
    texts = [t for t in TEXTS if t != "\ud800 lone"] + [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(200)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x400, 0x460), rng.randrange(0x3040, 0x30FF)])) for _ in range(40)) for _ in range(200)]
    assert bpe.encode_strings(texts) == [public.encode_ordinary(t or "") for t in texts]


def test_round_trip_of_a_surrogate_does_not_crash():
    assert bpe.encode_strings(["\ud800 lone"])[0]


def test_rounds_equal_the_heap(public):
    v = bpe.vocabulary(bpe.read_ranks())
    for w in (b"lanternlantern" * 30, "の".encode() * 200, b"aaaa", b"z"):
        flat, ends = v.rounds([w])
        assert flat.tolist() == v.one_long(w).tolist()
        assert ends.tolist() == [len(flat)]


def test_table(spark, public):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS[:-1])], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode(df, "doc_id").collect()}
    assert got == {i: public.encode_ordinary(t or "") for i, t in enumerate(TEXTS[:-1])}
    assert bpe.encode(df.filter("doc_id < 0"), "doc_id").count() == 0


def test_rounds_and_heap_agree_on_both_sides_of_the_bound():
    rng = random.Random(3)
    v = bpe.vocabulary(bpe.read_ranks())
    for n in (1, 2, 900, bpe.LONG_WORD - 1, bpe.LONG_WORD, bpe.LONG_WORD + 1, 3000):
        for letters in ("ab", "aaaaab", "etaoinshrdlu"):
            word = "".join(rng.choices(letters, k=n)).encode()
            flat, ends = v.rounds([word])
            assert ends.tolist() == [len(flat)] and flat.tolist() == v.one_long(word).tolist()
