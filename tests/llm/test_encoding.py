import random

import pytest
from tokenizers import Tokenizer

from coursegrain.llm import encoding
from coursegrain.llm.encoding import decoded, default_vocabulary, encoded, transducer

TEXTS = [None, "", " ", "Hello world", "<|endoftext|> x", "it's 12,5 °C\r\n\r\n  ok  ", "日本語の文書。😀", "a" * 9000, " " * 5000 + "x", "\x00\x1c\x85​", "ñandú́"]


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_rows_and_round_trip(spark, public):
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(TEXTS)] + [(3, "Hello world", 5)], "doc_id long, text string, ids int")
    got = encoded(df, "doc_id", "text")
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == sorted([(k, public(t or "")) for k, t in enumerate(TEXTS)] + [(3, public("Hello world"))])
    assert {r.doc_id: r.text for r in decoded(got, "doc_id", "ids").collect()} == {k: t or "" for k, t in enumerate(TEXTS)}
    assert encoded(df.limit(0), "doc_id", "text").count() == 0


def test_stable_tokens_are_final(public):
    t, r = transducer(default_vocabulary()), random.Random(7)
    for alphabet in ("abcdeinorst", "ab", "=-_", "éß中"):
        for _ in range(8):
            s = "".join(r.choice(alphabet) for _ in range(r.randint(1500, 6000)))
            data, blocks, k = s.encode(), [], 0
            while k < len(data):
                step = r.randint(1, 900)
                blocks.append(data[k : k + step])
                k += step
            assert list(t.stream(blocks)) == t._merged(data)
            assert list(t.encode(s)) == public(s)


def test_random_characters(public):
    t, r = transducer(default_vocabulary()), random.Random(3)
    for _ in range(500):
        s = "".join(chr(r.choice([r.randint(0, 0x2FF), r.randint(0, 0xD7FF), 32, 10, 0xA0, r.randint(97, 122), 0x1F600])) for _ in range(r.randint(0, 40)))
        assert list(t.encode(s)) == public(s) and t.decode(t.encode(s)) == s


def test_words_do_not_depend_on_the_blocks():
    r = random.Random(11)
    alphabets = ["ab'sllt ", " \n\t ", "a1 ", "=-' ", "é中 '9\n", "a", " ", "=", "7"]
    for k in range(600):
        s = "".join(r.choice(r.choice(alphabets)) * r.choice((1, 1, 1, 2, 9, 70)) for _ in range(r.randint(0, 60)))
        step, words, part = r.randint(1, 40), [], ""
        old, encoding.BLOCK = encoding.BLOCK, step
        try:
            for text, ends in encoding.split_words(s[j : j + step] for j in range(0, len(s), step)):
                part += text
                if ends:
                    words, part = words + [part], ""
        finally:
            encoding.BLOCK = old
        assert part == "" and words == encoding.SPLIT.findall(s), (s, step)


def test_memory_is_a_block_and_a_lookahead():
    t = transducer(default_vocabulary())
    read = given = 0

    def blocks():
        nonlocal read
        for _ in range(200):
            read += encoding.BLOCK
            yield "ab" * (encoding.BLOCK // 2)

    for ids in t.words(encoding.split_words(blocks())):
        given += sum(len(t.bytes_of[i]) for i in ids)
        assert read - given <= 4 * encoding.BLOCK
    assert given == read
