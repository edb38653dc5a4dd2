import hashlib
import random

import pytest

from siltstone.llm import bpe, token_counts
from siltstone.llm.tokens import public_path, tokenizer

WORD, BYTE = public_path("word_bpe_49k.json"), public_path("byte_bpe_50k.json")
TEXTS = [
    None,
    "",
    "  ",
    "Hello  world\n\n  it's   fine\t\tend ",
    "a  b  \n c \n d",
    "x<|endoftext|> y <|endoftext|>\n<|startoftext|>",
    "é́ naıİve ΣΣ ẞ \U0001f600‍\U0001f680 \x1c\x1d z",
    "'re!!!'s don't",
    "12345 3.14 ٣٤",
    "tail \n \n",
]


def long_texts():
    draw = random.Random(5)
    letters = "".join(draw.choice("abcdefghinorst") for _ in range(3000))
    return [letters, "é" * 1000, "!'s?" * 300, "ab " * 10 + letters[:900] + " end", "".join(draw.choice("ab1.é'中") for _ in range(2000))]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as ids", "0 as digest", "1 as row")


@pytest.mark.parametrize(("leaf", "long", "once"), [(512, 1 << 20, False), (300, 400, True), (bpe.LEAF, bpe.LONG, True)])
def test_encode_and_decode_are_the_librarys(spark, leaf, long, once):
    draw = random.Random(6)
    spelt = " ".join("".join(draw.choice("abé.1'") for _ in range(draw.randrange(1, 30))) for _ in range(9_000))
    texts = TEXTS + long_texts() + [spelt, spelt.replace(" ", "")]
    assert len(spelt) > bpe.LONG
    own = tokenizer(WORD)
    out = bpe.encode(rows(spark, texts), WORD, leaf, long, decoded=once)
    out = (out if once else bpe.decode(out, WORD)).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == own.decode(ids, skip_special_tokens=False)


def test_tree_takes_byte_level_tokens_too():
    own = tokenizer(BYTE)
    for text in long_texts():
        level = [(a, b, bpe._tokens(own, text[a:b], a)) for a, b in bpe.halves(len(text), 50)]
        while len(level) > 1:
            level = [(a, d, bpe.joined(own, text, x, y, b, a, d)) for (a, b, x), (_, d, y) in zip(level[::2], level[1::2], strict=True)]
        assert [i for _, _, i in level[0][2]] == own.encode(text, add_special_tokens=False).ids


def test_joins_are_exact_wherever_they_fall():
    draw = random.Random(8)
    for path, kinds in ((WORD, ["abcdeé", "aé\u0301 ", "ab.,' ", "12 ab", "<|endoftx>", "'strevm", "中文字 "]), (BYTE, ["abcdeé", "ab.,'", "aé\u0301"])):
        own = tokenizer(path)
        for kind in kinds:
            text = "".join(draw.choice(kind) for _ in range(600)) + "<|endoftext|>" * (path == WORD) + "".join(draw.choice(kind) for _ in range(600))
            whole = own.encode(text, add_special_tokens=False).ids
            for cut in (1, 599, 601, 606, 612, draw.randrange(1, len(text)), len(text) - 1):
                both = bpe.joined(own, text, bpe._tokens(own, text[:cut]), bpe._tokens(own, text[cut:], cut), cut, 0, len(text))
                assert [i for _, _, i in both] == whole, (kind, cut)


def test_counts_are_the_librarys_and_misses_are_encoded_once(spark, tmp_path):
    texts = TEXTS + TEXTS + long_texts()
    own, cache = tokenizer(BYTE), str(tmp_path / "cache")
    want = [(i, len((t or "").encode()), (n := len(own.encode(t or "", add_special_tokens=False).ids)), n > 9) for i, t in enumerate(texts)]
    for _ in range(2):  # the second run finds all in the cache
        out = token_counts.token_counts(rows(spark, texts), BYTE, cache, limit=9)
        assert sorted(tuple(r) for r in out.collect()) == want
        stored = spark.read.parquet(cache)
        assert stored.count() == len({hashlib.sha256((t or "").encode()).digest() for t in texts})
    assert token_counts.token_counts(rows(spark, TEXTS), WORD, cache, spaced=False).where("n_tokens > 0").count() == 7


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, WORD), WORD).collect() == []
    assert token_counts.token_counts(empty, BYTE).collect() == []
