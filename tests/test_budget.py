import random

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from siltstone.functions import budget

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole(text, most):
    """The cut by encoding the whole text."""
    found = budget._tokenizer(PATH).encode(text, add_special_tokens=False)
    return text if len(found.ids) <= most else text[: found.offsets[most][0]]


@pytest.mark.parametrize("most", [1, 7, 64])
def test_a_cut_of_the_beginning_is_that_of_the_whole(most):
    draw = random.Random(most)
    parts = ["word ", "机器学习与图像", "  \n\n", "don't", "🙂é", "x" * 300, "12345", " ", "\t", ".", "。"]
    for _ in range(150):
        text = "".join(draw.choices(parts, k=draw.randrange(120)))
        assert budget.cut(text, most, PATH) == whole(text, most)
    long = "研究方向 image segmentation; " * 20_000
    assert budget.cut(long, most, PATH) == whole(long, most) and len(budget.cut("啊" * 10_000, most, PATH)) <= most


def test_columns(spark):
    df = spark.createDataFrame([("机器学习与计算机视觉研究" * 40,), (None,), ("",)], "t string")
    got = df.select("t", budget.within_tokens(F.col("t"), 16, PATH).alias("c"), budget.tokens(F.col("t"), PATH).alias("n")).collect()
    assert got[0].c == whole(got[0].t, 16) and 0 < len(got[0].c) < len(got[0].t) and got[0].n > 16
    assert (got[1].c, got[1].n, got[2].c, got[2].n) == (None, 0, "", 0)
    assert len(budget.version(PATH)) == 64 and budget.version(PATH) != budget.version(public_tokenizers.path("word_bpe_49k.json"))
