import random

import pytest

LONG = "".join(random.Random(5).choice("abcdefghijklmnop") for _ in range(70_000))


def passage(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 7))) for _ in range(n))


def edge_rows():
    """doc_id, text, and columns whose names clash with what operators use inside. Nulls, empty and very long texts,
    ties, repeated rows, odd white space, special tokens, characters outside the BMP."""
    p = passage(1, 60)
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "two words"), (6, "three words here"), (7, LONG), (8, p), (9, passage(2, 40) + " " + p + " " + passage(3, 40)),
        (10, p.replace(" ", "\n")), (11, p.upper()), (12, p), (12, p), (13, p + " extra"), (14, "x " * 5000), (15, "a b c\u0085d \x0b e\x1cf"),
        (16, "<|endoftext|> text <|endoftext|>"), (17, "😀😀 naïve Ünïcode \U0001d400 中文字符 test"), (18, "tab\there  double  space\r\nline"), (19, "1234567890 " * 50), (None, "no id"), (None, p), (20, "ends with space "), (21, passage(4, 3000)),
        (22, "it's we'll I'M don't 'll"), (23, "  leading"), (24, "!!!!????----====" * 300), (25, "zero\x00byte"), (26, "lone </s> <unk> <s> [PAD] text"),
    ]
    return [(i, t, "en", "src", None, "c", 7, 1.0) for i, t in texts]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, runs int, n double"


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
