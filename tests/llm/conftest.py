import random

import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, key string, uid int, lines string, token string, sig string, target string, kind string"


def documents(spark, rows):
    """Documents (doc_id, text, lang, source) with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "s", "k", 1, "l", "t", "g", "x", "y") for r in rows], SCHEMA)


WORDS = "the house and tree of water light stone road river glass paper cloud garden window summer winter bread salt iron".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(".,") if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, letters beyond ASCII."""
    rng = random.Random(1)
    long = prose(rng, 30_000)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, "a"), (4, long, "en", None), (5, long, "en", "b"), (5, long, "en", "b"), (None, "Hello world", "en", "b"), (None, None, None, None),
        (6, "one", "de", "b"), (7, "One", "de", "b"), (8, "日本語 テスト 😀 ß İ ſ", "ja", "c"), (9, "x" * 30_000, "en", "c"), (10, "9" * 20_000, "en", "c"), (11, "\x00\x1c\u0085 a b", "en", "c"),
        (12, "12 345", None, "c"), (13, "<|endoftext|> a <|startoftext|>", "en", "c"), *[(20 + i, prose(rng, 80), ("en", "de")[i % 2], f"s{i % 3}") for i in range(30)],
    ]
    return documents(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def vectors(spark, rows):
    return spark.createDataFrame(rows, T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.FloatType())).add("rank", "integer").add("list", "string"))
