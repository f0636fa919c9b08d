import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, a very long one, ties, control strings, many scripts."""
    rnd = random.Random(7)
    signs = [" ", " ", "\n", "a", "B", "'s", "'", "1", "é", " ", ".", "<|endoftext|>", "́", "日", "\t",
             "\x00", "\x85", "ſ", "µ", "²", "×", "Ж", "#", "12", "İ", "ﬁ"]
    mixed = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(150)]
    prose = [" ".join(rnd.choice(["alpha", "beta", "Gamma,", "delta.", "it's"]) for _ in range(40)) for _ in range(20)]
    fixed = [None, "", " ", "\n\n", "x", "X", "a  b", "a b", "a\t\nb", "日本 語", "word " * 60_000, "y" * 5_000]
    return fixed + mixed + prose + prose[:3]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_texts):
    """The odd texts as documents over several partitions."""
    rows = [(i * 7 % 1009, t, "en", "s", len(t or "")) for i, t in enumerate(odd_texts)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
