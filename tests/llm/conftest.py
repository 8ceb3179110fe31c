import re

import pytest

PUBLIC = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def vocab():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, base, "a"), (2, base, "a"), (3, base.upper(), "b"), (4, " ".join(f"w{i}" for i in range(61)), None), (4, " ".join(f"w{i}" for i in range(61)), None),
        (5, None, "b"), (6, "", ""), (7, " \t\n", "c"), (8, "one two", "c"), (9, "ONE  two", "c"), (10, "long " * 30_000, "a"), (None, "no id here at all", "a"),
        (11, "naïve café <|endoftext|> 漢字 'll", None), (12, "q", "q"),
    ]
    return spark.createDataFrame([(i, t, s, 0, "x", "y", 1) for i, t, s in rows], "doc_id long, text string, source string, n_chars long, lang string, shard string, size int")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def words():
    return lambda t: PUBLIC.findall(t or "")
