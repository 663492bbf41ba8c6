import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, slot string, secrets string"
LONG = " ".join(f"wort{k % 977} und{k % 13}" for k in range(30_000))


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns whose names clash."""
    texts = ["the cat sat on the mat and looked at the moon", "", None, "a", LONG, "token = abcdefgh1234 and more", "  \n\t "]
    out = [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, len(t or ""), 1, "x", "y") for k, t in enumerate(texts)]
    out += [out[0], out[0], (None, texts[0], "en", None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return out + [(90 + k, texts[0], "en", "s1", 45, 1, "x", "y") for k in range(3)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), DOCS).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
