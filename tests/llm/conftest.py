import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, kept string, component_id string, score string, ids string, lane long"


def prose(seed, n):
    """Distinct words in sentences, so that documents share next to nothing."""
    words = [f"w{seed}x{i * 7919 % 9973}" for i in range(n)]
    return " ".join(("The " if i % 9 == 0 else "of the " if i % 4 == 0 else "") + w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    base = prose(1, 120)
    texts = [
        (1, base), (2, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"),
        (9, prose(2, 30_000)), (None, prose(3, 60)), (10, "x" * 20_000), (11, "Spam!! " * 80), (12, prose(4, 60) + "\nCommon line here."),
        (13, "naïve café — 漢字 <|endoftext|> 😀 don't"), (14, "a" * 3000 + " b"),
    ]
    rows = [(i, t, None if k % 3 else "en", None if k % 5 == 0 else f"s{k % 2}", None, "clash", "clash", None, "x", "y", k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
