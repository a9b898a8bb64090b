import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words string, spans int"


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def edge_rows() -> list[tuple]:
    """Nulls, empty and blank texts, repeated rows, one id twice, long and odd texts, ties, near and exact copies."""
    rng = random.Random(3)
    base = words(rng, 120)
    near = base[:60] + ["changed"] + base[61:]
    passage = words(rng, 60, 9999)
    long = words(rng, 6000, 50)
    texts = [
        None, "", "   \n\t ", "one", "one", "One Two", "a\n\na", " ".join(base), " ".join(base), " ".join(near), " ".join(long), "é" * 500,
        "The Shared Line is long enough\nx", "  the shared line is LONG enough\ny", "the shared line is long enough\nz", "the shared line is long enough",
        " ".join(words(rng, 80) + passage + words(rng, 30)), " ".join(words(rng, 20) + passage), "\x1c\x85  mixed   spaces", "<|endoftext|>x<|startoftext|>", "#*$%&|<>" * 30,
        ("same words here " * 30).strip(), "Σίσυφος İ ß ﬁ", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.",
    ]
    rows = [(i, t, "en", "s", len(t or ""), True, "clash", i) for i, t in enumerate(texts)]
    rows += [rows[7], rows[12], (None, "the shared line is long enough", None, None, None, None, None, None), (None, " ".join(base), "en", "s", 1, False, "x", 1)]
    rows += [(3, "another text under a used id with the shared line is long enough", "en", "s", 1, True, "y", 2)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
