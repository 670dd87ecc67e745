import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string, shard int, language string, size string, h string, id string, words string"


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeéüñ") for _ in range(r.randint(1, 6)))
    body = " ".join(word() for _ in range(90))
    out = [None, "", " \n\t", "...", "one", "two words", "Ä É", body, body, body + " x", body.upper(), "a " * 4000, "日本語 текст ελληνικά", "<|endoftext|> end", "\u2028\u00a0 nbsp"]
    out += [" ".join(word() for _ in range(r.randint(3, 60))) for _ in range(40)]
    out.append(" ".join(word() for _ in range(30_000)))
    return out


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns of clashing names."""
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "a", "b", "c"][i % 4], len(t or ""), "x", 1, "l", "s", "h", "i", "w") for i, t in enumerate(texts())]
    rows += [rows[7], rows[7], (None, "null id", None, None, None, *[None] * 7), (None, None, None, None, None, *[None] * 7), (5, "other text of an id that repeats", "en", "a", 3, *[None] * 7)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
