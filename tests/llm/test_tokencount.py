import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import tokencount as t

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["the", " ", "  ", "\n", "\r\n", "a", "é", "<|endoftext|>", "<|endof", "text|>", "123", "!!!", "'s", "'", "ü", ".", "\u3000", "中文", "word word ", "x" * 70, "😀", "    \n", " \n\n  ", "\u00a0", "ﬁ", "\u0301"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(8))
def test_splices_agree(library, seed):
    r, encode = random.Random(seed), t.library_encode(PATH)
    for _ in range(40):
        text = "".join(r.choice(PIECES) for _ in range(r.randint(20, 600)))
        assert t.spliced_count(text, encode, chunk=r.choice([150, 300, 500]), overlap=r.choice([4, 20, 60])) == count(library, text)


def test_runs_without_a_boundary(library):
    encode = t.library_encode(PATH)
    for text in ("a" * 3000, " " * 3000 + "b", "ab" * 700 + " " + "c" * 1200, "é" * 1500, "<|endoftext|>" * 200, "\n" * 2000):
        assert t.spliced_count(text, encode, chunk=200, overlap=16) == count(library, text)


@pytest.mark.parametrize("chunk", [t.CHUNK, 1000, 150])
def test_tables(edge, empty, docs, library, chunk):
    for df in (edge, docs):
        rows = t.count_tokens(df, PATH, chunk=chunk).select("text", "n_tokens").collect()
        assert [r.n_tokens for r in rows] == [count(library, r.text or "") for r in rows]
    assert t.count_tokens(empty, PATH).count() == 0


def test_the_splice_carries_texts_of_the_table(docs, library):
    long = [r.text for r in docs.collect() if r.text and len(r.text) > 8192]
    long.append(" ".join(long) * 3)
    want = [count(library, x) for x in long]
    assert len(long[-1]) > t.CHUNK and t.count_all(long, PATH) == want
    assert [t.grid_count(x, PATH, 8192) for x in long] == want and [t.spliced_count(x, t.library_encode(PATH), 8192) for x in long] == want


def test_column_of_the_same_name_is_replaced(edge, library):
    rows = t.count_tokens(edge, PATH, to="size").select("text", "size", "words").collect()
    assert [r["size"] for r in rows] == [count(library, r.text or "") for r in rows] and {r.words for r in rows} == {"w", None}


@pytest.mark.parametrize("seed", range(6))
def test_grids_agree(library, seed):
    r, met = random.Random(100 + seed), 0
    for _ in range(40):
        text = "".join(r.choice(PIECES) for _ in range(r.randint(20, 900)))
        chunk, overlap = r.choice([(400, 100), (700, 150), (1000, 300)])
        n, want = t.grid_count(text, PATH, chunk, overlap), count(library, text)
        met += n is not None
        assert n in (None, want) and t.count_long(text, PATH, chunk, overlap) == want
    assert met > 20
