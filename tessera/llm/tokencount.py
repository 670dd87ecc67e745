"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text up to ``chunk`` characters is encoded as a whole. A longer one is encoded in overlapping chunks with
offsets. The chunk before is right up to any of its pre-token boundaries that lies at least ``MARGIN``
characters before its end: what the pre-tokenizer matches there depends on nothing later (its look-ahead is
one character, and the longest special string fits into the margin). The pre-tokenizer and the search for special strings
go from left to right and keep no state, so where the next chunk has a boundary at the same place,
its tokens from there on are the text's own. The last such common boundary is the splice.

Chunks lie on a grid first, and only the boundaries of their overlaps are looked at. Where an overlap holds no splice (a run
of letters without a break, say) the text is spliced step by step instead: there the overlap is widened until it holds one, and
the chunk with it when it must be. Every token is the library's; shorter texts go to it in batches.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import utf8

CHUNK, OVERLAP, MARGIN = 1 << 15, 1 << 8, 64
#: Texts, or chunks of one text, that the library gets at a time.
BATCH, CHUNKS = 64, 16
Token = tuple[int, int, bool]


def spliced_count(text: str, encode: Callable[[str], list[tuple[int, bool]]], chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """The number of tokens of ``text``. ``encode`` gives each token's start and whether a pre-token starts there."""
    n, total, done, base, size = len(text), 0, 0, 0, chunk
    now = encode(text[:size])
    while base + size < n:
        end, wide = base + size, overlap
        while True:
            at = end - wide
            if at <= max(base, done):  # the whole chunk holds no splice: take a longer one instead
                size *= 2
                now = encode(text[base : base + size])
                at = None
                break
            # never shorter than what it must reach beyond
            after_size = max(chunk, 2 * wide)
            after = encode(text[at : at + after_size])
            mine = {base + s for s, first in now if first}
            common = [at + s for s, first in after if first and s and at + s <= end - margin and at + s > done and at + s in mine]
            if common:
                break
            wide *= 2
        if at is None:
            continue
        cut = common[-1]
        total += sum(done <= base + s < cut for s, _ in now)
        done, base, size, now = cut, at, after_size, after
    return total + sum(base + s >= done for s, _ in now)


def _kept() -> dict:
    """What a Python worker keeps between its tasks."""
    return sys.modules.setdefault("_tessera_kept", types.ModuleType("_tessera_kept")).__dict__


def _library(path: str):
    kept = _kept()
    if path not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        kept[path] = Tokenizer.from_file(path)
    return kept[path]


def library_encode(path: str) -> Callable[[str], list[tuple[int, bool]]]:
    """Tokens as ``spliced_count`` wants them."""

    def encode(text: str) -> list[tuple[int, bool]]:
        e = _library(path).encode(text, add_special_tokens=False)
        before, out = object(), []
        for (start, _), word in zip(e.offsets, e.word_ids, strict=True):
            out.append((start, word is None or word != before))
            before = word
        return out

    return encode


def _opens(encoding, token: int) -> bool:
    """Whether a pre-token or a special string starts with the token, which is not the first."""
    word = encoding.token_to_word(token)
    return word is None or word != encoding.token_to_word(token - 1)


def _splice(a, a_start: int, b, b_start: int, end: int) -> tuple[int, int] | None:
    """The tokens of both encodings at their last common boundary up to ``end``; None without one."""
    for p in range(end, b_start, -1):
        i, j = a.char_to_token(p - a_start), b.char_to_token(p - b_start)
        if i and j and a.token_to_chars(i)[0] == p - a_start and b.token_to_chars(j)[0] == p - b_start and _opens(a, i) and _opens(b, j):
            return i, j
    return None


def grid_count(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int | None:
    """The number of tokens from chunks on a grid; None if one of the overlaps holds no splice."""
    starts = range(0, max(1, len(text) - overlap), chunk - overlap)
    total, first, before, at = 0, 0, None, 0
    for i in range(0, len(starts), CHUNKS):
        own = starts[i : i + CHUNKS]
        for start, now in zip(own, _library(path).encode_batch([text[s : s + chunk] for s in own], add_special_tokens=False), strict=True):
            if before is not None:
                cut = _splice(before, at, now, start, at + chunk - margin)
                if cut is None or cut[0] < first:
                    return None
                total, first = total + cut[0] - first, cut[1]
            before, at = now, start
    return total + len(before) - first


def count_long(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of a text of more than ``chunk`` characters."""
    n = grid_count(text, path, chunk, overlap) if overlap > MARGIN and chunk > 2 * overlap else None
    return spliced_count(text, library_encode(path), chunk, overlap) if n is None else n


def count_all(texts: list[str], path: str, chunk: int = CHUNK) -> list[int]:
    """Each text's number of tokens; equal texts are encoded once."""
    known = {x: 0 if not x else count_long(x, path, chunk) if len(x) > chunk else -1 for x in dict.fromkeys(texts)}
    short = [x for x, n in known.items() if n < 0]
    for begin in range(0, len(short), BATCH):
        some = short[begin : begin + BATCH]
        known.update(zip(some, map(len, _library(path).encode_batch_fast(some, add_special_tokens=False)), strict=True))
    return [known[x] for x in texts]


def count_tokens(docs: DataFrame, vocabulary: str, chunk: int = CHUNK, text: str = "text", to: str = "n_tokens") -> DataFrame:
    """``docs`` with the long ``to``: tokens without begin, end or padding; special strings count as the library reads them.

    ``vocabulary`` is the library's file, which must be at this path on every executor. Null and empty texts have 0 tokens; memory for a text beyond
    ``chunk`` characters is that of a few chunks, unless it has no pre-token boundary. Equal texts have equal counts and repeated
    rows each keep theirs. A column named ``to`` is replaced, all others pass through. An empty table stays empty.
    """

    @F.arrow_udf("long")
    def udf(texts: pa.Array) -> pa.Array:
        return pa.array(count_all([(x or b"").decode("utf-8", "replace") for x in utf8(texts)], vocabulary, chunk), pa.int64())

    return docs.withColumn(to, udf(F.col(text)))
