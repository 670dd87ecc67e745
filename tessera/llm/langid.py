"""Language identification as multilingual mixture inference.

Features are overlapping 4-grams of the text's bytes, A-Z lower-cased and ASCII other than letters taken as a
space, hashed into ``BUCKETS`` cells. Training counts them by language over every labelled row.

A document's language proportions are estimated by expectation maximisation: a 4-gram belongs to a
language in proportion to the language's share of the document times its likelihood there. The set of languages
is then chosen by penalised likelihood: the languages of largest shares are added one by one and the
set of least ``k * penalty * log(n) - 2 * log likelihood / 4`` is kept (overlapping 4-grams count each byte four times). Their number has
no limit: adding ends where not even the likelihood of all languages would pay for one more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import utf8

BUCKETS = 1 << 16
#: More languages than this would make the model, which each executor holds, larger than 256 MB.
MAX_LANGUAGES = 512
_CLASS = np.array([b - 64 if 65 <= b <= 90 else b - 96 if 97 <= b <= 122 else 0 if b < 128 else 32 + (b & 31) for b in range(256)], np.uint32)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: Likelihoods, (BUCKETS, languages)
    likelihood: np.ndarray


def grams(data: bytes) -> np.ndarray:
    """The hashed 4-grams of a text with a space before and after it; runs of blanks count as one, but any letter gives a gram."""
    c = _CLASS[np.frombuffer(b" " + data + b"  ", np.uint8)]
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    if len(c) < 4:
        if not c.any():
            return np.zeros(0, np.uint16)
        c = np.concatenate((c, np.zeros(4 - len(c), np.uint32)))
    code = (c[:-3] << 18) | (c[1:-2] << 12) | (c[2:-1] << 6) | c[3:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def has_letter(data: bytes) -> bool:
    return bool(_ASCII_LETTER.search(data)) or any(map(str.isalpha, data.decode("utf-8", "replace")))


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.05) -> Model:
    """Counts over every row with a text and a language; the driver gets at most BUCKETS counts for each language."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if name not in totals:
                    totals[name] = np.zeros(BUCKETS, np.int64)
                totals[name] += np.bincount(grams(data), minlength=BUCKETS)
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["lang", "gram", "n"])

    names = sorted(r.lang for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.full((BUCKETS, len(names)), smoothing)
    for r in rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.gram, names.index(r.lang)] += r.n
    return Model(tuple(names), counts / counts.sum(axis=0) if names else counts)


def proportions(likelihood: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int = 12, tolerance: float = 1e-3) -> np.ndarray:
    """The EM estimate of the shares, for grams of the given likelihoods and counts."""
    share, total = start, n.sum()
    for _ in range(rounds):
        new = share * (likelihood.T @ (n / (likelihood @ share))) / total
        settled = np.abs(new - share).max() < tolerance
        share = new
        if settled:
            break
    return share


def infer(model: Model, data: bytes | None, penalty: float = 2.0) -> tuple[str, float, list[str], list[float]]:
    """(language of largest share, its share, the chosen languages, their shares); und without a letter or a model."""
    und = ("und", 0.0, [], [])
    if not data or not model.languages or not has_letter(data):
        return und
    cells, n = np.unique(grams(data), return_counts=True)
    like, total = model.likelihood[cells], n.sum()
    single = n @ np.log(like)
    if like.shape[1] == 1:
        return model.languages[0], 1.0, [model.languages[0]], [1.0]
    # posterior under one language each, as the start: EM then needs few rounds
    start = np.exp((single - single.max()) / max(total / 20, 4))
    share = proportions(like, n, (start + 0.01) / (start + 0.01).sum())
    order = np.argsort(-share, kind="stable")
    best_one = int(np.argmax(single))
    chosen, shares, least = [best_one], np.array([1.0]), penalty * np.log(total) - single[best_one] / 2
    # no set's log likelihood exceeds this: the unrestricted estimate's and the most that any step from it can add
    mixed = like @ share
    bound = n @ np.log(mixed) + total * np.log(max(1.0, (like.T @ (n / mixed)).max() / total))
    for k in range(2, len(order) + 1):
        if k * penalty * np.log(total) - bound / 2 >= least:
            break
        own = order[:k]
        part = proportions(like[:, own], n, share[own] / share[own].sum())
        cost = k * penalty * np.log(total) - n @ np.log(like[:, own] @ part) / 2
        if cost < least:
            chosen, shares, least = own.tolist(), part, cost
    # the largest share of the whole text; equal shares by the order of names
    top = min(range(len(chosen)), key=lambda i: (-shares[i], model.languages[chosen[i]]))
    # the unrestricted estimate says how sure a single language is
    score = float(shares[top]) if len(chosen) > 1 else float(share[chosen[0]])
    return model.languages[chosen[top]], min(1.0, max(0.0, score)), [model.languages[i] for i in chosen], [float(x) for x in shares]


def identify(docs: DataFrame, model: Model, text: str = "text", penalty: float = 2.0, to: str = "language") -> DataFrame:
    """``docs`` with the struct ``to``: lang, score, languages, shares. Only the text is read.

    Null texts, texts without a letter and every text of a model without languages give ``und``, score 0 and no languages; any other text,
    however short, gets a language of the model. Texts are read whole whatever their length. Equal shares go to the name that sorts
    first; repeated rows give the same. A column named ``to`` is replaced, all others pass through.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.likelihood))

    @F.arrow_udf("struct<lang:string,score:double,languages:array<string>,shares:array<double>>")
    def udf(texts: pa.Array) -> pa.Array:
        own = Model(*held.value)
        found = [infer(own, x, penalty) for x in utf8(texts)]
        return pa.StructArray.from_arrays(
            [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.list_(pa.string())), pa.array([x[3] for x in found], pa.list_(pa.float64()))],
            names=["lang", "score", "languages", "shares"],
        )

    return docs.withColumn(to, udf(F.col(text)))


def keep_identified(docs: DataFrame, least: float = 1 / 3, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that have a language with at least the share ``least``, with all of their columns.

    The model is fitted on the rows that ``held_out`` does not hold out. Null texts and texts without a letter go.
    """
    model = fit(docs.where(~F.coalesce(held_out(F.col(id_col)), F.lit(True))), text, lang)
    name = next(x for x in (f"_language{i}" for i in range(len(docs.columns) + 1)) if x not in docs.columns)
    return identify(docs, model, text, to=name).where((F.col(f"{name}.lang") != "und") & (F.col(f"{name}.score") >= least)).select(*docs.columns)
