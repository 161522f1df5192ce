"""Language ID with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A trigram's vector binds (multiplies) its
letters' vectors, permuted by their position; a text's vector bundles (adds) the
vectors of its trigrams; a language's prototype bundles its documents.  A text gets
the language of the prototype with the largest cosine.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of a vector.
DIM = 1024
#: Trigrams whose vectors a worker keeps; the table starts anew when it is full.
GRAM_CACHE = 20_000
UND = "und"


class Profiles(NamedTuple):
    """Prototypes, one row a language, of length 1, and the weight of each component's mean."""

    langs: list[str]
    matrix: np.ndarray


def letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([7, code]).integers(0, 2, DIM, dtype=np.int8) * np.int8(2) - np.int8(1)


_letters: dict[int, np.ndarray] = {}
_places: dict[int, int] = {}


@cache
def _known() -> np.ndarray:
    """Vectors of the trigrams in _places, one a row."""
    return np.zeros((GRAM_CACHE, DIM), np.int8)


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


def gram_vector(gram: int) -> np.ndarray:
    """Vector of a trigram packed as three 21-bit code points."""
    out = np.ones(DIM, np.int8)
    for place in (2, 1, 0):
        code = gram >> 21 * place & 0x1FFFFF
        v = _letters.get(code)
        if v is None:
            if len(_letters) > 10_000:
                _letters.clear()
            v = _letters[code] = letter_vector(code)
        out = out * np.roll(v, place)
    return out


def gram_matrix(grams: list[int]) -> np.ndarray:
    """Vectors of at most GRAM_CACHE trigrams, one a row."""
    if len(_places) + len(grams) > GRAM_CACHE:
        _places.clear()
    rows = []
    for g in grams:
        at = _places.get(g)
        if at is None:
            at = _places[g] = len(_places)
            _known()[at] = gram_vector(g)
        rows.append(at)
    return _known()[rows]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of the lower-cased letters, with other runs as one space, and their counts; empty without letters."""
    codes = np.frombuffer(f" {text.lower() if text else ''} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # Of a run without letters, the place before the next letter stays (the last run: its first place).
    stays = letter.copy()
    stays[:-1] |= letter[1:]
    stays[int(np.flatnonzero(letter)[-1]) + 1] = True
    codes = np.where(letter, codes, 32)[stays].astype(np.int64)
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


def bundle(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(DIM, np.float64)
    for at in range(0, len(grams), 2048):
        out += counts[at : at + 2048].astype(np.float32) @ gram_matrix(grams[at : at + 2048].tolist()).astype(np.float32)
    return out


def _partial_prototypes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, dict[int, int]] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = total.setdefault(lang, {})
            for g, n in zip(*(x.tolist() for x in trigrams(text.as_py())), strict=True):
                own[g] = own.get(g, 0) + n
            if len(own) > 200_000:
                yield _prototype_rows({lang: total.pop(lang)})
    yield _prototype_rows(total)


def _prototype_rows(total: dict[str, dict[int, int]]) -> pa.RecordBatch:
    langs, values = [], []
    for lang, own in total.items():
        v = np.zeros(DIM, np.int64)
        for g, n in own.items():
            v += n * gram_vector(g).astype(np.int64)
        langs += [lang] * DIM
        values.append(v)
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(list(range(DIM)) * len(values), pa.int32()),
         pa.array(np.concatenate(values) if values else np.empty(0, np.int64), pa.int64())], ["lang", "i", "v"])


def fit_profiles(docs: DataFrame, label_col: str = "lang", text_col: str = "text") -> Profiles:
    """Learn the prototypes from all labelled rows of docs.

    Rows without label or letters teach nothing.  What reaches the driver is one vector for each
    label, summed in Spark as integers, so the result doesn't depend on
    partitions; the number of labels is taken to be that of languages.
    """
    rows = (docs.select(F.col(label_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
            .mapInArrow(_partial_prototypes, "lang string, i int, v long")
            .groupBy("lang", "i").agg(F.sum("v").alias("v"))
            .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p")).orderBy("lang").collect())
    kept = [(r["lang"], np.array([x["v"] for x in r["p"]], np.float64)) for r in rows]
    kept = [(lang, v / np.linalg.norm(v)) for lang, v in kept if v.any()]
    return Profiles([lang for lang, _ in kept], np.array([v for _, v in kept]).reshape(-1, DIM))


def predict_language(profiles: Profiles, text: Column) -> Column:
    """struct<lang_pred string, score double>: the language of largest cosine (ties: first in name order) and the cosine,
    cut to 0..1.  A text that is null or has no letter, or no profiles at all: `und`, 0."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for t in texts:
            grams, counts = trigrams(t.as_py())
            if not len(grams) or not profiles.langs:
                langs.append(UND)
                scores.append(0.0)
                continue
            v = bundle(grams, counts)
            cos = profiles.matrix @ v / max(np.linalg.norm(v), 1e-9)
            best = int(cos.argmax())
            langs.append(profiles.langs[best])
            scores.append(float(min(1.0, max(0.0, cos[best]))))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict(text)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True for the fold of rows that training leaves out; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(doc_id, held_out boolean, lang_pred string, score double) for every row of docs.

    Learns from the rows outside the held-out fold and predicts every whole text from the text alone.
    Null and repeated ids are rows like any other; other columns are not read; an
    empty table, or one without labels, gives `und` for all its rows.
    """
    profiles = fit_profiles(docs.where(~held_out(id_col)), label_col, text_col)
    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
                       predict_language(profiles, F.col(text_col)).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
