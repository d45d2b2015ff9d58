"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) the vectors of its letters, the
first permuted twice and the second once; a text's vector bundles (adds) those of its trigrams, a language's that of
all its training texts. A text gets the language whose vector has the largest cosine with its own.

Edge cases: null, empty and letterless texts are ``und`` with score 0; ties go to the first language in alphabetical
order; without training rows all texts are ``und``; rows with a null language are predicted but not learned from;
repeated rows are separate rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesto.llm.wordhash import mix

DIMENSIONS = 1024
#: Texts whose vectors are made by one matrix product.
TEXTS = 96
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each code point, the same everywhere."""
    words = mix(letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(DIMENSIONS // 64, dtype=np.uint64)[None, :])
    return np.unpackbits(words.astype("<u8").view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of the lower-cased letters, anything else as one space, and their counts; empty without letters."""
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if not isinstance(text, str) or not text:
        return none
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter = _is_letter()[points]
    if not letter.any():
        return none
    points = np.where(letter, points, 32)
    points = points[letter | np.concatenate(([True], letter[:-1]))]
    points = np.concatenate(([32], points, [32]))[int(points[0] == 32) : len(points) + 2 - int(points[-1] == 32)]
    return np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:], return_counts=True)


def bundle(profiles: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The vectors of texts given as trigram counts."""
    codes, column = np.unique(np.concatenate([c for c, _ in profiles]), return_inverse=True)
    counts = np.zeros((len(profiles), len(codes)), dtype=np.float32)
    counts[np.repeat(np.arange(len(profiles)), [len(c) for c, _ in profiles]), column] = np.concatenate([n for _, n in profiles])
    mask = (1 << 21) - 1
    letters, where = np.unique(np.concatenate([codes >> 42, (codes >> 21) & mask, codes & mask]), return_inverse=True)
    table, n = letter_vectors(letters), len(codes)
    out = np.zeros((len(profiles), DIMENSIONS), dtype=np.float32)
    first, second = np.roll(table, 2, axis=1), np.roll(table, 1, axis=1)
    for low in range(0, n, 8192):
        part = slice(low, min(n, low + 8192))
        bound = first[where[part]] * second[where[n:][part]] * table[where[2 * n :][part]]
        out += counts[:, part] @ bound.astype(np.float32)
    return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def learn(texts: DataFrame) -> dict[str, np.ndarray]:
    """Language vectors from (text, lang): each task bundles what it reads, Spark adds the parts.

    What comes to the driver is one vector a language.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list] = defaultdict(list)
        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"], strict=True):
                found = trigrams(text)
                if len(found[0]):
                    counts[lang].append(found)
                    if len(counts[lang]) >= 256:
                        counts[lang] = [_merge(counts[lang])]
        for lang, parts in counts.items():
            codes, n = _merge(parts)
            yield pd.DataFrame({"lang": lang, "dim": np.arange(DIMENSIONS, dtype=np.int32), "value": bundle([(codes, n)])[0].astype(np.float64)})

    parts = texts.filter("lang is not null").select("text", "lang").mapInPandas(run, "lang string, dim int, value double")
    whole = parts.groupBy("lang", "dim").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("v"))
    return {r["lang"]: np.array([x["value"] for x in r["v"]]) for r in whole.collect()}


def predictor(languages: dict[str, np.ndarray]):
    """A column function from texts to (lang_pred, score); the score is the cosine, negative ones as 0."""
    names = sorted(languages)
    table = np.array([languages[x] / max(np.linalg.norm(languages[x]), 1e-12) for x in names], dtype=np.float32).reshape(len(names), DIMENSIONS)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        for low in range(0, len(texts), TEXTS):
            found = [(i, p) for i, p in enumerate(map(trigrams, texts.iloc[low : low + TEXTS]), low) if len(p[0])]
            if found and names:
                vectors = bundle([p for _, p in found])
                cosines = vectors @ table.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
                rows = [i for i, _ in found]
                best[rows] = cosines.argmax(axis=1)
                score[rows] = np.clip(cosines.max(axis=1), 0, 1)
        return pd.DataFrame({"lang_pred": [names[i] if i >= 0 else UNKNOWN for i in best], "score": score})

    return predict


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not ``held_out`` and predicts all: doc_id, held_out, lang_pred, score."""
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    found = predictor(learn(rows.filter("not held_out")))
    return rows.select("doc_id", "held_out", found("text").alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
