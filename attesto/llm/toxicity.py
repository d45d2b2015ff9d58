"""Toxicity by a counterfactually regularised classifier.

A logistic model over the words of a text and their first bytes. Besides the log-loss, training penalises the change
of the score when identity terms in a labelled text are swapped for other terms of their group, so that neutral
mentions of a group do not raise it.

The classifier is fitted on at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of the id; scoring reads all texts
whole. Edge cases: null counts as empty; an empty text gets the score of the bias; without labelled rows of both
classes the score is the share of toxic labels, or 0; a null label is not learned from; repeated rows count as often
as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesto.llm.scratch import bounded_batches, stage
from attesto.llm.wordhash import NOT_ALNUM, batches, hash_words, mix

#: Bound of the labelled sample on which the classifier is fitted.
TRAIN_ROWS = 20_000
#: Bound of the features that the model keeps, those that tell the classes apart best.
FEATURES = 4096
#: Lengths in bytes of the word beginnings that are features besides the words.
HEADS = (4, 5)
#: Groups of identity terms that may stand for one another (fixed values).
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "locals", "natives"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("femmes", "hommes", "chrétiens", "musulmans", "juifs"),
    ("frauen", "männer", "christen", "muslime", "juden"),
    ("mujeres", "hombres", "cristianos", "musulmanes", "judíos"),
)


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def word_features(texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, text number of each feature, feature hashes), a few megabytes of texts at a time."""
    for first, run in batches(x.lower() if isinstance(x, str) else "" for x in texts):
        hashes, begins, heads = hash_words(b" ".join(run), NOT_ALNUM, HEADS)
        number = np.searchsorted(np.cumsum([len(raw) + 1 for raw in run]), begins, side="right")
        yield first, np.tile(number, 1 + len(heads)), np.concatenate([hashes, *heads])


def swapped(text: str | None, groups=IDENTITY_TERMS) -> str | None:
    """The text with each identity term replaced by the next of its group; None if it has none."""
    import re

    follow = {a: b for group in groups for a, b in zip(group, (*group[1:], group[0]), strict=True)}
    if not isinstance(text, str):
        return None
    out, n = re.subn(r"[^\W\d_]+", lambda m: follow.get(m[0].lower(), m[0]), text)
    return out if n and out != text else None


def _counted(labelled: DataFrame) -> DataFrame:
    """(feature, label, n): in how many labelled texts of each class a feature occurs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            labels = frame["toxic"].to_numpy()
            for first, number, codes in word_features(frame["text"]):
                for label in (0, 1):
                    mine = labels[first + number] == label
                    order = np.lexsort((codes[mine], number[mine]))
                    c, d = codes[mine][order], number[mine][order]
                    fresh = np.concatenate(([True], (c[1:] != c[:-1]) | (d[1:] != d[:-1]))) if len(c) else np.zeros(0, bool)
                    values, n = np.unique(c[fresh], return_counts=True)
                    yield pd.DataFrame({"feature": values.view(np.int64), "label": np.int32(label), "n": n.astype(np.int64)})

    return labelled.select("text", "toxic").mapInPandas(run, "feature bigint, label int, n bigint")


def _rows(labelled: DataFrame, features: np.ndarray, groups) -> pd.DataFrame:
    """The chosen features of each labelled text and of its counterfactual (null if there is none)."""

    def columns(texts: list) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in texts]
        for first, number, codes in word_features(texts):
            at = np.minimum(np.searchsorted(features, codes), len(features) - 1)
            hit = features[at] == codes
            for d, f in np.unique(np.stack([number[hit] + first, at[hit]]), axis=1).T.tolist():
                out[d].append(f)
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            other = [swapped(t, groups) for t in frame["text"]]
            there = [i for i, t in enumerate(other) if t is not None]
            twins = dict(zip(there, columns([other[i] for i in there]), strict=True))
            yield pd.DataFrame({"toxic": frame["toxic"], "mine": columns(list(frame["text"])), "twin": [twins.get(i) for i in range(len(frame))]})

    return labelled.select("text", "toxic").mapInPandas(run, "toxic int, mine array<int>, twin array<int>").toPandas()


def _fit(rows: pd.DataFrame, size: int, ridge: float, swap_penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Gradient descent (Adam) on log-loss, ridge and the squared change of the logit under a swap."""

    def sparse(lists) -> tuple[np.ndarray, np.ndarray]:
        lists = [np.asarray(x, dtype=np.int64) for x in lists]
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([*lists, np.zeros(0, np.int64)])

    y = rows["toxic"].to_numpy(dtype=float)
    paired = rows["twin"].notna().to_numpy()
    (r, c), (r0, c0), (r1, c1) = sparse(rows["mine"]), sparse(rows["mine"][paired]), sparse(rows["twin"][paired])
    w, b = np.zeros(size), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    m, v, pairs = np.zeros(size + 1), np.zeros(size + 1), int(paired.sum())
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[c], len(y)) + b, -30, 30)))
        slope = np.append(np.bincount(c, (p - y)[r], size) / len(y) + ridge * w, (p - y).mean())
        if pairs:
            change = np.bincount(r0, w[c0], pairs) - np.bincount(r1, w[c1], pairs)
            slope[:-1] += swap_penalty * 2 / pairs * (np.bincount(c0, change[r0], size) - np.bincount(c1, change[r1], size))
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def learn(labelled: DataFrame, groups=IDENTITY_TERMS, features: int = FEATURES, ridge: float = 1e-4, swap_penalty: float = 1.0, steps: int = 300) -> Model:
    """The model fitted on all of ``labelled`` (a bounded sample): rows with ``text`` and ``toxic`` (0 or 1)."""
    sample = labelled.filter("toxic in (0, 1)").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    share = pos / max(1, pos + neg)
    if not pos or not neg:
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -30, 30)))
    counts = _counted(sample).groupBy("feature").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    p, q = (F.col("a") + 0.5) / (pos + 1.0), (F.col("b") + 0.5) / (neg + 1.0)
    gain = (p - q) * (p - q) / (((F.col("a") + F.col("b") + 1.0) / (pos + neg + 2.0)) * F.lit(1.0 / (pos + 1) + 1.0 / (neg + 1)))
    best = counts.filter("a + b >= 2").withColumn("gain", gain).filter("gain > 6.6").orderBy(F.desc("gain"), "feature").limit(features)
    chosen = np.sort(np.array([r["feature"] for r in best.select("feature").collect()], dtype=np.int64).view(np.uint64))
    if not len(chosen):
        return Model(chosen, np.zeros(0), float(np.log(share / (1 - share))))
    weights, bias = _fit(_rows(sample, chosen, groups), len(chosen), ridge, swap_penalty, steps)
    return Model(chosen, weights, bias)


def scorer(model: Model):
    """A column function from texts to scores between 0 and 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        logit = np.full(len(texts), model.bias)
        for first, number, codes in word_features(texts) if len(model.features) else ():
            at = np.minimum(np.searchsorted(model.features, codes), len(model.features) - 1)
            hit = model.features[at] == codes
            pairs = np.unique(np.stack([number[hit] + first, at[hit]]), axis=1)  # a feature counts once in a text
            logit += np.bincount(pairs[0], model.weights[pairs[1]], len(texts))
        return pd.Series(1 / (1 + np.exp(-np.clip(logit, -40, 40))))

    return score


def _fitted(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], id_col: str, text_col: str) -> Model:
    """The sample is chosen among the labels, so what is joined with the texts is small enough to broadcast."""
    bounded_batches(docs.sparkSession)
    label = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].alias("toxic")).filter("toxic in (0, 1)")
    chosen = label.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return learn(stage(texts.join(F.broadcast(chosen), "doc_id"), "labelled"))


def classify(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Learns from labelled ids that are not ``held_out`` and scores all rows: doc_id, held_out, score, predicted."""
    model = _fitted(docs, labels, held_out, id_col, text_col)
    scored = docs.select(docs[id_col].alias("doc_id"), F.coalesce(held_out(docs[id_col]), F.lit(False)).alias("held_out"), scorer(model)(docs[text_col]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    return docs.filter(scorer(_fitted(docs, labels, held_out, id_col, text_col))(docs[text_col]) < threshold)
