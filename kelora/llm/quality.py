"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a document labelled good, one labelled bad) give P(good wins) = sigmoid(w . (x_good - x_bad)); w
minimises the logistic loss on feature differences. A document's worth is w . x; the threshold is a quantile of the
training worths, and the published score is a logistic curve through that threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelora.llm.common import TRAIN_ROWS, held_out, training_docs, widened

N_FEATURES = 18
#: Preference pairs drawn for each document of the rarer label.
PAIRS_EACH = 12
CUT = 0.3


def features(text: str | None) -> list[float]:
    """Shape of one whole text. Empty and null texts give the features of a text without words."""
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    chars = max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    repeats = sum(map(str.__eq__, words, words[1:]))
    triples = max(1, len(words) - 2)
    fresh = len(set(zip(words, words[1:], words[2:])))
    symbols = sum(map(text.count, "#*$%&<>"))
    pipes = text.count("|")
    upper = sum(map(str.isupper, words))
    closed = sum(x.rstrip().endswith((".", "!", "?")) for x in lines)
    return [
        math.log1p(len(words)), len(text) / n / 10, distinct / n, math.log(distinct + 1) / math.log(n + 2), repeats / n,
        1 - fresh / triples, math.log1p(50 * symbols / n), math.log1p(50 * pipes / n), upper / n,
        math.log1p(50 * text.count("!!") / n), 1 - len(set(lines)) / max(1, len(lines)), closed / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))), sum(map(text.count, "0123456789")) / chars * 10,
        float(repeats / n > 0.2), float(upper / n > 0.3), float(symbols / n > 0.1), float(pipes / n > 0.03),
    ]


def fit_pairs(x: np.ndarray, y: np.ndarray, seed: int = 7, ridge: float = 1.0) -> np.ndarray:
    """Bradley-Terry weights from preference pairs drawn between labels; zeros if one label is absent."""
    good, bad = np.flatnonzero(y > 0), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    a, b = np.repeat(few, PAIRS_EACH), rng.choice(many, len(few) * PAIRS_EACH)
    diff = x[b] - x[a] if few is bad else x[a] - x[b]
    w = np.zeros(x.shape[1])
    for _ in range(40):  # Newton on sum log(1 + exp(-w.diff)) + ridge/2 |w|^2
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff + ridge * np.eye(len(w)), diff.T @ (1 - p) - ridge * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Model from at most ``rows`` labelled documents outside the held-out fold.

    Null labels and ids are not used; without documents of both labels all worths are equal. Null texts are empty.
    """

    def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [features(t) for t in b["text"]], "label": b["label"]})

    got = training_docs(docs, labels, "quality", rows).select("text", "label").mapInPandas(shape, "x array<double>, label int").toPandas()
    if not len(got):
        return {"mean": np.zeros(N_FEATURES), "std": np.ones(N_FEATURES), "w": np.zeros(N_FEATURES), "cut": 0.0, "scale": 1.0}
    x, y = np.vstack(got["x"]), got["label"].to_numpy()
    mean, std = x.mean(0), x.std(0) + 1e-6
    w = fit_pairs((x - mean) / std, y)
    worth = (x - mean) / std @ w
    # the cut is the quantile of the worths that separates the labels best among quantiles around the share of bad ones
    share = float((y == 0).mean())
    tries = np.unique(np.clip(share * np.linspace(0.6, 1.4, 81), 0.001, 0.999))
    cuts = np.quantile(worth, tries)
    right = [((worth >= c) == (y > 0)).mean() for c in cuts]
    cut = float(np.mean(cuts[np.asarray(right) >= max(right) - 1e-12]))
    return {"mean": mean, "std": std, "w": w, "cut": cut, "scale": float(worth.std() / 3 + 1e-6)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1; at least CUT where the worth reaches the quantile). One narrow pass."""
    schema = widened(docs, "quality_score", "double")
    docs = docs.drop("quality_score")
    names = docs.columns
    base = math.log(CUT / (1 - CUT))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([features(t) for t in b["text"]]).reshape(len(b), N_FEATURES)
            worth = (x - model["mean"]) / model["std"] @ model["w"]
            z = np.clip((worth - model["cut"]) / model["scale"] + base, -30, 30)
            yield b[names].assign(quality_score=1 / (1 + np.exp(-z)))

    return docs.mapInPandas(run, schema)


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per row of ``docs``: held_out, score, predicted. Null and empty texts score as texts without words; equal texts
    and repeated rows score alike; a null id is not held out; extra columns are not read; no rows give no rows."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= CUT).cast("int").alias("predicted"))
