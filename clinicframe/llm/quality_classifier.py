"""Quality scores from positive and unlabelled texts.

Trusted positives are documents labelled good; unlabelled text is any text of the same
fold, whatever its label. The share of good text in it, the class prior, is estimated
from a classifier of positives against unlabelled text: the best bin of its scores, the
one with the fewest unlabelled texts per positive, bounds the prior (best-bin
estimation). A small network is then fitted to the non-negative unbiased risk
``prior * E+[l(f)] + max(0, Eu[l(-f)] - prior * E+[l(-f)])`` with the logistic loss.

Features are shares of kinds of characters, words and lines of the whole text; labels,
language, source and identifier are not among them. They are computed in one pass over the
texts and checkpointed; ``keep_good`` computes them again in the pass that filters the rows,
so that no identifier has to lead from a score back to its row. Only the fit is bounded: ``SAMPLE_ROWS`` positives and
as many unlabelled texts, those with the smallest hashed identifiers.

Nulls: a null text is empty, and an empty text is scored like any other; documents with
a null doc_id are never learned from. A document labelled more than once is a positive
if all its labels are 1. Repeated rows are scored each. Without positives every score is
0.5. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinicframe.llm.common import LAST_ID, identifier, in_order, smallest
from clinicframe.session import ensure_checkpoint_dir, small_batches

SAMPLE_ROWS = 8192
CUT = 0.3
FOLDS = 5
HIDDEN = 16
ROUNDS = 300
SEED = 7
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*", "!", "|", ".,;:?", "'\"()[]{}", "<>=/\\@~^_+-", " ", "\n")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning: one in FOLDS by checksum; those without identifier too."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES) + 1))
    for k, characters in enumerate(_CLASSES):
        table[list(characters.encode()), k] = 1
    table[128:, -1] = 1
    return table


_TABLE = _class_table()
N_FEATURES = len(_CLASSES) + 1 + 7


def features(text: str) -> list[float]:
    """Shares of characters, and how much words, word pairs and lines repeat."""
    data = text.encode()
    size = max(1, len(data))
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _TABLE / size
    words = data.split()
    n, lines = len(words), data.split(b"\n")
    return [
        *np.sqrt(shares).tolist(), np.log1p(len(data)), np.log1p(n) - np.log1p(len(set(words))),
        sum(map(eq, words, words[1:])) / max(1, n), len(set(zip(words, words[1:]))) / max(1, n - 1) if n > 1 else 1.0,
        size / max(1, n) if n else 0.0, len(set(lines)) / len(lines), min(1.0, max(map(len, words), default=0) / 1000),
    ]


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_order, features) of every whole text."""

    def compute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_order": frame["doc_order"], "features": [features(t) for t in frame["text"]]})

    return in_order(docs).mapInPandas(compute, "doc_order long, features array<double>")


class Network:
    """One hidden layer on standardised features."""

    def __init__(self, rows: np.ndarray) -> None:
        draw = np.random.default_rng(SEED)
        self.mean, self.scale = rows.mean(axis=0), rows.std(axis=0) + 1e-3
        d = rows.shape[1]
        self.weights = [draw.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -6, 6)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        w, b, v, c = self.weights
        return np.tanh(self.inputs(rows) @ w + b) @ v + c[0]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, rate: float = 0.02, decay: float = 1e-4) -> "Network":
        """Minimise the non-negative risk with Adam; without a prior, the plain loss of positives against unlabelled texts."""
        x = self.inputs(np.concatenate([positive, unlabelled]))
        p = len(positive)
        first, second = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        for t in range(1, ROUNDS + 1):
            w, b, v, c = self.weights
            hidden = np.tanh(x @ w + b)
            f = hidden @ v + c[0]
            up = 1 / (1 + np.exp(-f))  # slope of the loss of calling a text bad; up - 1 that of calling it good
            slope = np.empty_like(f)
            if prior is None:
                slope[:p], slope[p:] = (up[:p] - 1) / p, up[p:] / (len(f) - p)
            else:
                loss = np.logaddexp(0, f)
                bad_risk = loss[p:].mean() - prior * loss[:p].mean()
                bad = np.concatenate([-prior * up[:p] / p, up[p:] / (len(f) - p)])
                if bad_risk >= 0:
                    slope[:] = bad
                    slope[:p] += prior * (up[:p] - 1) / p
                else:  # the risk of bad texts went below zero: step back from it
                    slope[:] = -bad
            back = np.outer(slope, v) * (1 - hidden**2)
            grads = [x.T @ back + decay * w, back.sum(axis=0), hidden.T @ slope + decay * v, np.array([slope.sum()])]
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.weights[k] = self.weights[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(rows)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among unlabelled texts, from scores of both: the least ratio of the shares above a cut, with a margin for chance."""
    cuts = np.unique(positive)
    above = [1 - np.searchsorted(np.sort(s), cuts) / len(s) for s in (unlabelled, positive)]
    margin = sum(np.sqrt(np.log(4 / delta) / (2 * len(s))) for s in (unlabelled, positive))
    best = np.argmin((above[0] + margin) / np.maximum(above[1], 1e-9))
    return float(np.clip(above[0][best] / above[1][best], 0.01, 0.99))


def fit(features_of: DataFrame, labels: DataFrame) -> Network | None:
    """The network, from bounded samples of the learning fold; None without positives."""
    learn = features_of.filter(~held_out(identifier())).filter(F.col("doc_order") != LAST_ID)
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_order")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).filter("q = 1")
    pick = lambda df, salt: np.array(
        [r["features"] for r in smallest(df, [F.xxhash64("doc_order", F.lit(salt)), "doc_order"], SAMPLE_ROWS).collect()]
    )
    positive, unlabelled = pick(learn.join(good, "doc_order", "left_semi"), 1), pick(learn, 2)
    if not len(positive):
        return None
    half = Network(unlabelled).fit(positive[::2], unlabelled[::2], None)
    other = [x[1::2] if len(x) > 1 else x for x in (positive, unlabelled)]
    prior = estimate_prior(half.logits(other[0]), half.logits(other[1]))
    return Network(unlabelled).fit(positive, unlabelled, prior)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    ensure_checkpoint_dir(docs.sparkSession)
    with small_batches(docs.sparkSession):
        table = feature_table(docs).checkpoint()
    network = fit(table, labels)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_order": frame["doc_order"], "score": scores(network, frame["features"].tolist())})

    out = table.mapInPandas(score, "doc_order long, score double").withColumn("doc_id", identifier())
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def scores(network: Network | None, rows: list[list[float]]) -> np.ndarray:
    return network.score(np.array(rows).reshape(-1, N_FEATURES)) if network else np.full(len(rows), 0.5)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows predicted good, with all their columns, each decided by its own text where it stands."""
    ensure_checkpoint_dir(docs.sparkSession)
    with small_batches(docs.sparkSession):
        table = feature_table(docs).checkpoint()
    network = fit(table, labels)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(scores(network, [features(t) for t in texts]) >= CUT)

    return docs.filter(good(F.coalesce(F.col("text").cast("string"), F.lit(""))))
