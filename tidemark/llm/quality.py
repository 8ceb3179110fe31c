"""Quality classifier by positive-unlabelled learning.

Trusted positives are the labelled rows of label 1 that may teach; unlabelled are all documents. The model, a
logistic function of a text's shape (FEATURES and their squares), minimises the non-negative unbiased risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

with logistic loss, under which the unbiased risk is convex: Newton steps, each a sum over all documents' features,
and a step that would take the second part below zero is shortened until it does not. Negative labels are never used.

The class prior is estimated from positives and unlabelled documents alone: a logistic function is fitted to tell
the two apart, and of all its thresholds the one is taken above which the unlabelled share is least against the
positives' share, with an allowance for their numbers; that ratio is the prior (the best bin).

Means, scales, the unlabelled risk and the prior come from every document: features are computed once, written,
and summed by tasks. Of the labelled positives at most MAX_POSITIVES (by a hash of the id) are used.

A null or empty text has the features of no words and gets a score like any other. A text of any length counts
whole. Without any positive or document to learn from, every score is 0.5. Repeated rows score alike; scored texts
never meet, so there are no ties. A column of the score's name (in any case) is replaced, all others may have any
name. An empty table gives an empty one."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, fresh, give_back, without
from tidemark.llm.labelled import sample

MAX_POSITIVES = 20_000
BINS = 2_000

FEATURES = (
    "log_words", "word_length", "upper", "digit", "stop", "bang", "bar", "symbol", "other_punct", "space", "lines", "wide",
    "distinct_words", "top_word", "distinct_lines", "letters_inside", "noisy_words", "long_words", "caps_words", "repeats_next",
)

_CLASS = np.zeros(256, np.int64)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"-()?", b"!", b"|", b"*$%&#^~@=_<>{}[]\\/+`", b" \t\r\x0b\x0c", b"\n", bytes(range(128, 256))), 1):
    _CLASS[list(_set)] = _i


def features(text: str) -> np.ndarray:
    raw = text.encode()
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    c = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=10) / size if raw else np.zeros(10)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    # every word counts; those of a text's distinct words that carry odd characters weigh by how often they stand
    noisy = long = caps = 0
    for w, k in counts.items():
        if w.isupper() and len(w) > 1:
            caps += k
        if len(w) > 25:
            long += k
        if not w.isalnum() and not w.rstrip(b".,;:!?").isalnum() and w.isascii():
            noisy += k
    many = max(1, n)
    return np.array([
        np.log1p(n), np.log1p(size / many), c[1], c[2], c[3], c[4], c[5], c[6], c[0], c[7], c[8], c[9],
        len(counts) / many, counts.most_common(1)[0][1] / many if n else 0.0, len(set(lines)) / max(1, len(lines)), len(counts) / np.sqrt(many),
        noisy / many, long / many, caps / many, sum(map(bytes.__eq__, words, words[1:])) / many,
    ])


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z / 6])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weights + self.bias, -30, 30)))


class Pool:
    """Sums over the feature rows of all documents. ``table``: (x array<double>), written; or an array (tests)."""

    def __init__(self, table: DataFrame | np.ndarray) -> None:
        self.table = table

    def total(self, f, size: int) -> np.ndarray:
        """The sum of ``f(rows)``, ``size`` numbers, over all rows, added up by tasks."""
        if isinstance(self.table, np.ndarray):
            return f(self.table)
        k = len(FEATURES)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, n = np.zeros(size), 0
            for b in batches:
                if b.num_rows:
                    out, n = out + f(b.column(0).flatten().to_numpy().reshape(-1, k)), n + b.num_rows
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["s"])

        parts = self.table.select("x").mapInArrow(add, "s array<double>").select(F.posexplode("s").alias("at", "s"))
        out = np.zeros(size)
        for r in parts.groupBy("at").agg(F.sum("s").alias("s")).collect():  # ``size`` rows
            out[r["at"]] = r.s
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _ones(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def newton(pool: Pool, n: int, model: QualityModel, p: np.ndarray, prior: float, tell_apart: bool, ridge: float = 1e-4, rounds: int = 20) -> np.ndarray:
    """Weights (the last one the bias) that minimise the non-negative unbiased risk over positives ``p`` and the pool
    or, to ``tell_apart`` the two, the mean logistic loss of positives against the pool."""
    k = p.shape[1]
    eye = np.eye(k) * ridge
    eye[-1, -1] = 1e-9

    def sums(w: np.ndarray) -> np.ndarray:
        def f(x: np.ndarray) -> np.ndarray:
            u = _ones(model.expand(x))
            z = u @ w
            s = _sigmoid(z)
            return np.concatenate([[np.logaddexp(0, z).sum()], u.T @ s, ((u * (s * (1 - s))[:, None]).T @ u).ravel()])

        return pool.total(f, 1 + k + k * k) / n

    def positive(w: np.ndarray) -> tuple[float, float]:
        z = p @ w
        return float(np.logaddexp(0, -z).mean()), float(np.logaddexp(0, z).mean())

    def risk(w: np.ndarray, unlabelled: float) -> tuple[float, float]:
        plus, minus = positive(w)
        part = unlabelled if tell_apart else unlabelled - prior * minus
        return (1.0 if tell_apart else prior) * plus + max(0.0, part) + 0.5 * float(w @ eye @ w), part

    w = np.zeros(k)
    w[-1] = 0.0 if tell_apart else np.log(prior / (1 - prior))
    got = sums(w)
    for _ in range(rounds):
        now, _part = risk(w, got[0])
        sp = _sigmoid(p @ w)
        if tell_apart:
            gradient = p.T @ (sp - 1) / len(p) + got[1 : k + 1]
            bend = (p * (sp * (1 - sp))[:, None]).T @ p / len(p)
        else:  # loss(+) - loss(-) is linear under logistic loss
            gradient, bend = got[1 : k + 1] - prior * p.mean(axis=0), 0.0
        step = np.linalg.solve(got[k + 1 :].reshape(k, k) + bend + eye + 1e-9 * np.eye(k), gradient + eye @ w)
        size = 1.0
        while size > 1e-3:
            new = np.round(w - size * step, 9)  # the sums come in any order: reruns shall agree
            ahead = sums(new)
            value, part = risk(new, float(ahead[0]))
            if value <= now + 1e-12 and part >= 0:
                break
            size /= 2
        else:
            break
        w, got = new, ahead
        if now - value < 1e-6:
            break
    return w


def best_bin(positives: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> float:
    """The class prior: over all thresholds (``edges``), the least ratio of the unlabelled share above it (``counts`` by
    bin) to the positives' share, of those whose ratio with an allowance for both numbers is least."""
    n_u, n_p = max(1, counts.sum()), max(1, len(positives))
    q_u = counts[::-1].cumsum()[::-1] / n_u
    q_p = np.array([(positives >= e).mean() for e in edges[:-1]])
    allow = np.sqrt(np.log(4 / 0.1) / (2 * n_u)) + np.sqrt(np.log(4 / 0.1) / (2 * n_p))
    live = q_p > 0
    at = np.argmin(np.where(live, (q_u + allow) / np.where(live, q_p, 1), np.inf))
    return float(min(0.99, max(0.01, q_u[at] / q_p[at]))) if live.any() else 0.5


def fit_features(pos: np.ndarray, pool: Pool, prior: float | None = None) -> QualityModel:
    """The model from positives' feature rows and the pool of all; ``prior``: estimated where it is None."""
    k = len(FEATURES)
    n, *both = np.split(pool.total(lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]), 1 + 2 * k), [1, k + 1])
    n = int(n[0])
    if not len(pos) or not n:
        return QualityModel(np.zeros(k), np.ones(k), np.zeros(2 * k), 0.0, 0.5)
    mean = np.round(both[0] / n, 9)
    scale = np.round(np.sqrt(np.maximum(both[1] / n - mean**2, 0)), 9) + 1e-6
    model = QualityModel(mean, scale, np.zeros(2 * k), 0.0, 0.5)
    p = _ones(model.expand(pos))
    if prior is None:
        # what is counted has not been fitted: one half of the positives each
        fitted, counted = (p[::2], p[1::2]) if len(p) >= 20 else (p, p)
        w = newton(pool, n, model, fitted, 0.5, True)
        edges = np.linspace(-15, 15, BINS + 1)
        inside = lambda z: np.clip(z, edges[0], edges[-1] - 1e-9)
        counts = pool.total(lambda x: np.histogram(inside(_ones(model.expand(x)) @ w), edges)[0].astype(float), BINS)
        prior = best_bin(inside(counted @ w), counts, edges)
    w = newton(pool, n, model, p, prior, False)
    return QualityModel(mean, scale, w[:-1], float(w[-1]), prior)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_positives: int = MAX_POSITIVES, prior: float | None = None) -> QualityModel:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, 1000) for x in batches for at in range(0, x.num_rows, 1000)):
            rows = [features(t or "").tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], ["x"])
        give_back()

    taught = sample(docs, labels, label, max_positives, each=True).where("label = 1")
    pos = np.array(sorted(r.x for r in taught.select("text").mapInArrow(measure, "x array<double>").collect()))  # bounded
    every = cut(docs.select("text").mapInArrow(measure, "x array<double>"))
    model = fit_features(pos.reshape(-1, len(FEATURES)), Pool(every), prior)
    give_back()
    return model


def score(docs: DataFrame, model: QualityModel, text: str = "text", keep: list[str] | None = None, column: str = "score") -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with ``column``: how likely the text is of label 1."""
    kept = without(docs.columns if keep is None else keep, [column])
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                x = np.array([features(t or "") for t in part.column(len(kept)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(model.score(x))], [*kept, column])
        give_back()

    return docs.select(*kept, F.col(text).alias(fresh("_text", kept))).mapInArrow(run, schema)
