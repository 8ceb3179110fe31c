"""Toxicity: a support vector machine on a string-subsequence kernel with Nystroem landmarks.

Units are a text's lower-cased words, cut at white space, without marks at their ends; letters set apart by
blanks (``i d i o t``) also form one. Units longer than WIDTH are read through overlapping windows. The kernel of
two units sums, over all common subsequences of ORDER characters, DECAY to the power of the lengths they span in
both, and is normalised; so an insult with gaps or inserted characters stays close to the plain one.

Training: landmarks are units of labelled texts (those that toxic texts have much more often than others, and
common ones). Units enter through the Nystroem map of their kernel values with the landmarks; a linear
support vector machine separates the units of toxic texts from the others', and is fitted again with only the
highest units of each toxic text as positives. As its decision function is linear in the kernel, landmarks and
weights fold into one table over subsequences, exactly: scoring a unit sums table entries over its own
subsequences. A text's highest unit values and how many are positive give its probability, by a logistic fit, for which
each toxic text also stands a second time with a character put into its insults.

Bounds of what the fit sees: MAX_TEXTS labelled texts of either label, of any length, for the units, of each at most
MAX_WORDS distinct words (by a hash); MAX_LABELLED labelled texts for the logistic fit. Scoring covers all units of
every text.

A unit of fewer than ORDER characters is filled up by a mark, so it has one subsequence and is known in its plain
form only; gaps and inserted characters are tolerated from ORDER characters on. Alphabets of any size are held: a
pair of characters is a number of its own only if a landmark has it.

Null and empty texts have no units and get the logistic score of none. Without labels of both kinds, every score
is the share of toxic labels (0 if there are none). Repeated rows score alike; the scored texts never meet, so there
are no ties. A column of the score's name (in any case) is replaced, all others may have any name. An empty table gives an empty one."""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, give_back, without
from tidemark.llm.labelled import held_out, sample

ORDER, DECAY, WIDTH, STRIDE = 4, 0.8, 12, 4
TOXIC_LANDMARKS, OTHER_LANDMARKS = 96, 32
MAX_TEXTS, MAX_WORDS, MAX_LABELLED, MAX_UNITS = 1_000, 2_000, 20_000, 25_000
FILL = "\0"
#: The largest table of pairs of pairs that is looked up by place (4 bytes an entry); larger ones are searched.
MAX_TABLE = 1 << 22
WITNESSES = 6

_APART = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
_MARKS = " \t\n.,;:!?\"'()[]{}<>|*&%$#@~^=_-+/\\`"


def tokens(text: str) -> set[str]:
    """A text's distinct words, and its runs of single characters as words."""
    text = text.lower()
    return {*text.split(), *(m.group().replace(" ", "") for m in _APART.finditer(text))}


def windows(token: str) -> list[str]:
    """What is read of a token: it without marks at its ends, and, if it has marks inside, it without any."""
    unit = token.strip(_MARKS)
    forms = [unit] if unit.isalnum() or not unit else [unit, "".join(filter(str.isalnum, unit))]
    forms = [f.ljust(ORDER, FILL) if 0 < len(f) < ORDER else f for f in forms]
    return [f[i : i + WIDTH] for f in forms for i in range(0, max(1, len(f) - WIDTH + STRIDE), STRIDE)]


@lru_cache(maxsize=WIDTH + 1)
def _pairs(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of places in a unit of ``length``, and which pairs are the two halves of each of ``_places``."""
    pairs = np.array(list(combinations(range(length), 2)), np.int64).reshape(-1, 2)
    number = np.zeros((length, length), np.int64)
    number[pairs[:, 0], pairs[:, 1]] = np.arange(len(pairs))
    at, _ = _places(length)
    return pairs, number[at[:, 0], at[:, 1]], number[at[:, 2], at[:, 3]]


@lru_cache(maxsize=WIDTH + 1)
def _places(length: int) -> tuple[np.ndarray, np.ndarray]:
    """All ORDER places in a unit of ``length``, and what each weighs: DECAY to its span."""
    at = np.array(list(combinations(range(length), ORDER)), np.int64).reshape(-1, ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1).astype(float)


def _codes(units: list[str]) -> np.ndarray:
    return np.array([list(map(ord, u)) for u in units], np.int64).reshape(len(units), -1)


def norms(codes: np.ndarray) -> np.ndarray:
    """The root of each unit's kernel with itself, by the kernel's recursion; all units of one length."""
    n, length = codes.shape
    prefix = np.ones((length + 1, length + 1, n))
    same = (codes[:, :, None] == codes[:, None, :]).transpose(1, 2, 0)
    total = np.zeros(n)
    for order in range(ORDER):
        if order == ORDER - 1:
            return np.sqrt(DECAY**2 * (same * prefix[:-1, :-1]).sum(axis=(0, 1)))
        nxt = np.zeros_like(prefix)
        for i in range(1, length + 1):
            row = np.zeros(n)
            for j in range(1, length + 1):
                row = DECAY * row + DECAY**2 * same[i - 1, j - 1] * prefix[i - 1, j - 1]
                nxt[i, j] = DECAY * nxt[i - 1, j] + row
        prefix = nxt
    return total


def by_length(units: list[str], step: int = 2000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, codes) of the units of each length that has subsequences, ``step`` at a time."""
    lengths = np.array([len(u) for u in units])
    for n in range(ORDER, WIDTH + 1):
        where = np.flatnonzero(lengths == n)
        for at in range(0, len(where), step):
            part = where[at : at + step]
            yield part, _codes([units[i] for i in part])


@dataclass
class Landmarks:
    """Units and the weight of each subsequence of theirs. A subsequence of ORDER = 4 characters is known by its two
    halves, each a pair of characters that some landmark has there (number 0: any other pair)."""

    units: list[str]
    entries: np.ndarray = None  # subsequences that any landmark has, as keys, sorted
    weights: np.ndarray = None  # entries (and a last row for none) x landmarks, normalised

    def __post_init__(self) -> None:
        alphabet = sorted({ord(c) for u in self.units for c in u})
        self.base = len(alphabet) + 1
        self.code_of = np.zeros(0x110000, np.int32)
        self.code_of[alphabet] = np.arange(1, self.base, dtype=np.int32)
        halves = [(self.code_of[_codes([u])[0]], *_pairs(len(u))) for u in self.units]
        pair = [small[p[:, 0]].astype(np.int64) * self.base + small[p[:, 1]] for small, p, _, _ in halves]
        self.halves = []
        for side in (2, 3):
            found = np.unique(np.concatenate([x[h[side]] for x, h in zip(pair, halves)]))
            number = np.zeros(self.base**2, np.int32)
            number[found] = np.arange(1, len(found) + 1, dtype=np.int32)
            self.halves.append(number)
        self.second = int(self.halves[1].max(initial=0)) + 1
        self.size = (int(self.halves[0].max(initial=0)) + 1) * self.second
        maps = []
        for u in self.units:
            own, codes = Counter(), _codes([u])
            for key, x in zip(self.keys(codes)[0].tolist(), (_places(len(u))[1] / norms(codes)[0]).tolist()):
                own[key] += x
            maps.append(own)
        self.entries = np.array(sorted({k for m in maps for k in m}), np.int64)
        self.weights = np.zeros((len(self.entries) + 1, len(self.units)))  # the last row: none
        where = {k: i for i, k in enumerate(self.entries.tolist())}
        for j, m in enumerate(maps):
            for k, x in m.items():
                self.weights[where[k], j] = x
        self.index = self.spread(np.arange(len(self.entries)), len(self.entries), np.int32)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """Units (all of one length) x places: the number of each subsequence."""
        pairs, first, last = _pairs(codes.shape[1])
        small = self.code_of[codes]
        pair = small[:, pairs[:, 0]] * np.int64(self.base) + small[:, pairs[:, 1]]
        heads = self.halves[0][pair].astype(np.int64) * self.second
        return heads[:, first] + self.halves[1][pair][:, last]

    def spread(self, values: np.ndarray, none, kind) -> np.ndarray:
        """What ``look_up`` reads: a value for each entry and one for all else."""
        if self.size > MAX_TABLE:
            return np.append(values, none).astype(kind)
        out = np.full(self.size, none, kind)
        out[self.entries] = values
        return out

    def look_up(self, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if self.size <= MAX_TABLE:
            return table[keys]
        at = np.minimum(np.searchsorted(self.entries, keys), len(self.entries) - 1)
        return table[np.where(self.entries[at] == keys, at, len(self.entries))]

    def kernel(self, units: list[str]) -> np.ndarray:
        """Normalised kernel values: units x landmarks (0 for units shorter than ORDER)."""
        out = np.zeros((len(units), len(self.units)))
        for where, codes in by_length(units, 200):
            w = _places(codes.shape[1])[1]
            entry = self.look_up(self.index, self.keys(codes))
            size = len(self.entries) + 1
            flat = np.bincount((np.arange(len(codes))[:, None] * size + entry).ravel(), np.broadcast_to(w, entry.shape).ravel(), len(codes) * size)
            out[where] = flat.reshape(len(codes), size) @ self.weights / norms(codes)[:, None]
        return out


@dataclass(frozen=True)
class ToxicityModel:
    landmarks: Landmarks | None
    table: np.ndarray | None  # the folded decision function over subsequences
    bias: float
    weights: np.ndarray  # of the logistic fit over text_features
    offset: float

    def values(self, units: list[str]) -> np.ndarray:
        out = np.full(len(units), self.bias)
        for where, codes in by_length(units):
            w = _places(codes.shape[1])[1]
            out[where] += (self.landmarks.look_up(self.table, self.landmarks.keys(codes)) @ w) / norms(codes)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.offset, -30, 30)))


N_FEATURES = 6
#: Words whose values a worker keeps.
KEPT = 150_000


class Reader:
    """A worker's reader of texts: keeps the values of recent words."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.known = model, {}

    def text_features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), N_FEATURES))
        begin = 0
        while self.model.table is not None and begin < len(texts):
            sets, held = [], 0
            while begin + len(sets) < len(texts) and held < 60_000:
                sets.append(tokens(texts[begin + len(sets)]))
                held += len(sets[-1])
            self._learn(set().union(*sets))
            for i, own in enumerate(sets, begin):
                out[i] = self._summary(own)
            begin += len(sets)
        return out

    def _learn(self, own: set[str]) -> None:
        fresh = [t for t in own if t not in self.known]
        if len(self.known) + len(fresh) > KEPT:
            self.known.clear()
            fresh = list(own)
        if fresh:
            parts = [windows(t) for t in fresh]
            flat = self.model.values([w for p in parts for w in p])
            starts = np.cumsum([0, *map(len, parts[:-1])])
            self.known.update(zip(fresh, np.maximum.reduceat(flat, starts).tolist()))

    def _summary(self, own: set[str]) -> list[float]:
        v = np.fromiter((self.known[t] for t in own), float, len(own))
        hits = np.maximum(v + 0.3, 0).sum()
        return [np.log1p(hits), np.log1p((v > -0.2).sum()), np.log1p((v > 0.2).sum()), np.log1p((v > 0.5).sum()), np.log1p(hits / (1 + len(v)) * 100), np.log1p(len(v)) / 4]

    def gapped(self, text: str) -> str:
        """``text`` with a character put into each word of a high value, for the fit to learn from."""
        rng = np.random.default_rng(len(text))
        self._learn(tokens(text))
        return " ".join(altered(t, rng) if self.known.get(t, 0) > 0.3 else t for t in text.lower().split())


def svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1e-3, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps; weights ``c`` of the rows."""
    size = x.shape[1] + 1
    w, c = np.zeros(size), c / c.sum()
    eye = np.eye(size) * ridge
    eye[-1, -1] = 1e-9
    for _ in range(rounds):
        bend, pull = eye.copy(), np.zeros(size)
        for at in range(0, len(x), 4096):  # in parts, so that no second copy of all rows is made
            rows = np.hstack([x[at : at + 4096].astype(float), np.ones((len(x[at : at + 4096]), 1))])
            live = y[at : at + 4096] * (rows @ w) < 1
            weighted = rows[live] * c[at : at + 4096][live, None]
            bend += weighted.T @ rows[live]
            pull += weighted.T @ y[at : at + 4096][live]
        new = np.linalg.solve(bend, pull)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> tuple[np.ndarray, float]:
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    eye = np.eye(len(w)) * ridge
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1 + eye, x1.T @ (y - p) - eye @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def constant(share: float) -> ToxicityModel:
    share = min(1 - 1e-9, max(1e-9, share))
    return ToxicityModel(None, None, 0.0, np.zeros(N_FEATURES), float(np.log(share / (1 - share))))


def altered(unit: str, rng: np.random.Generator) -> str:
    at = int(rng.integers(1, max(2, len(unit))))
    return unit[:at] + "-._*'xe"[rng.integers(0, 7)] + unit[at:]


def fit_units(toxic: list[str], other: list[str]) -> ToxicityModel | None:
    """The unit model from texts of either label, each its distinct words with blanks between; None where it has
    nothing to learn from."""
    read: dict[str, list[str]] = {}  # texts share the units of their words

    def units_of(words: str) -> set[str]:
        own: set[str] = set()
        for t in words.split(" "):
            if t not in read:
                read[t] = [w for w in windows(t) if len(w) >= ORDER]
            own.update(read[t])
        return own

    sets = [[units_of(x) for x in texts] for texts in (toxic, other)]
    read.clear()
    seen = [Counter(w for s in own for w in s) for own in sets]
    n_t, n_o = max(1, len(toxic)), max(1, len(other))
    least = 2 if n_t < 200 else 3
    telling = sorted((-k / n_t + seen[1][u] / n_o, u) for u, k in seen[0].items() if k >= least and k / n_t > 4 * seen[1][u] / n_o)
    common = sorted((-k, u) for u, k in seen[1].items() if FILL not in u) or sorted((-k, u) for u, k in seen[1].items())
    if not telling or not common:
        return None
    chosen = [u for _, u in telling[:TOXIC_LANDMARKS]]
    chosen += [u for _, u in common if u not in set(chosen)][:OTHER_LANDMARKS]
    marks = Landmarks(chosen)
    rng = np.random.default_rng(7)
    # what a gap or an inserted character makes of a unit, for telling and common ones alike
    for one, other_one in zip(telling[:TOXIC_LANDMARKS] * 3, rng.integers(0, len(common), 3 * TOXIC_LANDMARKS)):
        for side, u in ((0, one[1]), (1, common[other_one][1])):
            v = altered(u, rng)
            if len(v) <= WIDTH and FILL not in u:
                seen[side][v] += -(-seen[side][u] // 3)
                own = [x for x in sets[side] if u in x]
                for x in own[: seen[side][v]]:
                    x.add(v)
    units = sorted(set(seen[0]) | set(seen[1]))
    if len(units) > MAX_UNITS:  # all that toxic texts share, and a sample of the rest
        shared = [u for u in units if seen[0][u] >= 2]
        rest = [u for u in units if seen[0][u] < 2]
        units = sorted(shared + [rest[i] for i in rng.choice(len(rest), max(0, min(len(rest), MAX_UNITS - len(shared))), replace=False)])
    at = {u: i for i, u in enumerate(units)}
    k = marks.kernel(units)
    value, vector = np.linalg.eigh(marks.kernel(marks.units))
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    x = (k @ root).astype(np.float32)
    del k
    pos = np.array([seen[0][u] / n_t for u in units])
    neg = np.array([seen[1][u] / n_o for u in units])
    for turn in range(4):
        y = np.concatenate([np.ones(len(units)), -np.ones(len(units))])
        c = np.concatenate([pos / max(pos.sum(), 1e-12), neg / max(neg.sum(), 1e-12) * (1 if turn == 0 else 4)])
        use = c > 0
        rows = np.flatnonzero(use)
        w, bias = svm(x[rows % len(units)], y[rows], c[rows])
        f = x @ w + bias
        pos = np.zeros(len(units))
        for s in sets[0]:
            own = sorted(((f[at[u]], u) for u in s if u in at), reverse=True)[:WITNESSES]
            for v, u in own:
                if v > -0.5:
                    pos[at[u]] += 1 / n_t
        if not pos.any():
            break
    alpha = root @ w
    folded = np.append(marks.weights[:-1] @ alpha, 0.0)
    return ToxicityModel(marks, marks.spread(folded[:-1], 0.0, np.float32), bias, np.zeros(N_FEATURES), 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_texts: int = MAX_TEXTS, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    labels = labels.where(~held_out(F.col("doc_id")))

    def some(own: set[str], seed: int) -> list[str] | set[str]:
        if len(own) <= MAX_WORDS:
            return own
        return heapq.nsmallest(MAX_WORDS, own, key=lambda w: (zlib.crc32(w.encode(), seed & 0xFFFFFFFF), w))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [" ".join(sorted(some(tokens(t), len(t)))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.string())], ["label", "words"])
        give_back()

    taught = sample(docs, labels, label, max_texts, each=True).select("label", "text").mapInArrow(words, "label int, words string").collect()  # bounded
    texts = [sorted(r.words for r in taught if r.label == y) for y in (1, 0)]
    del taught
    unit_model = fit_units(*texts)
    del texts
    give_back()
    counts = {r[label]: r["count"] for r in labels.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    if unit_model is None:
        return constant(counts.get(1, 0) / max(1, sum(counts.values())))
    held = docs.sparkSession.sparkContext.broadcast(unit_model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(held.value)
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            rows += [(i, 1, read.gapped(t)) for i, y, t in rows if y == 1]
            x = read.text_features([t for *_, t in rows])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], ["id", "label", "x"])

    rows = sample(docs, labels, label, max_labelled).select("id", "label", "text").mapInArrow(measure, "id long, label int, x array<double>")
    got = sorted((r.id, r.label, tuple(r.x)) for r in rows.collect())  # bounded by max_labelled
    give_back()
    weights, offset = logistic(np.array([x for *_, x in got]), np.array([y for _, y, _ in got], float))
    return ToxicityModel(unit_model.landmarks, unit_model.table, unit_model.bias, weights, offset)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None, column: str = "score") -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with ``column``: how likely the text is toxic."""
    kept = without(docs.columns if keep is None else keep, [column])
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(column, T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_TABLE entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(held.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                x = read.text_features([t or "" for t in part.column(len(kept)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(held.value.probability(x))], [*kept, column])
        del read
        give_back()

    return docs.select(*kept, F.col(text).alias(fresh("_text", kept))).mapInArrow(run, schema)

