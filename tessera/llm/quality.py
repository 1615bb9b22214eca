"""Quality scores by a generalised additive model with pairwise interactions.

Features of a text are binned; every feature has a table with one value per bin, learned by cyclic boosting: round after
round, each feature in turn gets a shallow tree over its bins, fitted to what is left, and the tree's leaves are added to
the table. Pairs of features that explain most of the rest get small two-dimensional tables in the same way. A score is the
logistic of a sum of table entries, so scoring is a bin search and an addition per table.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, worker_cache

#: The most labelled rows that a model is fitted on: those of the least hash of their id.
MAX_SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, PENALTY = 80, 30, 0.15, 1.0

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_STOPS = b".,;:"
_LOUD = b"!?"
_SYMBOL = b"#$%&*@^~<>{}[]\\=+_`"
_WHITE = b" \t\n\r\x0b\x0c"
NAMES = (
    "log_bytes", "log_words", "word_bytes", "upper_share", "symbol_share", "stop_share", "loud_share", "bar_share",
    "digit_share", "white_share", "letter_share", "distinct_words", "repeated_words", "repeated_lines", "line_words",
)


def features(text: bytes) -> tuple[float, ...]:
    """The features of a whole text; all but the first two are shares or means that any length can have."""
    n = len(text)
    count = lambda drop: n - len(text.translate(None, drop))
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    w, size, rows = len(words), max(1, n), max(1, len(lines))
    upper, lower = count(_UPPER), count(_LOWER)
    same = sum(map(operator.eq, words, words[1:]))
    return (
        math.log1p(n), math.log1p(w), (n - count(_WHITE)) / max(1, w), upper / max(1, upper + lower), count(_SYMBOL) / size,
        count(_STOPS) / size, count(_LOUD) / size, count(b"|") / size, count(_DIGIT) / size, count(_WHITE) / size,
        sum(map(count, (_UPPER, _LOWER))) / size, len(set(words)) / max(1, w), same / max(1, w - 1), 1 - len(set(lines)) / rows, w / rows,
    )


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The value of each ordered bin from a tree of few leaves on summed gradients and curvatures; best splits first."""

    def best(lo: int, hi: int) -> tuple[float, int]:
        gl, hl = np.cumsum(g[lo : hi - 1]), np.cumsum(h[lo : hi - 1])
        gs, hs = g[lo:hi].sum(), h[lo:hi].sum()
        gain = gl**2 / (hl + PENALTY) + (gs - gl) ** 2 / (hs - hl + PENALTY) - gs**2 / (hs + PENALTY)
        k = int(np.argmax(gain)) if len(gain) else 0
        return (float(gain[k]), lo + k + 1) if len(gain) else (0.0, lo)

    parts = [(0, len(g), *best(0, len(g)))]
    while len(parts) < leaves and max(p[2] for p in parts) > 1e-9:
        lo, hi, _, at = parts.pop(int(np.argmax([p[2] for p in parts])))
        parts += [(lo, at, *best(lo, at)), (at, hi, *best(at, hi))]
    out = np.zeros(len(g))
    for lo, hi, _, _ in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + PENALTY)
    return out


def cross(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The values of a grid from the best cut of one axis and, on either side, the best cut of the other; and its gain."""
    out, most = np.zeros_like(g), 0.0
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, len(a)):
            value, gain = np.zeros_like(a), 0.0
            for side in (slice(0, cut), slice(cut, None)):
                x, y = a[side].sum(axis=0), b[side].sum(axis=0)
                leaf = shallow_tree(x, y, 2)
                value[side] = leaf
                gain += float((x * leaf).sum() - 0.5 * ((y + PENALTY / len(y)) * leaf**2).sum())
            if gain > most:
                most, out = gain, value if axis == 0 else value.T
    return out, most


@dataclass
class Model:
    """Cuts and tables; ``pairs`` names the features of each two-dimensional table."""

    start: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables)):
            out += values[np.searchsorted(cuts, x[:, j], side="right")]
        bins = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for pair in self.pairs for j in pair}
        for (a, b), grid in zip(self.pairs, self.grids):
            out += grid[bins[a], bins[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of the chance that y is 1. Without rows, or with one class only, a constant."""
    rate = (float(y.sum()) + 0.5) / (len(y) + 1)
    model = Model(math.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        return model
    m = x.shape[1]
    quantiles = lambda j, n: np.unique(np.quantile(x[:, j], np.arange(1, n) / n, method="inverted_cdf"))
    model.cuts = [quantiles(j, BINS) for j in range(m)]
    model.coarse = [quantiles(j, PAIR_BINS) for j in range(m)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    f = np.full(len(y), model.start)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(m):
            g, h = slope()
            n = len(model.tables[j])
            step = RATE * shallow_tree(np.bincount(bins[j], g, n), np.bincount(bins[j], h, n))
            model.tables[j] += step
            f += step[bins[j]]
    small = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.coarse)]
    g, h = slope()

    def grid(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        cell = small[a] * shape[1] + small[b]
        sums = [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]
        return cross(*sums)

    ranked = sorted(((grid(a, b, g, h)[1], a, b) for a in range(m) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in ranked[:PAIRS] if gain > 0]
    model.grids = [np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            step = RATE * grid(a, b, *slope())[0]
            model.grids[k] += step
            f += step[small[a], small[b]]
    return model


def fold(ids: str) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(ids).cast("string").cast("binary")) % 3


def featured(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, x array<double>) of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        for batch in batches:
            for part in slices(batch):
                rows = [features(t or b"") for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id bigint, x array<double>")


def train(docs: DataFrame, labels: DataFrame, ids: str = "doc_id", text: str = "text", label: str = "quality", limit: int = MAX_SAMPLE) -> Model:
    """A model from at most ``limit`` labelled documents outside fold 1. Labels of an id that disagree count as their mean
    rounded up; null labels, labels without an id and labels without a document are left out; rows that repeat an id all
    count; null and empty texts have features too. Without documents or labels, or with one class only, the model is a
    constant. The driver gets ``limit`` rows of features, and as many more as their ids repeat."""
    known = labels.where(F.col(label).isNotNull() & (fold(ids) != 1)).groupBy(F.col(ids).cast("bigint").alias("doc_id")).agg(F.round(F.avg(label)).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select(F.col(ids).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    picked = rows.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")  # at most limit ids of 8 bytes
    got = featured(picked).join(F.broadcast(known), "doc_id").toPandas().sort_values("doc_id")
    x = np.array(got["x"].to_list(), dtype=np.float64).reshape(len(got), len(NAMES))
    return fit(x, got["y"].to_numpy(dtype=np.float64))


def scored(docs: DataFrame, model: Model, out: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with score_ (0 to 1), from the whole text; null texts count as empty, which have a score too.

    A map without shuffle. All columns of ``docs`` stay but a score_ of its own; repeated rows score alike; very long texts
    are read whole; an empty table gives no rows.
    """
    names = [c for c in docs.columns if c != "score_"]
    schema = docs.select(names).schema.add("score_", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        at = names.index(text)
        for batch in batches:
            for part in slices(batch, text):
                x = np.array([features(t or b"") for t in part.column(at).cast(pa.binary()).to_pylist()], dtype=np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(x.reshape(-1, len(NAMES))))], [*names, "score_"])

    return docs.select(names).mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with a score of ``threshold`` or more, with all of their columns; null ids, null and empty texts are
    scored like others, equal texts fare alike, and an empty table gives no rows."""
    return scored(docs, train(docs, labels)).where(F.col("score_") >= threshold).drop("score_")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold("doc_id") == 1, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), F.col("score_").alias("score"), (F.col("score_") >= 0.5).cast("int").alias("predicted"))
