"""Benchmark decontamination by a BM25 index of the test items.

The roles of search are turned round: the collection is the set of test items, and every passage of every training document
is a query. Scores are normalised by the score that an item gives itself, so the threshold is a share of its BM25 mass.
Retrieval is block-max WAND: a passage is dropped unless the bounds of its rare terms can lift some item to the threshold
(an item's frequent terms alone cannot, which is how much mass ``need`` takes from them); then the block maxima of its terms
tell the blocks of items in which the threshold can be reached; only those are scored. All items at or above it come out.
A hit counts when the passage also holds the item's question and its answer, or an item without these fields as a whole, by
word n-grams in order.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import Literal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, staged, table, worker_cache

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score from which it is retrieved.
THRESHOLD = 0.6
#: Share of the word n-grams of the question, and of the answer, that a passage must hold.
OVERLAP = 0.6
NGRAM = 3
#: BM25 mass of an item that its rare terms must supply in any passage that reaches the threshold.
RARE = 0.25
ITEMS_PER_BLOCK = 64
#: Items that one index holds; larger benchmarks are searched block of items by block of items.
MAX_ITEMS = 50_000
#: Characters of their text, about.
MAX_BYTES = 64_000_000
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def ngrams(x: list[str], n: int) -> set[tuple[str, ...]]:
    return set(zip(*(x[i:] for i in range(n))))


class Part:
    """The question or the answer of an item, and how much of it a passage holds."""

    def __init__(self, x: list[str]) -> None:
        self.n = min(NGRAM, len(x))
        self.grams = ngrams(x, self.n) if x else set()

    def overlap(self, passage: dict[int, set]) -> float:
        return len(self.grams & passage[self.n]) / len(self.grams) if self.grams else 1.0


#: Number of items, their mean length, the longest length, and document frequency by word.
Whole = tuple[int, float, int, dict[str, int]]


def statistics(items: list[tuple[int, list[str], list[str]]]) -> Whole:
    sizes = [len(q) + len(a) for _, q, a in items]
    return len(items), sum(sizes) / max(1, len(items)), max(sizes, default=1), Counter(w for _, q, a in items for w in {*q, *a})


class Index:
    """``items``: (id, question words, answer words), of at least one word together. ``whole`` has the statistics of all items
    where these are some of them."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]], threshold: float = THRESHOLD, whole: Whole | None = None) -> None:
        total, mean, self.stride, often = whole or statistics(items)
        self.threshold = threshold
        self.ids = [i for i, _, _ in items]
        self.parts = [(Part(q), Part(a)) for _, q, a in items]
        # an item without an answer is held, too, where both of its parts are
        self.thirds = [() if a else tuple(map(Part, split_item(q))) for _, q, a in items]
        bags = [q + a for _, q, a in items]
        names = sorted({w for b in bags for w in b})
        self.term = {w: t for t, w in enumerate(names)}
        cells: dict[tuple[int, int], int] = {}
        for i, bag in enumerate(bags):
            for w in bag:
                cells[self.term[w], i] = cells.get((self.term[w], i), 0) + 1
        keys = sorted(cells)
        t = np.array([k[0] for k in keys], dtype=np.int64)
        i = np.array([k[1] for k in keys], dtype=np.int64)
        tf = np.array([cells[k] for k in keys], dtype=np.float64)
        n, df = len(items), np.bincount(t, minlength=len(names))
        size = np.array([len(b) for b in bags], dtype=np.float64)
        held_by = np.array([often[w] for w in names], dtype=np.int64)
        weight = np.log1p((total - held_by + 0.5) / (held_by + 0.5))[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[i] / max(1.0, mean)))
        weight /= np.bincount(i, weights=weight, minlength=n)[i] if n else 1
        self.items, self.weights = i, weight
        self.first = np.concatenate(([0], np.cumsum(df)))
        # block maxima: by term, the blocks of items it occurs in, where its postings there start, and its largest weight
        block = i // ITEMS_PER_BLOCK
        opens = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (block[1:] != block[:-1])))) if len(t) else np.empty(0, dtype=np.int64)
        self.block_of, self.block_from = block[opens], np.append(opens, len(t))
        self.block_max = np.maximum.reduceat(weight, opens) if len(opens) else np.empty(0)
        self.block_first = np.searchsorted(opens, self.first)
        # rare terms of each item: rarest, then longest, until they hold what is left below the threshold, and RARE more
        length = np.array([len(w) for w in names])
        order = np.lexsort((-length[t], held_by[t], i))
        mass = np.cumsum(weight[order])
        starts = np.searchsorted(i[order], np.arange(n))
        before = mass - weight[order] - (mass - weight[order])[starts][i[order]] if n else mass
        rare = np.zeros(len(t), dtype=bool)
        rare[order] = before < 1 - threshold + RARE
        held = np.bincount(i[rare], weights=weight[rare], minlength=n)
        self.need = threshold - (1 - held) - 1e-9
        kept = np.flatnonzero(rare)
        self.rare_items, self.rare_weights = i[kept], weight[kept]
        self.rare_first = np.searchsorted(t[kept], np.arange(len(names) + 1))
        self.rare_term = {w: x for w, x in self.term.items() if self.rare_first[x + 1] > self.rare_first[x]}

    def passages(self, x: list[str]) -> list[int]:
        """Starts of the passages (two strides long, one apart) whose rare terms can lift an item to the threshold."""
        get = self.rare_term.get
        hits = [(p, t) for p, t in enumerate(map(get, x)) if t is not None]
        if not hits:
            return []
        pos, term = np.array(hits, dtype=np.int64).T
        count = self.rare_first[term + 1] - self.rare_first[term]
        at = np.repeat(self.rare_first[term] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        window, item, of = np.repeat(pos // self.stride, count), self.rare_items[at], np.repeat(term, count)
        window, item, of, at = (np.concatenate(z) for z in ((window, window - 1), (item, item), (of, of), (at, at)))
        # a term counts once a passage
        cell = (window + 1) * len(self.ids) + item
        order = np.lexsort((of, cell))
        cell, of, at = cell[order], of[order], at[order]
        once = np.concatenate(([True], (cell[1:] != cell[:-1]) | (of[1:] != of[:-1])))
        cells, inverse = np.unique(cell[once], return_inverse=True)
        bound = np.bincount(inverse, weights=self.rare_weights[at[once]])
        good = np.unique(cells[bound >= self.need[cells % len(self.ids)]] // len(self.ids) - 1)
        return [max(0, w) * self.stride for w in good.tolist()]

    def retrieve(self, passage: list[str]) -> list[tuple[int, float]]:
        """Items that score the threshold or more for a passage: (number, score)."""
        terms = np.array(sorted({t for w in passage if (t := self.term.get(w)) is not None}), dtype=np.int64)
        rows = np.concatenate([np.arange(self.block_first[t], self.block_first[t + 1]) for t in terms] or [np.empty(0, dtype=np.int64)])
        bound = np.bincount(self.block_of[rows], weights=self.block_max[rows])
        rows = rows[bound[self.block_of[rows]] >= self.threshold - 1e-9]
        at = np.concatenate([np.arange(self.block_from[r], self.block_from[r + 1]) for r in rows] or [np.empty(0, dtype=np.int64)])
        score = np.bincount(self.items[at], weights=self.weights[at])
        found = np.flatnonzero(score >= self.threshold - 1e-9)
        return [(i, float(score[i])) for i in found.tolist()]

    def search(self, text: str) -> list[tuple[int, float, float, float]]:
        """(item id, score, question overlap, answer overlap) of the items that a text holds; the best passage of each."""
        x = words(text)
        best: dict[int, tuple[float, float, float]] = {}
        for start in dict.fromkeys(self.passages(x)):
            passage = x[start : start + 2 * self.stride]
            grams: dict[int, set] = {}
            for i, score in self.retrieve(passage):
                for part in (*self.parts[i], *self.thirds[i]):
                    if part.n not in grams:
                        grams[part.n] = ngrams(passage, part.n)
                q, a = (part.overlap(grams) for part in self.parts[i])
                if q >= OVERLAP and a >= OVERLAP or self.thirds[i] and all(p.overlap(grams) >= OVERLAP for p in self.thirds[i]):
                    best[i] = max(best.get(i, (0.0, 0.0, 0.0)), (score, q, a))
        return [(self.ids[i], *v) for i, v in sorted(best.items())]


def split_item(x: list[str]) -> tuple[list[str], list[str]]:
    """An item in two parts: its first two thirds, and the rest."""
    at = len(x) - len(x) // 3
    return x[:at], x[at:]


def leaks(docs: DataFrame, benchmark: DataFrame, ids: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, score, question_overlap, answer_overlap): one per document row and test item that it holds.

    A map without shuffle over whole texts. Statistics are those of all items, counted as a table. An index holds about
    MAX_ITEMS items or MAX_BYTES of their text at most, which is what is broadcast at a time; a larger benchmark is dealt to
    blocks by hash and searched in several maps, with the same hits and scores. If ``benchmark`` has columns question and
    answer, those are taken; else the question is the whole item, and the answer, of no words, counts as held. Null and empty
    texts hold nothing; items without words are left out; equal items are all reported. An empty table on either side gives
    no rows. Very long texts are searched whole. Other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    parts = ("question", "answer") if {"question", "answer"} <= set(benchmark.columns) else (item_text, None)
    items = benchmark.select(F.col(item).cast("bigint").alias("id"), *(F.col(p).cast("string").alias(f"p{k}") if p else F.lit("").alias(f"p{k}") for k, p in enumerate(parts)))
    items = staged(items.mapInArrow(_worded, "id bigint, q array<string>, a array<string>"), "items")
    size = F.size("q") + F.size("a")
    letters = F.length(F.array_join("q", " ")) + F.length(F.array_join("a", " "))
    n, mean, longest, weight = items.agg(F.count(F.lit(1)), F.avg(size), F.max(size), F.sum(letters)).first()
    if not n:
        return spark.createDataFrame([], schema)
    blocks = max(-(-n // MAX_ITEMS), -(-weight // MAX_BYTES))
    items = items.withColumn("block", F.pmod(F.xxhash64("id", "q", "a"), F.lit(blocks)))
    held = items.select("block", F.explode(F.array_distinct(F.concat("q", "a"))).alias("word"))
    often = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    often = staged(often, "often") if blocks > 1 else often
    rows = docs.select(F.col(ids).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for k in range(blocks):
        own = often if blocks == 1 else often.join(held.where(F.col("block") == k), "word", "left_semi")
        listed = [(r.id, list(r.q), list(r.a)) for r in items.where(F.col("block") == k).collect()]
        listed.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2]))
        if listed:
            index = spark.sparkContext.broadcast((listed, (n, mean, longest, {r.word: r.n for r in own.collect()})))
            found = rows.mapInArrow(_searcher(index, uuid.uuid4().hex), schema)
            out = found if out is None else out.unionByName(found)
    return out


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items as words; those without any are left out."""
    kind = pa.list_(pa.string())
    for batch in batches:
        rows = [(i, words(q or ""), words(a or "")) for i, q, a in zip(*(c.to_pylist() for c in batch.columns))]
        rows = [r for r in rows if r[1] or r[2]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], kind)], ["id", "q", "a"])


def _searcher(items, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache(f"items {name}")
        if not kept:  # once for a worker, not for each of its tasks
            kept["index"] = Index(items.value[0], whole=items.value[1])
        index = kept["index"]
        names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        for batch in batches:
            for part in slices(batch):
                rows = [(d, *hit) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if t for hit in index.search(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, null_ids: Literal["keep", "judge"] = "keep") -> DataFrame:
    """``docs`` without the rows whose id holds a test item: an id goes with all of its rows.

    Rows with a null id all stay, or, with ``null_ids="judge"``, each goes or stays by its own text. Null and empty texts
    hold nothing; equal rows fare alike; very long texts are searched whole; an empty benchmark leaves all rows, an empty
    table gives none. Other columns stay, whatever their names but ``id_`` and ``hash_``.
    """
    gone = leaks(docs.where("doc_id is not null"), benchmark).select(F.col("doc_id").alias("id_")).distinct()
    left = docs.join(gone, F.col("doc_id").cast("bigint") == F.col("id_"), "left_anti").select(docs.columns)
    if null_ids == "keep":
        return left
    nameless = docs.where("doc_id is null").withColumn("hash_", F.xxhash64(F.col("text").cast("string")))
    gone = leaks(nameless, benchmark, ids="hash_").select(F.col("doc_id").alias("id_")).distinct()
    nameless = nameless.join(gone, F.col("hash_") == F.col("id_"), "left_anti").select(docs.columns)
    return left.where("doc_id is not null").unionByName(nameless)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
