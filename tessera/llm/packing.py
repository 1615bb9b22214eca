"""Packing by lexical retrieval.

One BM25 ranking over token ids holds for the whole table: document frequencies and the mean length are counted over all
documents first. Documents are dealt to the shards of the index by content: the signs of a document's BM25 vector along the
main axes of a bounded sample make its cell, and cells, in order, are cut into shards of ``SHARD_IDS`` ids, so documents of one
language or topic, and copies above all, meet in one shard. In each shard seeds are opened one after the other, each asks the
shard's inverted index by all of its terms, and the unused neighbours fill its window in order of their score; the last one is
cut to fit, and its rest stays unused. Of the ids that fill no window at the end of a shard, sequences of a power of two are
made, which need no padding.

A seed asks the shard that its content leads to and no other, so the work is in proportion to the input. README tells the share of
the best neighbours that lie in other shards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, slices, staged, table
from .encode import encoder

WINDOW = 2048
#: Ids of a shard of the index: what a task holds at a time.
SHARD_IDS = 3_000_000
#: Terms of a seed whose postings are added up at a time.
QUERY_TERMS = 256
#: Seeds whose scores are computed at a time.
SEEDS = 32
#: Share of an index's documents after whose use their postings are dropped.
STALE = 1 / 8
#: Terms that more than this share of a shard's documents hold have a row of impacts for all of them in place of postings.
DENSE = 1 / 16
#: Signs that make a cell, and so at most 2^16 cells; a cell of more than a shard is cut by a hash.
BITS = 16
#: Documents that the axes are fitted on (those of the least hash), and dimensions that terms are hashed to for it.
SAMPLE, DIMENSIONS = 2048, 4096
#: Tasks that pack shards, at most.
TASKS = 20_000
K1, B = 1.2, 0.75
PIECES = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("hash", pa.int64()), ("ids", pa.binary())])
OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
OUT_DDL = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def cells(docs: list[np.ndarray], by_doc: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, occurrences) of the ids of documents, by term and document, or by document and term."""
    flat = np.concatenate(docs).astype(np.int64) if docs else np.empty(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    if by_doc:
        doc <<= 32
    else:
        flat <<= 32
    flat |= doc
    flat.sort()
    opens = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.empty(0, dtype=np.int64)
    tf = np.diff(np.append(opens, len(flat))).astype(np.int32)
    flat = flat[opens]
    high, low = (flat >> 32).astype(np.int32), (flat & 0xFFFFFFFF).astype(np.int32)
    return (low, high, tf) if by_doc else (high, low, tf)


def holders(docs: list[np.ndarray]) -> np.ndarray:
    """The number of documents that hold an id, by id."""
    flat = np.concatenate(docs).astype(np.int64) if docs else np.empty(0, dtype=np.int64)
    place, last = np.arange(len(flat)), np.zeros(int(flat.max(initial=-1)) + 1, dtype=np.int64)
    counts, lo = np.zeros(len(flat), dtype=bool), 0
    for hi in np.cumsum([len(d) for d in docs], dtype=np.int64).tolist():
        # of the places of an id in a document one stays, and that one counts
        last[flat[lo:hi]] = place[lo:hi]
        counts[lo:hi] = last[flat[lo:hi]] == place[lo:hi]
        lo = hi
    return np.bincount(flat[counts], minlength=len(last))


def impact(idf: np.ndarray, tf: np.ndarray, size: np.ndarray, mean: float) -> np.ndarray:
    return (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.maximum(size, 1) / max(1.0, mean)))).astype(np.float32)


def rarity(total: int, df: np.ndarray) -> np.ndarray:
    return np.log1p((total - df + 0.5) / (df + 0.5))


class Index:
    """BM25 over the ids of a shard's documents: impacts of frequent terms in a matrix, those of others in postings.

    ``whole`` has the statistics of all shards: number of documents, their mean length, and document frequency by term.
    """

    def __init__(self, docs: list[np.ndarray], whole: tuple[int, float, np.ndarray] | None = None) -> None:
        n = len(docs)
        #: Numbers of the documents that are still there, by column.
        self.held = np.arange(n)
        size = np.array([len(d) for d in docs], dtype=np.int64)
        term, doc, tf = cells(docs)
        opens = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.empty(0, dtype=np.int64)
        posting = np.append(opens, len(term))
        self.df = np.diff(posting)
        number = np.repeat(np.arange(len(self.df), dtype=np.int32), self.df)
        total, mean, df = whole or (n, size.mean() if n else 1, None)
        idf = rarity(total, self.df if df is None else df[term[opens]])
        weight = impact(idf[number], tf, size[doc], mean)
        del term, tf
        by_doc = np.argsort(doc, kind="stable")
        self.terms = number[by_doc]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))
        del by_doc
        frequent = self.df > max(1, DENSE * n)
        #: Row of a frequent term in the matrix, else -1.
        self.row = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.matrix = np.zeros((int(frequent.sum()), n), dtype=np.float32)
        dense = frequent[number]
        self.matrix[self.row[number[dense]], doc[dense]] = weight[dense]
        self.posting = np.concatenate(([0], np.cumsum(~dense)))[posting]
        self.posting_doc, self.posting_weight = doc[~dense], weight[~dense]

    def scores(self, seeds: list[int]) -> np.ndarray:
        """Scores of the documents held, a row for each seed, by all terms that it shares with others."""
        query, n = np.zeros((len(seeds), len(self.matrix)), dtype=np.float32), len(self.held)
        rest = []
        for k, i in enumerate(seeds):
            terms = self.terms[self.first[i] : self.first[i + 1]]
            terms = terms[self.df[terms] > 1]
            row = self.row[terms]
            query[k, row[row >= 0]] = 1
            rest.append(terms[row < 0])
        out = query @ self.matrix
        for k, terms in enumerate(rest):
            for lo in range(0, len(terms), QUERY_TERMS):
                at = [slice(a, b) for a, b in zip(*(self.posting[terms[lo : lo + QUERY_TERMS] + e].tolist() for e in (0, 1)))]
                docs, weight = (np.concatenate([x[s] for s in at]) for x in (self.posting_doc, self.posting_weight))
                out[k] += np.bincount(docs, weights=weight, minlength=n)
        return out

    def best(self, score: np.ndarray, first: int = 64) -> Iterator[int]:
        """Documents of a score above 0, best first, ties by number."""
        n = len(score)
        if n > first:
            some = np.flatnonzero(score >= np.partition(score, n - first)[n - first])
            some = some[np.argsort(-score[some], kind="stable")]
            some = some[score[some] > 0]
            yield from self.held[some].tolist()
            rest = np.flatnonzero((score > 0) & (score < score[some[-1]])) if len(some) else some
        else:
            rest = np.flatnonzero(score > 0)
        yield from self.held[rest[np.argsort(-score[rest], kind="stable")]].tolist()

    def neighbours(self, i: int) -> np.ndarray:
        """Documents that share terms with the seed, best first by all of them, ties by number."""
        return np.array(list(self.best(self.scores([i])[0])), dtype=np.int64)

    def drop(self, used: np.ndarray) -> None:
        """Used documents go; the scores of others stay as they are."""
        keep = ~used[self.held]
        at = (np.cumsum(keep) - 1).astype(np.int32)
        stays = keep[self.posting_doc]
        self.posting = np.concatenate(([0], np.cumsum(stays)))[self.posting]
        self.posting_doc, self.posting_weight = at[self.posting_doc[stays]], self.posting_weight[stays]
        self.matrix, self.held = self.matrix[:, keep], self.held[keep]


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, whole: tuple[int, float, np.ndarray] | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every id of ``docs`` once: packing of documents in memory, one
    seed after the other, in the order given."""
    at = [0] * len(docs)  # where the unused rest of each document starts
    for i, d in enumerate(docs):
        while len(d) - at[i] >= window:
            yield [(i, at[i], window)]
            at[i] += window
    left = [len(d) - a for d, a in zip(docs, at)]
    total, seed = sum(left), 0
    if total >= window:
        index = Index([d[a:] for d, a in zip(docs, at)], whole)
    used, kept = 0, sum(1 for n in left if n)  # since the last drop
    scored: dict[int, np.ndarray] = {}  # of the seeds to come, by the columns of the index as it is
    while total >= window:
        while not left[seed]:
            seed += 1
        if seed not in scored:
            if used > STALE * kept:
                index.drop(np.array(left) == 0)
                used, kept = 0, kept - used
            coming, i = [], seed
            while i < len(left) and len(coming) < SEEDS:
                if left[i]:
                    coming.append(i)
                i += 1
            scored = dict(zip(coming, index.scores(coming)))
        pieces, room = [], window

        def take(i: int) -> None:
            nonlocal room, total, used
            n = min(left[i], room)
            pieces.append((i, at[i], n))
            at[i] += n
            left[i] -= n
            room -= n
            total -= n
            used += not left[i]

        take(seed)
        for j in index.best(scored.pop(seed)) if room else ():
            if left[j]:
                take(j)
                if not room:
                    break
        j = seed
        while room:  # no neighbour is left: the next documents in order
            if left[j]:
                take(j)
            j += 1
        yield pieces
    rest = [(i, at[i], n) for i, n in enumerate(left) if n]
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        pieces = []
        while room:
            i, start, n = rest.pop()
            some = min(n, room)
            pieces.append((i, start, some))
            room -= some
            if some < n:
                rest.append((i, start + some, n - some))
        yield pieces


def binaries(flat: np.ndarray, count: np.ndarray) -> pa.Array:
    """Consecutive parts of an array of ids, by their numbers of ids, without a copy of them."""
    ends = np.concatenate(([0], np.cumsum(count) * flat.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])


def width(path: str) -> str:
    """The type of ids in staged tables: two bytes where the vocabulary allows it."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str, end_id: int, window: int, kind: str) -> DataFrame:
    """Rows (key, doc_id, start, length, doc_tokens, hash, ids): the whole windows of each document, and what is left of it.

    key: the partition, and the place of the first id in it; unique. hash: of id and ids, and, where a partition holds equal
    rows, of their number there, so that very many equal rows do not fall into one shard. ids: of numpy type ``kind``.
    """
    import xxhash
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, key, seen = encoder(path, "white"), TaskContext.get().partitionId() << 40, Counter()
        for batch in batches:
            for x in slices(batch):
                ids, count = encode.flat(x.column(1))
                tokens = count + 1
                ends = np.cumsum(tokens)
                flat = np.full(int(ends[-1]), end_id, dtype=kind)
                own = np.ones(len(flat), dtype=bool)
                own[ends - 1] = False
                flat[own] = ids
                marks, raw = [], memoryview(flat).cast("B")
                for doc, lo, hi in zip(x.column(0).to_pylist(), ((ends - tokens) * flat.itemsize).tolist(), (ends * flat.itemsize).tolist()):
                    mark = xxhash.xxh64_intdigest(raw[lo:hi], 0 if doc is None else 1 + doc % ((1 << 64) - 1))
                    seen[mark] += 1
                    if seen[mark] > 1:
                        mark = xxhash.xxh64_intdigest(b"%d %d" % (mark, seen[mark]))
                    marks.append(mark - (1 << 63))
                pieces = -(-tokens // window)
                of = np.repeat(np.arange(len(tokens)), pieces)
                start = window * (np.arange(len(of)) - (np.cumsum(pieces) - pieces)[of])
                length = np.minimum(window, tokens[of] - start)
                columns = [key + (ends - tokens)[of] + start, x.column(0).take(pa.array(of)), start, length, tokens[of], np.array(marks, dtype=np.int64)[of], binaries(flat, length)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=PIECES)
                key += len(flat)
        released()

    return docs.mapInArrow(run, "key bigint, doc_id bigint, start bigint, length bigint, doc_tokens bigint, hash bigint, ids binary")


def frequencies(pool: DataFrame, kind: str) -> np.ndarray:
    """The number of documents that hold an id, by id; the driver gets one count for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for x in slices(batch, "ids"):
                some = holders([np.frombuffer(i, dtype=kind) for i in x.column(0).to_pylist()])
                if len(some) > len(seen):
                    seen = np.append(seen, np.zeros(len(some) - len(seen), dtype=np.int64))
                seen[: len(some)] += some
        terms = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(seen[terms])], ["term", "df"])

    rows = pool.select("ids").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(max((r.term for r in rows), default=-1) + 1, dtype=np.int64)
    df[[r.term for r in rows]] = [r.df for r in rows]
    return df


class Axes:
    """Cells of documents by the signs of their BM25 vectors along the main axes of a sample, the widest first."""

    def __init__(self, sample: list[np.ndarray], whole: tuple[int, float, np.ndarray], bits: int = BITS) -> None:
        total, self.mean, df = whole
        idf = rarity(total, df)
        rng = np.random.default_rng(0)
        place, sign = rng.integers(0, DIMENSIONS, size=len(df)), rng.choice(np.float32([-1, 1]), size=len(df))
        term, doc, weight = self.vectors(sample, idf)
        x = np.zeros((len(sample), DIMENSIONS), dtype=np.float32)
        np.add.at(x, (doc, place[term]), weight * sign[term])
        x -= x.mean(axis=0)
        axes = rng.standard_normal((DIMENSIONS, bits)).astype(np.float32)
        for _ in range(8):  # subspace iteration
            axes, _ = np.linalg.qr(x.T @ (x @ axes))
        axes = axes[:, np.argsort(-np.square(x @ axes).sum(axis=0), kind="stable")]
        self.idf = idf.astype(np.float32)
        #: Of each term, what it adds along each axis.
        self.axes = (axes[place] * sign[:, None]).astype(np.float32)
        self.middle = np.zeros(bits, dtype=np.float32)
        self.middle = np.median(self.along(sample), axis=0)

    def vectors(self, docs: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms, documents and impacts by document, those of each as a vector of length 1."""
        term, doc, tf = cells(docs, by_doc=True)
        weight = impact(idf[term], tf, np.array([len(d) for d in docs], dtype=np.int64)[doc], self.mean)
        length = np.sqrt(np.bincount(doc, weights=np.square(weight), minlength=len(docs)))
        return term, doc, weight / length[doc].astype(np.float32)

    def along(self, docs: list[np.ndarray]) -> np.ndarray:
        term, doc, weight = self.vectors(docs, self.idf)
        starts = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(docs)))))
        out = np.zeros((len(docs), self.axes.shape[1]), dtype=np.float32)
        for i, (a, b) in enumerate(zip(starts.tolist(), starts[1:].tolist())):
            out[i] = weight[a:b] @ self.axes[term[a:b]]
        return out

    def cells(self, docs: list[np.ndarray]) -> np.ndarray:
        side = (self.along(docs) > self.middle).astype(np.int64)
        return side @ (1 << np.arange(side.shape[1] - 1, -1, -1, dtype=np.int64))


def routed(rests: DataFrame, whole: tuple[int, float, np.ndarray], kind: str) -> DataFrame:
    """``rests`` as a staged table, with the cell of each row."""
    spark = rests.sparkSession
    # so low a hash that twice the sample is expected below it, lest every task sorts and sends a sample of its own
    low = int((1 << 64) * min(1.0, 2 * SAMPLE / whole[0])) - (1 << 63)
    few = rests.where(F.col("hash") <= min(low, (1 << 63) - 1)).orderBy("hash", "ids").limit(SAMPLE).select("ids")
    sample = [np.frombuffer(r.ids, dtype=kind) for r in few.collect()]
    axes = spark.sparkContext.broadcast(Axes(sample, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in slices(batch, "ids"):
                cell = axes.value.cells([np.frombuffer(i, dtype=kind) for i in x.column("ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([*x.columns, pa.array(cell)], [*x.schema.names, "cell"])
        released()

    columns = rests.select("key", "doc_id", "start", "length", "doc_tokens", "hash", "ids")
    return staged(columns.mapInArrow(run, "key bigint, doc_id bigint, start bigint, length bigint, doc_tokens bigint, hash bigint, ids binary, cell bigint"), "routed")


def shards(rests: DataFrame) -> tuple[DataFrame, int]:
    """``rests`` with a column shard, and the number of shards: cells in order, cut where a shard is full.

    The driver gets the ids of each cell, at most 2^16 numbers; a cell that lies in several shards is dealt by hash.
    """
    spark, before, rows = rests.sparkSession, 0, []
    for r in sorted(rests.groupBy("cell").agg(F.sum("length").alias("n")).collect(), key=lambda r: r.cell):
        rows.append((r.cell, before, r.n))
        before += r.n
    starts = F.broadcast(spark.createDataFrame(rows, "cell bigint, before bigint, n bigint"))
    share = F.pmod("hash", F.lit(1 << 32)) / float(1 << 32)
    shard = F.floor((F.col("before") + F.col("n") * share) / SHARD_IDS)
    return rests.join(starts, "cell").withColumn("shard", shard.cast("int")).drop("cell", "before", "n"), -(-before // SHARD_IDS)


def pack(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of all pieces of all documents.

    A document gives whole windows first; its rest is a seed or a neighbour. Shards, seeds and scores depend on ids and texts
    alone, whatever the input splits (equal rows apart, which are dealt by their number in a split). ``window`` is a power of
    two. Null and empty texts are a document of the end id alone; long texts are cut into windows; null ids are kept; equal
    rows are packed like others, each on its own; ties of score go by hash; other columns are left out, whatever their names;
    an empty table gives no rows. Sequence numbers are unique.
    """
    spark, kind = docs.sparkSession, width(path)
    rows = docs.select(F.col(ids).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = staged(encoded(rows, path, end_id, window, kind), "pieces")

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("ids")
            ends = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1] // np.dtype(kind).itemsize
            flat = np.frombuffer(raw.buffers()[2] or b"", dtype=kind)[ends[0] : ends[-1]].astype("<u4")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], binaries(flat, np.diff(ends))], schema=OUT)

    whole_windows = rows.where(F.col("length") == window)
    out = whole_windows.select("doc_id", "start", "length", "doc_tokens", F.col("key").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), "ids").mapInArrow(wide, OUT_DDL)
    rests = rows.where(F.col("length") < window)
    count, total = rests.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    if not count:
        return out
    stats = (count, total / count, frequencies(rests, kind))
    whole = spark.sparkContext.broadcast(stats)
    dealt, n = shards(routed(rests, stats, kind))
    tasks = min(n, TASKS)  # a task takes its shards one after the other
    dealt = dealt.repartitionById(tasks, F.floor(F.col("shard") * tasks / n).cast("int")).sortWithinPartitions("shard", "hash", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(got: list[tuple]) -> pa.RecordBatch:
            *columns, parts = zip(*got)
            flat = np.concatenate(parts).astype("<u4")
            return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, OUT)), binaries(flat, np.array(columns[2]))], schema=OUT)

        def sequences(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            got: list[tuple] = []
            docs = [np.frombuffer(r[5], dtype=kind) for r in held]
            for pieces in pack_shard(docs, window, whole.value):
                seq, offset = held[pieces[0][0]][0] + pieces[0][1], 0
                for i, at, n in pieces:
                    _, doc, start, _, tokens, _, _ = held[i]
                    got.append((doc, start + at, n, tokens, seq, offset, docs[i][at : at + n]))
                    offset += n
                if len(got) >= 4096:
                    yield batch_of(got)
                    got.clear()
            if got:
                yield batch_of(got)

        held: list[tuple] = []
        full = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                # shards are equal but for chance; what is over twice the size would be a shard of its own
                if held and (row[6] != held[-1][6] or full >= 2 * SHARD_IDS):
                    yield from sequences(held)
                    held, full = [], 0
                held.append(row)
                full += row[3]
        if held:
            yield from sequences(held)
        released()

    return out.unionByName(dealt.select("key", "doc_id", "start", "length", "doc_tokens", "ids", "shard").mapInArrow(run, OUT_DDL))


def packed(docs: DataFrame) -> DataFrame:
    """Digest rows of ``pack`` under the production parameters; odd rows as told there."""
    import public_tokenizers

    rows = pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
