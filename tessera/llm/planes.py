"""Token-id files of shuffled planes.

Ids are cut into blocks of a fixed number. A block of n ids is a matrix of n rows and 4 bytes (or 32 bits); its transpose
puts byte (bit) k of all ids side by side, and each such plane is compressed with zstandard on its own. High planes are
nearly constant and vanish; low planes keep no framing between ids. Behind the blocks stands an index: for each block its
place, its number of ids and the sizes of its planes, so any block is read without the others; then the documents.

    magic | planes of block 0 | planes of block 1 | ... | footer (zstd) | footer size u64 | magic
"""

from __future__ import annotations

import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Literal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, shared_path, slices, table, worker_cache
from .encode import encoder

MAGIC = b"TSPLANE1"
BLOCK = 1 << 16
#: Ids after which a file is closed. One file, compressed, is what a reading task holds in memory.
FILE_IDS = 1 << 22
#: Ids that a reading task restores at a time, one document at least.
READ_IDS = 1 << 18
LEVEL = 3


def transpose(ids: np.ndarray, plane: Literal["byte", "bit"]) -> list[bytes]:
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return [rows[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def restore(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        rows = np.stack([np.frombuffer(p, dtype=np.uint8, count=n) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").ravel()


def dump(ids: np.ndarray, docs: list[int | None], sizes: list[int], plane: Literal["byte", "bit"] = "byte", block: int = BLOCK) -> bytes:
    """A file with the ids of some documents, one after the other."""
    import zstandard

    press = zstandard.ZstdCompressor(level=LEVEL)
    out, places = io.BytesIO(MAGIC), []
    out.seek(len(MAGIC))
    for lo in range(0, len(ids), block):
        part = ids[lo : lo + block]
        packed = [press.compress(p) for p in transpose(part, plane)]
        places += [out.tell(), len(part), *map(len, packed)]
        out.write(b"".join(packed))
    n_planes = 4 if plane == "byte" else 32
    head = np.array([block, n_planes, len(places) // (2 + n_planes), len(docs)], dtype="<u8")
    valid = np.array([d is not None for d in docs], dtype=np.uint8)
    known = np.array([d or 0 for d in docs], dtype="<i8")
    footer = press.compress(b"".join(x.tobytes() for x in (head, np.array(places, dtype="<u8"), known, valid, np.array(sizes, dtype="<u8"))))
    out.write(footer + np.uint64(len(footer)).tobytes() + MAGIC)
    return out.getvalue()


class File:
    """A file read again: ``docs``, ``sizes`` and blocks of ids."""

    def __init__(self, data: bytes) -> None:
        import zstandard

        if data[:8] != MAGIC or data[-8:] != MAGIC:
            raise ValueError("not a plane file")
        self.data, self.zstd = data, zstandard.ZstdDecompressor()
        size = int(np.frombuffer(data[-16:-8], dtype="<u8")[0])
        raw = self.zstd.decompress(data[-16 - size : -16])
        self.block, self.planes, blocks, docs = np.frombuffer(raw, dtype="<u8", count=4).tolist()
        at = 32
        self.index = np.frombuffer(raw, dtype="<u8", count=blocks * (2 + self.planes), offset=at).reshape(blocks, 2 + self.planes)
        at += self.index.nbytes
        known = np.frombuffer(raw, dtype="<i8", count=docs, offset=at).tolist()
        valid = np.frombuffer(raw, dtype=np.uint8, count=docs, offset=at + 8 * docs).tolist()
        self.docs = [d if v else None for d, v in zip(known, valid)]
        self.sizes = np.frombuffer(raw, dtype="<u8", count=docs, offset=at + 9 * docs).astype(np.int64)

    def read(self, i: int) -> np.ndarray:
        at, n, *sizes = self.index[i].tolist()
        planes = []
        for s in sizes:
            planes.append(self.zstd.decompress(self.data[at : at + s]))
            at += s
        return restore(planes, n)

    def parts(self, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Consecutive documents (from, to) and their ids: about ``size`` ids at a time, one document at least."""
        ends = np.cumsum(self.sizes)
        lo, left, block = 0, np.empty(0, dtype="<u4"), 0
        while lo < len(self.docs):
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + size, side="right")))
            n, held = int(ends[hi - 1]) - before, [left]
            have = len(left)
            while have < n:
                held.append(self.read(block))
                have, block = have + len(held[-1]), block + 1
            ids = np.concatenate(held)
            yield lo, hi, ids[:n]
            lo, left = hi, ids[n:].copy()

    def ids(self) -> np.ndarray:
        return np.concatenate([self.read(i) for i in range(len(self.index))] or [np.empty(0, dtype="<u4")])


def write_ids(docs: DataFrame, path: str, out: str, end_id: int, cut: Literal["space", "white"] = "space", ids: str = "doc_id", text: str = "text", plane: Literal["byte", "bit"] = "byte") -> list[dict]:
    """Writes the ids of all texts in ascending id order (nulls first, equal ids by their text) to files below ``out``.

    Null and empty texts consist of the end id. One shuffle, by range of (id, hash of the text), so neither a hot source
    nor an id with very many rows lands in one task. A task closes a file every FILE_IDS ids under a name that no other
    attempt uses; only files that finished tasks report count, so lost executors leave no double. Returns the list of files
    in order: file, start (ids before it), n_docs, n_ids; its length is the corpus size over FILE_IDS, plus the tasks.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        encode, end = encoder(path, cut), np.array([end_id], dtype="<u4").tobytes()
        # Spark's names of one store that goes by another name here
        fs, root = pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", out))
        part, seq = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        held, owners, sizes = [], [], []

        def close() -> None:
            nonlocal seq, held, owners, sizes
            if owners:
                data = np.frombuffer(b"".join(held), dtype="<u4")
                name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.planes"
                fs.create_dir(root, recursive=True)
                with fs.open_output_stream(f"{root}/{name}") as f:
                    f.write(dump(data, owners, sizes, plane))
                rows.append((part, seq, name, len(owners), len(data)))
                held, owners, sizes, seq = [], [], [], seq + 1

        full = 0
        for batch in batches:
            for x in slices(batch):
                for doc, got in zip(x.column(0).to_pylist(), encode(x.column(1))):
                    got += end
                    held.append(got)
                    owners.append(doc)
                    sizes.append(len(got) // 4)
                    full += sizes[-1]
                    if full >= FILE_IDS:
                        close()
                        full = 0
        close()
        released()
        names = ["part", "seq", "file", "n_docs", "n_ids"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col(ids).cast("bigint").alias("id"), F.col(text).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc()]
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    files = sorted(rows.mapInArrow(run, "part int, seq int, file string, n_docs bigint, n_ids bigint").collect(), key=lambda r: (r.part, r.seq))
    start, listed = 0, []
    for r in files:
        listed.append({"file": f"{out}/{r.file}", "start": start, "n_docs": r.n_docs, "n_ids": r.n_ids})
        start += r.n_ids
    return listed


def documents(data: bytes, start: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, start, n_tokens, ids) of a file, READ_IDS ids at a time; ``start``: the ids before it."""
    worker_cache()  # this worker may have written, and its encoder is of no use here
    file = File(data)
    for lo, hi, ids in file.parts(READ_IDS):
        sizes = file.sizes[lo:hi]
        ends = np.cumsum(sizes)
        offsets = np.concatenate(([0], ends * 4)).astype(np.int32)
        raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(file.docs[lo:hi], pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), raw], ["doc_id", "start", "n_tokens", "ids"])
        start += int(ends[-1])


def read_ids(spark: SparkSession, files: list[dict]) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids binary) of all documents in the files, by any store that Spark reads."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    if not files:
        return spark.createDataFrame([], schema)
    starts = {f["file"].rpartition("/")[2]: f["start"] for f in files}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from documents(batch.column(1)[i].as_py(), starts[batch.column(0)[i].as_py().rpartition("/")[2]])
        released()

    return spark.read.format("binaryFile").load([f["file"] for f in files]).select("path", "content").mapInArrow(run, schema)


def op3_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), shared_path(spark, "ids"), end_id=2)
    return read_ids(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
