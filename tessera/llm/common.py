"""What the operators of this package share: reading tables, shared storage, text batches and connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python task holds as objects at a time, beside the Arrow batch it was given.
SLICE_CHARS = 8_000_000
#: Temporary folders of local sessions that name no shared one.
_LOCAL: dict[str, str] = {}
#: Tables that this driver has staged.
_STAGED: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is taken, in local mode only: there driver and executors are one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="tessera-"))
    return root.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts lineage, and outlives any executor."""
    path = shared_path(df.sparkSession, what)
    _STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_staged(spark: SparkSession, since: int = 0, keep: Iterable[str] = ()) -> int:
    """Deletes the tables staged so far, from number ``since`` on. To be called when the results that read them have been
    written."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    gone = 0
    for name in [x for x in _STAGED[since:] if x not in keep]:
        _STAGED.remove(name)
        at = path(name)
        gone += at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return gone


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., None]]:
    """Tables staged inside go at its end, but those of the frames that were handed to what it gives."""
    since, kept = len(_STAGED), set()
    yield lambda *frames: kept.update(x for f in frames for x in ([f.staged_at] if hasattr(f, "staged_at") else []))
    drop_staged(spark, since, kept)


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when its action ends, not when the driver next collects its garbage. For chains of
    staged tables, of which no action needs the shuffles of another."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_CACHES: dict[str, dict] = {}


def worker_cache(name: str | None = None) -> dict:
    """What a Python worker keeps between tasks under ``name``. Workers serve one operator after the other, so what others
    have kept is let go."""
    for k in [k for k in _CACHES if k != name]:
        del _CACHES[k]
    return _CACHES.setdefault(name, {}) if name else {}


def released() -> None:
    """Gives memory that a task has freed back to the system; to be called at the end of tasks that held much."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # no such call in this C library
        pass


def slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``size`` bytes of text each (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    part = np.cumsum(sizes) // size
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)] if len(sizes) else []
    for lo, hi in zip(bounds, bounds[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges``, as rows (node, component) with the least node as component.

    Alternates large-star and small-star steps, each a partial minimum by key and an equi-join that adaptive execution
    can split, so a node with very many edges costs no more than its edges. Every round is a table in the shared folder.
    Nulls and self-loops are dropped; no edges give no rows. Nodes may be numbers or strings.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    spark = edges.sparkSession
    e = staged(e, "edges")

    def mark(x: DataFrame) -> tuple:
        # the sum of row hashes tells whether a round changed the edge set
        return tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(e)
    for _ in range(rounds if seen[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.withColumnRenamed("m", "v")).distinct()
        old, e = e.staged_at, staged(small, "edges")
        drop_staged(spark, keep=[x for x in _STAGED if x != old])
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    out.staged_at = e.staged_at
    return out
