"""Near-duplicate documents by bottom-k sketches.

One hash function orders all word shingles; a document keeps its K least values. Documents with equal sets form a class, and
only classes go on. Inverted lists of retained values propose pairs, the sketch of the union estimates their similarity, and
full sets confirm it; connected components of confirmed links are the groups.

*No link is lost to frequent values.* Two sets with a similarity of 0.75 or more share at least MIN_SHARED of their K least
values, but for a chance of 1.5 in a million at the threshold itself (there the number is binomial with mean 24). Values
are ranked from rare to frequent, and a class enters only the lists of its ``K - MIN_SHARED + 1`` rarest ones: if two share
MIN_SHARED values, they meet in one of those (the prefix filter). A passage that many documents hold is frequent, so its
lists stay empty unless a document hardly holds anything else. Sets below K values are kept whole and the bound is exact.
With ``exact`` all sets are kept whole, so that no link is left to chance, at the price of a list entry for a quarter of all
shingles in place of 21 a document.

*No list is expanded into all of its pairs.* First each list links its members with its most typical one. Where that joins
the list to one component, nothing is left. From other lists go the members that hold too few shingles of others for any
link (``able``). What remains is compared in blocks of bounded size, by sketches and then by full sets, and a block tells no
more links than join its components.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Literal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, freed_shuffles, scratch, slices, staged, table, worker_cache

WORDS = 5
K = 32
#: Retained values that similar sets share at least; see above.
MIN_SHARED = 12
#: Members of a list that are compared with one another in one task.
BLOCK = 512
#: Values that a comparison of a block takes up at a time.
COLUMNS = 4096
#: Bytes of text that are hashed at a time, at about 50 bytes of arrays each.
SLICE = 2_000_000
#: 64-bit words of the map of bits that ``marked`` broadcasts, at most.
MAP_WORDS = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20_240_601))
_BYTE = _rng.integers(0, 2**64, size=256, dtype=np.uint64)
_PLACE = _rng.integers(0, 2**64, size=WORDS, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 2 * len(_POWERS)), _BASE, dtype=np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 63-bit hashes of the word shingles of each text: A-Z lower-cased, words parted by ASCII white space.

    A text of fewer words is one shingle; one without words has none.
    """
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    visible = ~_WHITE[data]
    opens = visible.copy()
    opens[1:] &= ~visible[:-1]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return [np.empty(0, dtype=np.int64)] * len(texts)
    at = np.flatnonzero(visible)
    first = np.flatnonzero(opens[at])
    size = np.diff(np.append(first, len(at)))
    within = at - np.repeat(starts, size)
    word = mix(np.add.reduceat(_BYTE[data[at]] * powers(int(size.max()))[within], first) + size.astype(np.uint64))
    bound = np.concatenate(([0], np.searchsorted(starts, ends)))
    n = len(word)
    rows = np.zeros(max(0, n - WORDS + 1), dtype=np.uint64)
    for j in range(WORDS if len(rows) else 0):
        rows += word[j : n - WORDS + 1 + j] * _PLACE[j]
    rows = (mix(rows) >> np.uint64(1)).astype(np.int64)
    out = []
    for lo, hi in zip(bound[:-1].tolist(), bound[1:].tolist()):
        if hi - lo >= WORDS:
            out.append(np.unique(rows[lo : hi - WORDS + 1]))
        elif hi > lo:
            few = (word[lo:hi] * _PLACE[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            out.append((mix(np.array([few])) >> np.uint64(1)).astype(np.int64))
        else:
            out.append(np.empty(0, dtype=np.int64))
    return out


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share: sums of two scrambles, modulo 2**64."""
    x = values.astype(np.uint64)
    pair = np.array([mix(x + _BASE).sum(dtype=np.uint64), mix(x ^ _PLACE[0]).sum(dtype=np.uint64)])
    return tuple(pair.view(np.int64).tolist())


def texts_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sketches(docs: DataFrame, exact: bool = False) -> DataFrame:
    """Rows (doc_id, hash, n, k1, k2, sketch): size, key and K least values of each document's set, or, if exact, all of them;
    null keys for empty sets.

    ``docs`` has rows (doc_id, text, hash), the last one of the text.
    """
    k = None if exact else K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        for batch in batches:
            for part in slices(batch, size=SLICE):
                sets = shingles(texts_of(part.column(1)))
                keys = [set_key(s) if len(s) else (None, None) for s in sets]
                n = pa.array([len(s) for s in sets], pa.int64())
                small = [s[:k] for s in sets]
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in small]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(small or [np.empty(0, np.int64)]), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), n, pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), lists], ["doc_id", "hash", "n", "k1", "k2", "sketch"])

    return docs.mapInArrow(run, "doc_id bigint, hash bigint, n bigint, k1 bigint, k2 bigint, sketch array<bigint>")


def shared_at_least(size: Column, exact: bool) -> Column:
    """How many retained values a set whose sketch has ``size`` values shares with any similar one, at least."""
    least = F.ceil(size * 0.75).cast("int")
    return least if exact else F.least(F.lit(MIN_SHARED), least)


def lists(classes: DataFrame, exact: bool = False) -> DataFrame:
    """Rows (value, rep, n, typical) of the inverted lists that a class enters, lists of one member left out.

    typical: how frequent a class's values are in all; in a group of edited copies the original has the most.
    """
    postings = classes.select("rep", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    # a table of its own, else the join shares the aggregate's partitions and no hot value can be split
    often = staged(postings.groupBy("value").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "often")
    shared = postings.join(often, "value")
    own = shared.groupBy("rep", "n", "size").agg(F.sort_array(F.collect_list(F.struct("f", "value"))).alias("values"), F.sum("f").alias("typical"))
    # values that no other class retains are the rarest; they take places in the prefix, but propose no pair
    alone = F.col("size") - F.size("values")
    take = F.col("size") - shared_at_least(F.col("size"), exact) + 1 - alone
    own = own.where(take > 0).select("rep", "n", "typical", F.explode(F.slice("values", F.lit(1), take)).alias("x"))
    return own.select(F.col("x.value").alias("value"), "rep", "n", "typical")


def plausible(pairs: DataFrame, classes: DataFrame, exact: bool = False) -> DataFrame:
    """The pairs (a, b) that the sketch of their union leaves possible."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)")
    union = F.array_sort(F.array_union("s_a", "s_b"))
    both = both.withColumn("u", union if exact else F.slice(union, 1, K))
    hits = F.size(F.array_intersect("u", F.array_intersect("s_a", "s_b")))
    return both.where(hits >= shared_at_least(F.size("u"), exact)).select("a", "b")


def marked(rows: DataFrame, key: list[str], wanted: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose ``key`` (bigints) is that of a row of ``wanted`` under ``by``, and few others: none of ``rows`` is shuffled.

    A broadcast map has 16 bits and more for each wanted row, up to MAP_WORDS words; of more wanted rows more others come out,
    but no wanted one is ever left out. Nulls equal nulls.
    """
    words = min(MAP_WORDS, 1 << (wanted.count() // 4).bit_length())
    word, bit = F.col("at").bitwiseAND(F.lit(words - 1)), F.expr("shiftleft(1L, cast(shiftrightunsigned(at, 58) as int))")
    marks = wanted.select(F.xxhash64(*by).alias("at")).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("marks"))
    found = rows.withColumn("at", F.xxhash64(*key)).withColumn("word", word).join(F.broadcast(marks), "word")
    return found.where(F.col("marks").bitwiseAND(bit) != 0).select(rows.columns)


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (rep, set) of the classes ``wanted`` (rep, least, of, k1, k2), made anew from a text of each: that of id ``least``
    and hash ``of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        for batch in batches:
            for part in slices(batch, size=SLICE):
                sets = shingles(texts_of(part.column(1)))
                want = list(zip(part.column(2).to_pylist(), part.column(3).to_pylist()))
                # of rows that share an id and a hash, only those of the class
                rows = [i for i, (x, w) in enumerate(zip(sets, want)) if set_key(x) == w]
                offsets = np.concatenate(([0], np.cumsum([len(sets[i]) for i in rows]))).astype(np.int32)
                values = np.concatenate([sets[i] for i in rows] or [np.empty(0, np.int64)])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["rep", "set"])

    wanted = staged(wanted, "wanted")
    rows = marked(docs, ["doc_id", "hash"], wanted, ["least", "of"]).join(wanted, F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("hash") == F.col("of"))).select("rep", "text", "k1", "k2")
    return staged(rows.mapInArrow(run, "rep bigint, set array<bigint>").dropDuplicates(["rep"]), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets have a similarity of 0.75 or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, at), (y, to) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3)))
            keep = []
            for i in range(batch.num_rows):
                p, q = x[at[i] : at[i + 1]], y[to[i] : to[i + 1]]
                shared = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * shared >= 75 * (len(p) + len(q) - shared):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    both = pairs.join(sets.withColumnsRenamed({"rep": "a", "set": "x"}), "a").join(sets.withColumnsRenamed({"rep": "b", "set": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint")


def able(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The members (value, rep, n, ...) that can still be linked with another one of their list.

    A link needs an intersection of 3/7 of both sizes together, and only shingles that another member holds can be in it.
    So a class goes that holds too few such shingles for the smallest partner its list could offer. Copies with many edits
    of their own go here: there are as many of them as there are copies, and they are linked with few or none. The sets of a few
    other classes may count as well: that lets members stay, and none go.
    """
    rows = marked(sets, ["rep"], members, ["rep"]).select("rep", F.explode("set").alias("s"))
    common = rows.groupBy("s").agg(F.count(F.lit(1)).alias("f")).where("f > 1").select("s")
    held = rows.join(common, "s").groupBy("rep").agg(F.count(F.lit(1)).alias("shared"))
    least = staged(members.groupBy("value").agg(F.min("n").alias("least")), "least")
    rows = members.join(least, "value").join(held, "rep").where("7 * shared >= 3 * (n + greatest(least, cast(ceil(0.75 * n) as bigint)))")
    return rows.drop("least")


def incidence(values: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Which rows hold which values, as matrices of bounded width; values of one row only are left out."""
    flat = np.concatenate(values)
    owner = np.repeat(np.arange(len(values)), [len(v) for v in values])
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[inverse] > 1
    code, owner = (np.cumsum(count > 1) - 1)[inverse[keep]], owner[keep]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        at = slice(*np.searchsorted(code, (lo, lo + COLUMNS)))
        hold = np.zeros((len(values), COLUMNS), dtype=np.float32)
        hold[owner[at], code[at] - lo] = 1
        yield hold


def common(values: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections."""
    out = np.zeros((len(values), len(values)), dtype=np.float32)
    for hold in incidence(values):
        out += hold @ hold.T
    return out


def likely(df: pd.DataFrame, exact: bool) -> np.ndarray:
    """Which rows (n, sketch, component, shared) of a block sketches and sizes leave as possible links of one another."""
    n, size = df["n"].to_numpy(), np.array([len(s) for s in df["sketch"]])
    need = np.ceil(size * 0.75)
    if not exact:
        need = np.minimum(MIN_SHARED, need)
    ok = common(df["sketch"].to_list()) >= np.maximum(need[:, None], need[None, :])
    shared = df["shared"].to_numpy()
    ok &= 7 * np.minimum(shared[:, None], shared[None, :]) >= 3 * (n[:, None] + n[None, :])
    ok &= 100 * np.minimum(n[:, None], n[None, :]) >= 75 * np.maximum(n[:, None], n[None, :])
    component = df["component"].to_numpy()
    return ok & (component[:, None] != component[None, :])


def block_links(members: DataFrame, classes: DataFrame, sets: DataFrame, exact: bool = False) -> DataFrame:
    """Links (a, b) between members (value, rep, n, component, shared) of one list.

    A list of any length is cut into blocks by a hash; every two blocks meet in one group of at most about 2 * BLOCK rows.
    There sketches rule most pairs out. Only what is left is joined with its full sets, which confirm links, and of these
    those come out that join components not yet joined: fewer than there are members, and enough to know what links reach.
    """
    size = staged(members.groupBy("value").agg(F.count(F.lit(1)).alias("size")), "sizes")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    # sketches are joined once for each member, before it is dealt to blocks
    rows = members.join(classes.select("rep", "sketch"), "rep").join(size, "value").withColumn("of", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumns({"i": F.least("of", "other"), "j": F.greatest("of", "other")}).select("value", "i", "j", "rep", "n", "component", "shared", "sketch")

    def sift(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        worker_cache()
        df = df.drop_duplicates("rep")
        return df[likely(df, exact).any(axis=1)]

    schema = "value bigint, i int, j int, rep bigint, n bigint, component bigint, shared bigint, sketch array<bigint>"
    rows = staged(rows.groupBy("value", "i", "j").applyInPandas(sift, schema), "likely")

    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        worker_cache()
        df = df.sort_values("rep")
        ok, both = likely(df, exact), common(df["set"].to_list())
        n, rep, component = (df[c].to_numpy() for c in ("n", "rep", "component"))
        linked = ok & (100 * both >= 75 * (n[:, None] + n[None, :] - both))
        parent = {c: c for c in component.tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        out: list[tuple[int, int]] = []
        for x, y in zip(*(z.tolist() for z in np.nonzero(np.triu(linked, 1)))):
            p, q = root(component[x]), root(component[y])
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((rep[x], rep[y]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.join(sets, "rep").groupBy("value", "i", "j").applyInPandas(run, "a bigint, b bigint").distinct()


def apart(members: DataFrame) -> DataFrame:
    """The members of lists that hold more than one component."""
    mixed = members.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("value")
    return members.join(staged(mixed, "mixed"), "value", "left_semi")


def prepared(docs: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, text, hash): the hash of the text tells apart rows that share an id."""
    docs = docs.select(F.col(ids).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.withColumn("hash", F.xxhash64("text"))


def found_groups(docs: DataFrame, exact: bool = False) -> DataFrame:
    """Rows (doc_id, hash, n, component, least), one per row of ``docs`` (doc_id, text, hash): a key of the group that the row's
    set belongs to, and the least id in it; both null for empty sets, the least id where a group has none."""
    with scratch(docs.sparkSession) as keep, freed_shuffles(docs.sparkSession):
        own = staged(sketches(docs, exact), "sketches")
        # a class has a key of its own, so neither rows that share an id nor rows without one are mistaken for others
        classes = own.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "hash"))).alias("x"), F.min("hash").alias("of"), F.first("sketch").alias("sketch"))
        classes = classes.select("k1", "k2", "n", F.monotonically_increasing_id().alias("rep"), F.col("x.doc_id").alias("least"), F.coalesce("x.hash", "of").alias("of"), "sketch")
        classes = staged(classes, "classes")
        entered = staged(lists(classes, exact), "lists")
        hub = entered.groupBy("value").agg(F.max(F.struct("typical", F.negative("rep").alias("r"))).alias("h"), F.count(F.lit(1)).alias("size"))
        hub = staged(hub.where("size > 1").select("value", F.negative("h.r").alias("hub")), "hubs")
        entered = staged(entered.join(hub, "value"), "lists")
        sets = full_sets(docs, entered.select("rep").distinct().join(classes.select("rep", "least", "of", "k1", "k2"), "rep"))
        star = entered.where("rep != hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
        links = staged(confirmed(plausible(star, classes, exact), sets), "links")
        found = components(links)
        # lists that the first round has not joined to one component, without the members that can have no further link
        label = F.coalesce("component", "rep").alias("component")
        members = entered.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("value", "rep", "n", label)
        # a table of its own, else both sides of ``apart`` count all shingles again
        rest = staged(able(staged(apart(members), "members"), sets), "able")
        rest = staged(apart(rest), "members")
        if not rest.isEmpty():
            links = links.unionByName(staged(block_links(rest, classes, sets, exact), "links"))
            found = components(links)
        keep(own, classes, found)
    named = classes.select("k1", "k2", "n", "rep", "least").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "n", "least", label)
    named = named.drop("least").join(named.groupBy("component").agg(F.min("least").alias("least")), "component")
    return own.select("doc_id", "hash", "n", "k1", "k2").join(named, ["k1", "k2", "n"], "left").drop("k1", "k2")


def groups(docs: DataFrame, ids: str = "doc_id", text: str = "text", exact: bool = False) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per row of ``docs``.

    Documents are linked when 100 * intersection >= 75 * union of their shingle sets; component_id is the least id that
    links reach. Empty sets (null and empty texts) are linked with nothing. A row with a null id takes part, but its null
    is never a component: where no other id is reached its component_id is null and it is kept. Rows that share an id but
    not a text are judged by their own sets, each of which takes part. Equal rows share a class, of which one row goes into
    the search, so copies never multiply. An empty table gives no rows; other columns are left out. ``exact`` keeps whole sets
    in place of sketches, so that no link can be lost by chance.
    """
    component = F.coalesce("least", "doc_id")
    rows = found_groups(prepared(docs, ids, text), exact)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def deduplicated(docs: DataFrame, null_ids: Literal["keep", "judge"] = "keep", exact: bool = False) -> DataFrame:
    """``docs`` with one row of each group, one of those with its least id; rows that repeat an id go or stay by their own
    text's group.

    Rows with a null id all stay, or, with ``null_ids="judge"``, are judged like others and come behind all ids, so one of
    them stays only where its group has no id. Rows without words (null and empty texts) all stay. Of equal rows one stays;
    very long texts are compared whole; an empty table gives no rows. Other columns stay, whatever their names but ``id_``,
    ``hash_``, ``stays_`` and ``copies``. ``exact`` as in ``groups``.
    """
    rows = found_groups(prepared(docs), exact).where("n > 0" if null_ids == "judge" else "n > 0 and doc_id is not null")
    with freed_shuffles(docs.sparkSession):
        rows = staged(rows.groupBy("doc_id", "hash").agg(F.min("component").alias("component"), F.count(F.lit(1)).alias("copies")), "groups")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "hash")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash"))
    with freed_shuffles(docs.sparkSession):
        rows = staged(rows.join(first, "component").select(F.col("doc_id").alias("id_"), F.col("hash").alias("hash_"), stays.alias("stays_"), "copies"), "verdicts")
    # text hashes tell rows of one id, or of none, apart, so the join is dealt by them
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("id_")) & (F.xxhash64(F.col("text").cast("string")) == F.col("hash_"))
    # only first rows that have copies are told apart by a shuffle
    several = rows.where("stays_ and copies > 1").select("id_", "hash_")
    left = docs.join(rows.where("not stays_ or copies > 1"), same, "left_anti")
    one = docs.join(several, same).dropDuplicates(["id_", "hash_"])
    return left.select(docs.columns).unionByName(one.select(docs.columns))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


OP10_SQL = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS s FROM words),
    shingle AS MATERIALIZED (SELECT doc_id, unnest(s) AS s FROM sets),
    pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    link AS MATERIALIZED (SELECT a, b FROM pair JOIN sets x ON a = x.doc_id JOIN sets y ON b = y.doc_id WHERE 100 * shared >= 75 * (len(x.s) + len(y.s) - shared)),
    both_ AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach(node, member) AS (SELECT doc_id, doc_id FROM documents UNION SELECT node, b FROM reach JOIN both_ ON member = a),
    least AS (SELECT node, min(member) AS component_id FROM reach GROUP BY node)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON doc_id = node"""
