"""Order MinHash fingerprints, in DataFrame operations only.

The k-mers of a text's code points are numbered by their occurrence, so repeats count. One hash of (k-mer, occurrence)
deals them into buckets and ranks them there; a bucket keeps its two least k-mers, puts them in the order of the text and
hashes that pair. The likeness of two fingerprints is the share of buckets, among those that either fills, in which the
tuples agree: it falls with edits, and with moves that a set of k-mers would not see.

Everything of a text stays in its row, in arrays of longs: (hash, place) pairs are packed into one long and sorted. Equal
k-mers then stand together. A first occurrence ranks by its hash; others are cut into runs of equal ones, and their place in
the run is hashed in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

K = 8
BUCKETS = 64
#: Code points from which the place of a k-mer takes more than 24 bits.
WIDE = 1 << 24
#: Ranks a bucket, on average, that are looked at first in a text of more.
ENOUGH = 10
#: Ids that part documents into ranges, in each of which the next document is looked up: so many a shuffle partition, within
#: bounds. The driver holds the first ids of all ranges.
RANGES, LEAST_RANGES, MOST_RANGES = 4, 64, 20_000


#: An empty array of type "no nulls inside", which keeps sorts on primitive longs.
_NONE = "filter(array(0L), x -> false)"


def kmers(df: DataFrame, text: str, out: str, start: str = "0") -> DataFrame:
    """``df`` with ``out``: (hash, place) of the k-mers of ``text`` from place ``start`` on, each packed into a long.

    A text shorter than K is one k-mer; an empty one has none. low_ and high_ are the masks of places and hashes. Adds
    ``out``_b, the text in four bytes a code point, where a k-mer is found without reading what is before it.
    """
    df = df.withColumns({f"{out}_b": F.encode(F.col(text), "UTF-32"), f"{out}_last": F.greatest(F.char_length(text) - K, F.lit(0))})
    # a binary column is copied whenever it is read; as the variable of a lambda it is read once for all k-mers
    place = "j" if start == "0" else "shiftright(i, 2)"
    packed = f"transform(sequence(4 * ({start}) + 1, 4 * {out}_last + 1, 4), (i, j) -> (xxhash64(substring(b, i, {4 * K})) & high_) | {place})"
    some = f"{text} != '' and {out}_last >= {start}"
    return df.withColumn(out, F.expr(f"if({some}, get(transform(array({out}_b), b -> {packed}), 0), {_NONE})")).drop(f"{out}_last")


def sketch(df: DataFrame, found: str, out: str) -> DataFrame:
    """``df`` with ``out``: array of (bucket, tuple hash) packed into longs, from what ``kmers`` left in ``found``.

    Of a long text only low ranks are looked at, some ENOUGH a bucket, and repeats; if that leaves a bucket without its two,
    all ranks are.
    """
    top = 64 - (BUCKETS - 1).bit_length()
    rank = lambda x: f"({x} & {(1 << top) - 1}L)"
    few = f"cast({float(ENOUGH * BUCKETS << top)}D / size({found}) as bigint)"
    df = df.withColumns({"o_": F.expr(f"sort_array({found})"), "low_rank_": F.expr(f"if(size({found}) <= {ENOUGH * BUCKETS}, {1 << top}L, {few})")})
    # equal k-mers stand side by side, in the order of the text; the second and later ones take a rank by their number
    before = f"array(concat(array(cast(null as bigint)), o_)), {_NONE}"
    same = "x <= (get(a, i) | low_)"
    df = df.withColumn("o_", F.expr(f"aggregate({before}, (none, a) -> filter(o_, (x, i) -> {rank('x')} < low_rank_ or {same}))"))
    df = df.withColumn("d_", F.expr(f"aggregate({before}, (none, a) -> filter(o_, (x, i) -> {rank('x')} >= low_rank_ or {same}))"))
    df = df.withColumn("g_", F.expr("array_compact(transform(d_, (x, j) -> if(j > 0 and ((x ^ get(d_, j - 1)) & high_) = 0, null, j)))"))
    ends = "concat(slice(g_, 2, greatest(size(g_) - 1, 0)), array(size(d_)))"
    again = f"flatten(zip_with(g_, {ends}, (s, e) -> transform(slice(d_, s + 1, e - s), (x, i) -> (xxhash64(x & high_, i + 1) & high_) | (x & low_))))"
    df = df.withColumn("g_", F.expr(f"if(size(d_) = 0, {_NONE}, {again})"))
    df = df.withColumn("o_", F.expr(f"if(size(d_) = 0, o_, sort_array(concat(array_except(o_, d_), filter(g_, x -> {rank('x')} < low_rank_))))"))
    # the first two of each bucket: those whose second-last neighbour is in another one
    pairs = lambda c, k: f"slice({c}, 1, greatest(size({c}) - {k}, 0)), slice({c}, {k + 1}, greatest(size({c}) - {k}, 0))"
    firsts = lambda c: f"concat(slice({c}, 1, 2), array_compact(zip_with({pairs(c, 2)}, (x, y) -> if(shiftright(x ^ y, {top}) = 0, null, y))))"
    df = df.withColumn("o_", F.expr(firsts("o_")))
    df = df.withColumn("d_", F.expr(f"if(size(o_) = {2 * BUCKETS} or low_rank_ = {1 << top}L, {_NONE}, sort_array(concat(array_except({found}, d_), g_)))"))
    df = df.withColumn("o_", F.expr(f"if(size(d_) = 0, o_, {firsts('d_')})")).drop("d_", "g_", "low_rank_")
    kmer = lambda at: f"substring(b, shiftleft({at}, 2) + 1, {4 * K})"
    place = lambda x: f"cast({x} & low_ as int)"
    pair = f"if((x & low_) < (y & low_), xxhash64({kmer(place('x'))}, {kmer(place('y'))}), xxhash64({kmer(place('y'))}, {kmer(place('x'))}))"
    value = f"shiftleft(shiftright(x, {top}) + {BUCKETS // 2}, 24) | (if(y is not null and shiftright(x ^ y, {top}) = 0, {pair}, xxhash64({kmer(place('x'))})) & 16777215L)"
    tuples = f"get(transform(array({found}_b), b -> zip_with(o_, slice(o_, 2, greatest(size(o_) - 1, 0)), (x, y) -> {value})), 0)"
    # the second of a bucket has made a value of its own, right behind that of the pair
    df = df.withColumn("o_", F.expr(tuples))
    return df.withColumn(out, F.expr(f"concat(slice(o_, 1, 1), array_compact(zip_with({pairs('o_', 1)}, (x, y) -> if(shiftright(x ^ y, 24) = 0, null, y))))")).drop("o_")


def masks(df: DataFrame, text: str, tag: str = "") -> DataFrame:
    """``df`` with low_ and high_ (behind ``tag``): below WIDE code points a k-mer is known by 40 bits of its hash, beyond that
    by 35. Both follow from the text alone, so equal texts have equal fingerprints."""
    bits = F.when(F.char_length(text) < WIDE, (1 << 24) - 1).otherwise((1 << 29) - 1).cast("bigint")
    return df.withColumn(f"{tag}low_", bits).withColumn(f"{tag}high_", F.bitwise_not(f"{tag}low_"))


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the fingerprint of a column as an array of longs. Null and empty texts: no elements."""
    df = masks(df.withColumn("t_", F.coalesce(F.col(text), F.lit(""))), "t_")
    return sketch(kmers(df, "t_", "k_"), "k_", out).drop("t_", "k_", "k__b", "low_", "high_")


def text_of(sketch: str) -> Column:
    """A fingerprint as text: eight hexadecimal digits a bucket."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Share of equal tuples among buckets that either fingerprint fills, 0 to 1; two empty fingerprints: 1."""
    bucket = lambda c: F.transform(c, lambda x: F.shiftright(x, 24))
    either = F.size(F.array_union(bucket(a), bucket(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(F.col(a), F.col(b))) / F.greatest(either, F.lit(1)))


def starts_of(docs: DataFrame, ids: str, ranges: int) -> tuple[list[tuple[int | None, int]], set[int | None]]:
    """Starts (id, text hash) of ranges, in order, and the ids that fill several of them, null among them.

    Ids are parted by quantiles. An id that several quantiles hit, and null, is cut into as many equal parts of the hashes.
    """
    rows, known, least, cuts = docs.agg(F.count(F.lit(1)), F.count(ids), F.min(ids), F.percentile_approx(ids, [i / ranges for i in range(1, ranges)], 10 * MOST_RANGES)).first()
    parts: dict[int | None, int] = {None: -(-ranges * (rows - known) // rows)} if rows > known else {}
    for x in sorted([] if least is None else [least, *cuts]):
        parts[int(x)] = parts.get(int(x), 0) + 1
    if least is not None and parts[least] > 1:
        parts[least] -= 1  # it was counted as the least id, too
    starts = [(x, -(1 << 63) + (1 << 64) * i // n) for x, n in parts.items() for i in range(n)]
    return starts, {x for x, n in parts.items() if n > 1 or x is None}


def with_next(docs: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (id, text) with hash_ (of the text), range_ and first_ (a copy that only serves as a next document).

    The order is that of ids, null before all, then of hash_. The first row of a range is also put behind the range before,
    that of the least id behind the last range and behind the nulls; so each document finds the next one in its own range,
    without one task that sees all ids or all rows of one id. The driver holds at most twice MOST_RANGES starts. First rows of
    the parts of a hot id are found by a further look at the table.
    """
    spark = docs.sparkSession
    ranges = min(MOST_RANGES, max(LEAST_RANGES, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    starts, hot = starts_of(docs, ids, ranges)
    df = docs.withColumn("hash_", F.xxhash64(text))
    if not starts:
        return df.withColumns({"range_": F.lit(0), "first_": F.lit(False)})
    # the number of starts that are not above the row, found by bisection over literal arrays
    steps = [1 << i for i in reversed(range(len(starts).bit_length()))]
    id_, hash_ = F.lit([x for x, _ in starts]).cast("array<bigint>"), F.lit([h for _, h in starts]).cast("array<bigint>")
    not_above = lambda i: (F.get(hash_, i) <= F.col("hash_")) & F.get(id_, i).eqNullSafe(F.col(ids)) | F.col(ids).isNotNull() & F.coalesce(F.get(id_, i) < F.col(ids), F.get(id_, i).isNull() & (i < len(starts)))
    found = F.aggregate(F.lit(steps), F.lit(0), lambda a, p: F.when(not_above(a + p - 1), a + p).otherwise(a))
    # a table that reads differently each time (a limit without an order) may hold rows below the first start
    df = df.withColumn("range_", F.greatest(found - 1, F.lit(0)))
    # id and hash of the first row of each range; the start itself where that is an id of the table
    first: dict[int, tuple[int | None, int | None]] = {i: (x, None) for i, (x, _) in enumerate(starts) if x not in hot}
    if hot:
        rows = df.where(F.get(F.lit([x in hot for x, _ in starts]), "range_"))
        first |= {r.range_: (r.x[ids], r.x.hash_) for r in rows.groupBy("range_").agg(F.min(F.struct(ids, "hash_")).alias("x")).collect()}
    # ranges that hold rows, in order; behind which of them the first row of a range is put as well
    nulls, named = ([i for i in sorted(first) if (starts[i][0] is None) == null] for null in (True, False))
    behind: list[list[int]] = [[] for _ in starts]
    for chain in (nulls, named):
        for x, y in zip(chain, chain[1:]):
            behind[y].append(x)
    if around := named or nulls:
        behind[around[0]] += [around[-1]] + ([nulls[-1]] if nulls and named else [])
    target = lambda k: F.get(F.lit([b[k] if len(b) > k else -1 for b in behind]), "range_")
    own = [first.get(i, (None, 0)) for i in range(len(starts))]
    first_id, first_hash = (F.get(F.lit(list(x)).cast("array<bigint>"), "range_") for x in zip(*own))
    is_first = first_id.eqNullSafe(F.col(ids)) & F.coalesce(first_hash == F.col("hash_"), F.lit(True))
    place = lambda r, f: F.struct(r.alias("r"), F.lit(f).alias("f"))
    more = F.filter(F.array(target(0), target(1)), lambda r: (r >= 0) & is_first)
    df = df.withColumn("copy_", F.explode(F.concat(F.array(place(F.col("range_"), False)), F.transform(more, lambda r: place(r, True)))))
    return df.select(ids, text, "hash_", F.col("copy_.r").alias("range_"), F.col("copy_.f").alias("first_"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def edited_fingerprints(docs: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document, and their likeness.

    The edited text has the last quarter of its code points replaced by the first as many (or all) of the next document in
    ascending id order; behind the last comes the first. Null texts count as empty, whose fingerprint is empty. Equal ids
    follow one another by the hash of their text; rows with a null id follow one another too, and the last takes the first
    document with an id, or, if there is none, the first of these rows. A single document is its own next. An empty table
    gives no rows. One shuffle, by range of ids and, where one id fills several ranges, of hashes; only rows with the same id
    and the same text are not parted.
    """
    from pyspark.sql import Window

    df = docs.select(F.col(ids).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = with_next(df, "doc_id", "text")
    w = Window.partitionBy("range_").orderBy(F.col("first_"), F.col("doc_id").asc_nulls_first(), F.col("hash_"), F.col("text"))
    df = df.withColumns({"next_": F.coalesce(F.lead("text").over(w), F.lit("")), "row_": F.row_number().over(w), "n_chars": F.char_length("text")})
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - quarter), F.substring("next_", F.lit(1), quarter))).drop("next_", "hash_")
    df = kmers(masks(masks(df, "text"), "edited", "e_"), "text", "k").drop("text")
    # k-mers that end before the edit are those of the text, unless the two lie on either side of WIDE
    same = f"if(low_ = e_low_, greatest(n_chars - cast(floor(n_chars / 4) as int) - {K - 1}, 0), 0)"
    df = df.withColumns({"edited_sha256": F.sha2("edited", 256), "same_": F.expr(same)})
    swap = {"low_": "e_low_", "high_": "e_high_", "e_low_": "low_", "e_high_": "high_"}
    swapped = lambda x: x.select(*(F.col(swap.get(c, c)).alias(c) for c in x.columns))
    df = swapped(kmers(swapped(df), "edited", "t", "same_").drop("edited"))
    df = sketch(df, "k", "a").drop("k_b").withColumn("k", F.concat(F.slice("k", F.lit(1), F.col("same_")), F.col("t"))).drop("t")
    df = sketch(swapped(df.withColumnRenamed("t_b", "k_b")), "k", "b").select("range_", "first_", "row_", "doc_id", "n_chars", "edited_sha256", "a", "b")
    df = df.withColumn("c", F.lead("a").over(Window.partitionBy("range_").orderBy("row_"))).where("not first_")
    near_next = F.when(F.col("c").isNull(), 1.0).otherwise(likeness("a", "c"))
    return df.select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), "edited_sha256", text_of("a").alias("fingerprint"), text_of("b").alias("edited_fingerprint"), likeness("a", "b").alias("near_edited"), near_next.alias("near_next"))
