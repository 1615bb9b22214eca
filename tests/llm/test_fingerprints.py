import hashlib
import random

import pyspark.sql.functions as F
import pytest

from tessera.llm.fingerprints import BUCKETS, K, edited_fingerprints, fingerprint, likeness, text_of

from .conftest import frame


def hashes(spark, keys):
    """xxhash64 of tuples as Spark gives it: bytes, and longs with an int."""
    out = {}
    b = sorted({k for k in keys if isinstance(k, bytes)})
    pairs = sorted({k for k in keys if isinstance(k, tuple) and isinstance(k[0], bytes)})
    longs = sorted({k for k in keys if isinstance(k, tuple) and isinstance(k[0], int)})
    for rows, schema, expr in (([(x,) for x in b], "a binary", F.xxhash64("a")), (pairs, "a binary, b binary", F.xxhash64("a", "b")), (longs, "a bigint, b int", F.xxhash64("a", "b"))):
        if rows:
            for k, r in zip(rows, spark.createDataFrame(rows, schema).select(expr.alias("h")).collect()):
                out[k if len(k) > 1 else k[0]] = r.h
    return out


def brute(spark, texts):
    """Fingerprints by the definition: number k-mers, rank by one hash, two least a bucket, in text order."""
    high = ~((1 << 24) - 1)
    mers = {t: [t[i : i + K].encode("utf-32-be") for i in range(max(1, len(t) - K + 1))] if t else [] for t in texts}
    h = hashes(spark, [x for m in mers.values() for x in m])
    numbered = {}
    for t, m in mers.items():
        seen, rows = {}, []
        for i, x in enumerate(m):
            key = h[x] & high
            rows.append((key, seen.get(key, 0), i, x))
            seen[key] = seen.get(key, 0) + 1
        numbered[t] = rows
    again = hashes(spark, [(k, n) for r in numbered.values() for k, n, _, _ in r if n])
    picked = {}
    for t, rows in numbered.items():
        by = {}
        for k, n, i, x in rows:
            rank = (again[k, n] & high if n else k) | i
            by.setdefault(rank >> 58, []).append((rank, i, x))
        picked[t] = {b: [x for _, x in sorted((i, x) for _, i, x in sorted(v)[:2])] for b, v in by.items()}
    pairs = hashes(spark, [k for p in picked.values() for v in p.values() for k in ([tuple(v)] if len(v) == 2 else v)])
    return {t: [(b + BUCKETS // 2) << 24 | ((pairs[tuple(v)] if len(v) == 2 else h[v[0]]) & 0xFFFFFF) for b, v in sorted(p.items())] for t, p in picked.items()}


def test_against_the_definition(spark):
    rnd = random.Random(1)
    texts = ["", "a", "abcdefg", "abcdefgh", "ab" * 400, "é😀x" * 60, "x" * 3000]
    texts += ["".join(rnd.choices("abc é", k=rnd.randint(1, 900))) for _ in range(25)]
    got = {r.text: list(r.f) for r in fingerprint(frame(spark, list(enumerate(texts))), "text", "f").collect()}
    assert got == brute(spark, texts)


def test_edited_texts(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop é", k=6))
    rows = [(i * 7, " ".join(word() for _ in range(rnd.randint(3, 200)))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (1002, "x"), (None, "no id at all"), (None, None), (2000, rows[5][1]), (1003, "long text " * 9000)]
    rnd.shuffle(rows)
    df = frame(spark, rows).withColumnRenamed("lang", "next_").withColumnRenamed("source", "a").repartition(3)
    got = edited_fingerprints(df).collect()
    assert len(got) == len(rows)
    ordered = sorted((r for r in rows if r[0] is not None))
    by = {r.doc_id: r for r in got}
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1]):
        t, n = t or "", n or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        r = by[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest()), i
    two = [(i, ((t or "")[: len(t or "") - len(t or "") // 4] + (n or "")[: len(t or "") // 4])) for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1])]
    want = {r.doc_id: r.s for r in fingerprint(frame(spark, two), "text", "f").select("doc_id", text_of("f").alias("s")).collect()}
    assert {i: by[i].edited_fingerprint for i in want} == want
    assert by[5 * 7].fingerprint == by[2000].fingerprint
    long = [r for r in got if r.doc_id is not None and r.n_chars > 300]
    assert sum(r.near_edited for r in long) / len(long) > 0.25 and sum(r.near_next for r in long) / len(long) < 0.05
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert edited_fingerprints(df.limit(0)).count() == 0 and edited_fingerprints(df.limit(1)).collect()[0].near_next == 1.0


def test_order_matters(spark):
    a = " ".join(f"word{i:04d}" for i in range(200))
    moved = " ".join(f"word{i:04d}" for i in [*range(100, 200), *range(100)])
    rows = fingerprint(fingerprint(spark.createDataFrame([(a, moved, a)], "x string, y string, z string"), "x", "a"), "y", "b")
    r = rows.select(likeness("a", "b").alias("m"), likeness("a", "a").alias("s")).first()
    assert r.s == 1.0 and 0.2 < r.m < 0.9


def test_equal_texts_on_either_side_of_the_wide_masks(spark, monkeypatch):
    """An edited text may be shorter than its text, as the next document may be too short to fill it."""
    import tessera.llm.fingerprints as f

    monkeypatch.setattr(f, "WIDE", 300)
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcd ", k=5))
    rows = [(i, "".join(word() for _ in range(n))[:size]) for i, (n, size) in enumerate([(80, 320), (1, 3), (80, 299), (90, 400), (2, 9), (90, 301), (0, 0), (61, 300)])]
    got = {r.doc_id: r for r in edited_fingerprints(frame(spark, rows)).collect()}
    texts = [t for _, t in rows]
    edited = [(i, t[: len(t) - len(t) // 4] + n[: len(t) // 4]) for (i, t), n in zip(rows, texts[1:] + texts[:1])]
    assert any(len(e) < 300 <= len(t) for (_, e), t in zip(edited, texts))
    for column, wanted in (("edited_fingerprint", edited), ("fingerprint", rows)):
        want = {r.doc_id: r.s for r in fingerprint(frame(spark, wanted), "text", "f").select("doc_id", text_of("f").alias("s")).collect()}
        assert {i: got[i][column] for i in want} == want


@pytest.mark.parametrize("ranges", [2, 9, 64])
def test_hot_ids_are_split(spark, monkeypatch, ranges):
    """Nulls and one id hold most rows: each row still has the next one in the order of (id, hash of the text) as its next."""
    import tessera.llm.fingerprints as f

    monkeypatch.setattr(f, "RANGES", 1)
    monkeypatch.setattr(f, "LEAST_RANGES", ranges)
    monkeypatch.setattr(f, "MOST_RANGES", ranges)
    rnd = random.Random(9)
    some = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    rows = [(None, some(rnd.randint(0, 60))) for _ in range(90)] + [(50, some(rnd.randint(20, 60))) for _ in range(120)]
    rows += [(i, some(40)) for i in (*range(30), *range(49, 90))] + [(None, None), (None, ""), (50, "same text"), (50, "same text"), (-(1 << 63), "least")]
    rnd.shuffle(rows)
    for part in (rows, [r for r in rows if r[0] is None], [r for r in rows if r[0] == 50], [r for r in rows if r[0] is not None]):
        df = spark.createDataFrame([(i, t or "") for i, t in part], "doc_id bigint, text string")
        ordered = sorted(df.withColumn("h", F.xxhash64("text")).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
        nulls, named = ([r.text for r in ordered if (r.doc_id is None) == x] for x in (True, False))
        chain = nulls + named
        following = chain[1:] + [(named or nulls)[0]]
        want = sorted((t, hashlib.sha256((t[: len(t) - len(t) // 4] + n[: len(t) // 4]).encode()).hexdigest()) for t, n in zip(chain, following))
        got = edited_fingerprints(df).collect()
        assert sorted(r.edited_sha256 for r in got) == sorted(x for _, x in want)
        dealt = f.with_next(df).where("not first_").groupBy("range_", "doc_id").count().collect()
        assert sum(r["count"] for r in dealt) == len(part)
        if ranges == 64 and len(part) == len(rows):
            assert max(r["count"] for r in dealt if r.doc_id is None) < 30 and max(r["count"] for r in dealt if r.doc_id == 50) < 40


@pytest.mark.parametrize("enough", [0, 1, 2, 10])
def test_low_ranks_first(spark, monkeypatch, enough):
    """Whatever share of the ranks is looked at first, the fingerprint is that of all of them; of a long text few are."""
    import tessera.llm.fingerprints as f

    rnd = random.Random(11)
    texts = ["".join(rnd.choices("abcdefghij ", k=n)) for n in (90, 400, 700, 1400, 5000)] + ["ab" * 1500, "same line again\n" * 200, "x" * 2000]
    texts += ["".join(rnd.choice(["one more ", "line of text ", "that repeats ", "é😀 "]) for _ in range(n)) for n in (40, 400)]
    monkeypatch.setattr(f, "ENOUGH", enough)
    df = fingerprint(frame(spark, list(enumerate(texts))), "text", "f")
    assert {r.text: list(r.f) for r in df.collect()} == brute(spark, texts)
