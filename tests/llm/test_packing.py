import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import tessera.llm.packing as packing
from tessera.llm.packing import Index, cells, holders, pack, pack_shard

from .conftest import frame

WORD = public_tokenizers.path("word_bpe_49k.json")


def whole(docs, sequences, window):
    seen = [np.zeros(len(d), dtype=int) for d in docs]
    for pieces in sequences:
        n = sum(k for _, _, k in pieces)
        assert n == window or n < window and n & (n - 1) == 0
        for i, a, k in pieces:
            seen[i][a : a + k] += 1
    assert all((s == 1).all() for s in seen)


def test_every_id_once():
    rng = np.random.default_rng(1)
    for sizes in ([1], [0, 3], [64], [65], [200] * 9, rng.integers(1, 300, size=80).tolist()):
        docs = [rng.integers(0, 50, size=n).astype(np.uint32) for n in sizes]
        whole(docs, pack_shard(docs, 64), 64)


def test_neighbours_are_those_of_bm25():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 40, size=rng.integers(1, 30)).astype(np.uint32) for _ in range(60)]
    index, mean = Index(docs), np.mean([len(d) for d in docs])
    df = {t: sum(t in d for d in docs) for d in docs for t in d.tolist()}

    def impact(t, d):
        tf = int((d == t).sum())
        return np.log1p((60 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) if tf else 0.0

    for i in range(0, 60, 7):
        terms = sorted({t for t in docs[i].tolist() if df[t] > 1})
        assert len(terms) <= packing.QUERY_TERMS
        score = [sum(impact(t, d) for t in terms) for d in docs]
        got = index.neighbours(i).tolist()
        assert sorted(got) == [j for j in range(60) if score[j] > 0]
        assert np.allclose(sorted(score, reverse=True)[: len(got)], [score[j] for j in got])


def test_seeds_of_many_terms_are_scored_by_all():
    rng = np.random.default_rng(5)
    docs = [rng.choice(1500, size=rng.integers(200, 400)).astype(np.uint32) for _ in range(40)]
    docs.append(np.arange(3000, 3300, dtype=np.uint32))
    docs += [np.array([3000 + i], dtype=np.uint32) for i in range(300)]  # each shares one term with the last
    index, n, mean = Index(docs), len(docs), np.mean([len(d) for d in docs])
    tfs = [dict(zip(*(x.tolist() for x in np.unique(d, return_counts=True)))) for d in docs]
    df = {}
    for tf in tfs:
        for t in tf:
            df[t] = df.get(t, 0) + 1

    def impact(t, j):
        tf = tfs[j].get(t, 0)
        return np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[j]) / mean))

    gone = np.zeros(n, dtype=bool)
    for used in ([], range(0, n, 3)):
        gone[list(used)] = True
        index.drop(gone)
        for i in (*range(0, 40, 7), 40):
            terms = [t for t in tfs[i] if df[t] > 1]
            assert len(terms) > 100
            score = [0.0 if gone[j] else sum(impact(t, j) for t in terms) for j in range(n)]
            got = index.neighbours(i).tolist()
            assert sorted(got) == [j for j in range(n) if score[j] > 0]
            assert np.allclose(sorted(score, reverse=True)[: len(got)], [score[j] for j in got])


def test_related_documents_share_windows():
    rng = np.random.default_rng(3)
    docs = [rng.integers(100 * (i % 5), 100 * (i % 5) + 100, size=32).astype(np.uint32) for i in range(100)]
    mixed = [len({i % 5 for i, _, _ in p}) for p in pack_shard(docs, 256)]
    assert np.mean(mixed) < 1.5


def test_rows(spark, monkeypatch):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choices(["alpha", "Beta", "gamma!", "<|endoftext|>", "x1", "é"], k=rnd.randint(0, 900))) for _ in range(60)]
    rows = [*enumerate(texts), (100, None), (100, None), (None, "no id"), (101, "long " * 20_000)]
    df = frame(spark, rows).withColumnRenamed("lang", "start").withColumnRenamed("source", "offset").repartition(2)
    got = pack(df, WORD, end_id=1, window=256).collect()
    lib = Tokenizer.from_file(WORD)
    want = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for i, t in rows}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(want[r.doc_id])
    assert sum(len(w) for w in want.values()) + 1 == sum(r.length for r in got)  # id 100 twice
    for i, pieces in by.items():
        if i != 100:
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at
                at += r.length
            assert at == len(want[i])
    fill = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert all(n == 256 or n < 256 and n & (n - 1) == 0 for n in fill.values())
    assert pack(df.limit(0), WORD, end_id=1).count() == 0


def test_neighbours_are_those_of_the_whole_table(spark, monkeypatch):
    """Related documents lie in different partitions and shards, one of each topic in each of them."""
    monkeypatch.setattr(packing, "SHARD_IDS", 400)
    rnd = random.Random(6)
    words = [[f"{a}{b}" for b in rnd.sample("bcdfghjklmnpqrstvwxz", 12)] for a in ("ka", "lo", "mi", "nu", "pe", "ro")]
    rows = [(10 * part + topic, " ".join(rnd.choices(words[topic], k=60))) for part in range(8) for topic in range(6)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame(spark.sparkContext.parallelize([(i, t, "en", "s", len(t)) for i, t in rows], 8), schema)
    got = pack(df, WORD, end_id=1, window=256).collect()
    topics = {}
    for r in got:
        topics.setdefault(r.sequence_id, []).append((r.doc_id % 10, r.doc_id // 10, r.length))
    full = [x for x in topics.values() if sum(n for *_, n in x) == 256]
    assert len(full) > 5 and all(len({p for _, p, _ in x}) > 1 for x in full)
    assert np.mean([len({t for t, *_ in x}) for x in full]) < 2.5
    again = pack(df.coalesce(1), WORD, end_id=1, window=256).collect()
    windows = lambda rows: sorted(sorted((r.doc_id, r.start, r.length) for r in rows if r.sequence_id == s) for s in {r.sequence_id for r in rows})
    assert windows(got) == windows(again)


def test_counts_of_holders_and_cells_by_document():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 300, size=n).astype("<u2") for n in (0, 1, 5, 700, 0, 2047, 60)] + [np.full(40, 65535, dtype="<u2")] * 3
    wanted = np.zeros(65536, dtype=np.int64)
    for d in docs:
        wanted[np.unique(d)] += 1
    assert np.array_equal(holders(docs), wanted) and len(holders([])) == len(holders(docs[:1])) == 0
    rows = sorted((int(d), int(t), int(n)) for t, d, n in zip(*cells(docs)))
    assert [(int(d), int(t), int(n)) for t, d, n in zip(*cells(docs, by_doc=True))] == rows
