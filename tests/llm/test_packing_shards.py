"""Shards by content: odd tables, equal rows, and statistics of the whole table."""

import public_tokenizers

import numpy as np
import pytest

import tessera.llm.packing as packing
from tessera.llm.packing import Axes, Index, pack, routed, shards

from .conftest import frame

WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("rows", [[(1, "one")], [(None, None)], [(None, None)] * 5, [(1, "same text here")] * 40, [(i, "") for i in range(30)], [(-5, "x"), (2**62, "y " * 3000)]])
def test_odd_tables(spark, rows):
    got = pack(frame(spark, rows), WORD, end_id=1, window=64).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0
    assert len({r.doc_id for r in got}) == len({i for i, _ in rows})
    assert sum(r.length for r in got if r.start == 0) >= len(rows)


def test_very_many_equal_rows_are_dealt(spark, monkeypatch):
    """A third of all rows are the same, id and text; no shard is much larger than others."""
    monkeypatch.setattr(packing, "SHARD_IDS", 1000)
    rows = [(7, "the very same row again and again")] * 600 + [(100 + i, f"row number {i} of the others with {i * i} words") for i in range(600)]
    df = frame(spark, rows).repartition(2)
    seen = {}
    real = packing.shards

    def spy(rests):
        out = real(rests)
        seen["sizes"] = [r.n for r in out[0].groupBy("shard").agg({"length": "sum"}).toDF("shard", "n").collect()]
        return out

    monkeypatch.setattr(packing, "shards", spy)
    got = pack(df, WORD, end_id=1, window=64)
    assert got.select("doc_id", "start").count() >= 1200
    assert len(seen["sizes"]) > 8 and max(seen["sizes"]) < 2000


def test_statistics_of_the_whole_table():
    """An index of some documents under the whole's statistics scores them as one of all does."""
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 300, size=rng.integers(5, 60)).astype(np.uint16) for _ in range(90)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=300)
    whole = (90, np.mean([len(d) for d in docs]), df)
    every, some = Index(docs), Index(docs[:40], whole)
    assert np.allclose(every.scores([3])[0][:40], Index(docs, whole).scores([3])[0][:40], rtol=1e-5)
    terms = [t for t in np.unique(docs[3]).tolist() if sum(t in d for d in docs[:40]) > 1]
    want = [sum(np.log1p((90 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / whole[1])) for t in terms if (tf := int((d == t).sum()))) for d in docs[:40]]
    assert np.allclose(some.scores([3])[0], want, rtol=1e-4)


def test_copies_share_a_cell():
    rng = np.random.default_rng(4)
    docs = [rng.integers(500 * (i % 4), 500 * (i % 4) + 500, size=200).astype(np.uint16) for i in range(200)]
    docs += [d.copy() for d in docs[:50]]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=2000)
    axes = Axes(docs[:150], (len(docs), 200.0, df))
    cells = axes.cells(docs)
    assert (cells[:50] == cells[200:]).all()
    # the widest axes part the four topics
    assert len({(i % 4, c >> 13) for i, c in enumerate(cells[:200].tolist())}) <= 10 and callable(routed) and callable(shards)
