import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.common import shared_path
from tessera.llm.planes import File, documents, dump, read_ids, restore, transpose, write_ids

from .conftest import frame

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_round_trip(plane):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2**32, size=n, dtype=np.uint32)
        assert (restore(transpose(ids, plane), n) == ids).all()
        f = File(dump(ids, [3, None], [n, 0], plane, block=64))
        assert (f.ids() == ids).all() and f.docs == [3, None] and f.sizes.tolist() == [n, 0]
    f = File(dump(ids, [1], [1000], plane, block=64))
    assert (f.read(3) == ids[192:256]).all()
    with pytest.raises(ValueError):
        File(b"x" * 40)


def test_planes_shrink():
    ids = np.random.default_rng(2).integers(0, 300, size=50_000).astype(np.uint32)
    assert len(dump(ids, [1], [50_000])) < ids.nbytes / 3


def test_files(spark, monkeypatch):
    rows = [(5, "five five"), (1, None), (3, ""), (2, "two " * 5000), (5, "another"), (None, "no id"), (4, "<|endoftext|> x")]
    df = frame(spark, rows).repartition(3)
    files = write_ids(df, BYTE, shared_path(spark, "ids"), end_id=2)
    got = read_ids(spark, files).collect()
    lib = Tokenizer.from_file(BYTE)
    want = sorted((np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes() for _, t in rows))
    assert sorted(bytes(r.ids) for r in got) == want
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 5]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    assert zlib.crc32(np.array([2], dtype="<u4").tobytes()) == zlib.crc32(bytes(got[1].ids))
    empty = write_ids(df.limit(0), BYTE, shared_path(spark, "ids"), end_id=2)
    assert read_ids(spark, empty).count() == 0


def test_a_file_is_read_in_parts(monkeypatch):
    """No batch holds more ids than asked for, but for a document that is longer on its own."""
    import tessera.llm.planes as p

    monkeypatch.setattr(p, "READ_IDS", 100)
    rng = np.random.default_rng(3)
    sizes = [0, 30, 70, 1, 99, 0, 1000, 5, 100, 101, 0, 0]
    docs = [None, *range(1, len(sizes))]
    ids = rng.integers(0, 2**32, size=sum(sizes), dtype=np.uint32)
    batches = list(documents(dump(ids, docs, sizes, block=64), 7))
    assert all(b.num_rows == 1 or sum(b.column(2).to_pylist()) <= 100 for b in batches) and len(batches) > 5
    rows = [r for b in batches for r in b.to_pylist()]
    starts = [7 + sum(sizes[:i]) for i in range(len(sizes))]
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in rows] == list(zip(docs, starts, sizes))
    assert [r["ids"] for r in rows] == [ids[a - 7 : a - 7 + n].tobytes() for a, n in zip(starts, sizes)]
    assert not list(documents(dump(ids[:0], [], []), 0))


def test_reading_lets_the_encoder_go():
    """A worker that wrote before holds no encoder while it reads."""
    from tessera.llm import common

    common.worker_cache("encoder of a writing task")["encoder"] = object()
    assert len(list(documents(dump(np.arange(3, dtype="<u4"), [1], [3]), 0))) == 1 and not common._CACHES
