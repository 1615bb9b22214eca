import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm.encode import Encoder
from tessera.llm.tokens import CHUNK, Counter, Merger, N_STATES, STEP, S_START, point_classes, scan, states, token_counts

from .conftest import frame

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "the", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'x", "1", "23", "é", "ß", "İ", "Σ", "日本", "\u00a0", "\u3000", "!", "--", "<|endoftext|>", "😀", "\u0301", "ing", "x" * 50, "_", "\x1c", "²", "\r\n", ".\nThe", "%%%"]


def texts(n=3000, seed=1):
    rnd = random.Random(seed)
    out = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(n)]
    out += ["".join(chr(rnd.choice([rnd.randint(9, 126), rnd.randint(128, 0x2FFF), rnd.randint(0x10000, 0x1FFFF)])) for _ in range(rnd.randint(0, 20))) for _ in range(n)]
    return [*out, "", "word " * 20_000, "ab" * 30_000]


@pytest.fixture(scope="module")
def counter():
    return Counter(BYTE)


def test_counts_are_those_of_the_library(counter):
    t = texts()
    assert counter(t).tolist() == [len(e.ids) for e in Tokenizer.from_file(BYTE).encode_batch(t, add_special_tokens=False)]
    assert counter([]).tolist() == [] and counter([""]).tolist() == [0]


def test_table_can_start_anew(counter, monkeypatch):
    import tessera.llm.tokens as tokens

    monkeypatch.setattr(tokens, "MAX_STATES", 50)
    t = texts(200, seed=5)
    lib = Tokenizer.from_file(BYTE)
    for lo in range(0, len(t), 50):
        assert counter(t[lo : lo + 50]).tolist() == [len(lib.encode(x, add_special_tokens=False).ids) for x in t[lo : lo + 50]]


def test_pairs_of_tokens():
    m, rnd = Merger(BYTE), random.Random(2)
    ids = sorted(m.parts)
    for _ in range(3000):
        a, b = rnd.choice(ids), rnd.choice(ids)
        assert m.follows(a, b) == (m.encode(m.bytes_of[a] + m.bytes_of[b]) == [a, b])


def test_scan_of_chunk_maps():
    rng = np.random.default_rng(3)
    classes = rng.integers(0, 7, size=10 * CHUNK + 17).astype(np.uint8)
    want, now = [], S_START
    for c in classes:
        want.append(now)
        now = STEP[now, c]
    assert states(classes).tolist() == want
    maps = rng.integers(0, N_STATES, size=(37, N_STATES))
    got, acc = scan(maps), np.arange(N_STATES)
    for i, m in enumerate(maps):
        acc = m[acc]
        assert got[i].tolist() == acc.tolist()


def test_classes():
    c = point_classes(BYTE)
    assert [int(c[ord(x)]) for x in "a1 !'\né"] == [1, 2, 3, 0, 5, 4, 1]


@pytest.mark.parametrize(("path", "cut"), [(BYTE, "space"), (WORD, "white")])
def test_encoder_is_the_library(path, cut, monkeypatch):
    import tessera.llm.encode as encode

    monkeypatch.setattr(encode, "CACHE", 400)
    e, t = Encoder(path, cut), texts(1500, seed=4)
    got = [x for lo in range(0, len(t), 300) for x in e(t[lo : lo + 300])]
    assert got == [np.array(x.ids, dtype="<u4").tobytes() for x in e.lib.encode_batch(t, add_special_tokens=False)]


def test_rows(spark):
    df = frame(spark, [(1, "hello world"), (2, None), (3, ""), (1, "hello world"), (None, "é" * 600), (4, "x y " * 30_000)])
    df = df.withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "n_bytes")
    got = [tuple(r) for r in token_counts(df, BYTE).collect()]
    assert got[:4] == [(1, 11, 2, False), (2, 0, 0, False), (3, 0, 0, False), (1, 11, 2, False)]
    assert got[4][:2] == (None, 1200) and got[5][3] is True
    assert token_counts(df.limit(0), BYTE).count() == 0
