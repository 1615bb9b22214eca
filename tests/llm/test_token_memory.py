"""What a merger keeps does not grow with the texts it has seen."""

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq

from tessera.llm import tokens


def test_answers_kept_are_bounded(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    classes = np.zeros(0x110000, dtype=np.uint8)
    classes[: 0x250] = [tokens.LETTER if chr(i).isalpha() else tokens.NUMBER if chr(i).isdigit() else tokens.WHITE if chr(i).isspace() else tokens.OTHER for i in range(0x250)]
    classes[ord(" ")], classes[ord("'")] = tokens.SPACE, tokens.APOSTROPHE
    texts = [x for x in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() if x][:60]
    whole = tokens.Counter(path, classes)
    expected = whole(texts).tolist()
    monkeypatch.setattr(tokens, "MAX_PAIRS", 500, raising=False)
    monkeypatch.setattr(tokens, "MAX_STATES", 2000)
    count, found = tokens.Counter(path, classes), []
    for x in texts:
        found += count([x]).tolist()
        assert len(count.merger.pair_ok) <= 500
    assert found == expected
    # a table of states that starts anew takes along what was known of the old ones
    count.merger.clear()
    assert not count.merger.kinds and count(texts).tolist() == expected
