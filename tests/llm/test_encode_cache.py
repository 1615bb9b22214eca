"""Pieces of several slices stay known to an encoder."""

import public_tokenizers

from tessera.llm.encode import Encoder


def test_pieces_of_a_few_slices_are_encoded_once():
    encode, asked = Encoder(public_tokenizers.path("word_bpe_49k.json"), "white"), []
    ids = encode.ids
    encode.ids = lambda pieces: asked.append(len(pieces)) or ids(pieces)
    letters = "abcdefghijklmnopqrst"
    slices = [" ".join(f"{p}{a}{b}{c}{d}" for a in letters for b in letters for c in letters for d in letters[:10]) for p in "xyz"]
    first = [encode([x])[0] for x in slices]
    assert sum(asked) == 240_000
    assert [encode([x])[0] for x in slices] == first and sum(asked) == 240_000
