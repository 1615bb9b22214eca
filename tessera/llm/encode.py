"""Token ids of whole texts by the tokenizers library, with pieces that repeat encoded once.

A text is cut where its pre-tokenizer always cuts, so the ids of the text are those of the pieces one after the other. Cutting,
finding distinct pieces and putting ids together are array operations; each distinct piece goes through the library once, and
its ids stay in a table of bounded size in the Python worker.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from typing import Literal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache
from .tokens import byte_symbols

#: Pieces that a worker keeps, of some 50 bytes each. On overflow half of them stay, those used last. A slice of text may hold
#: more than 100,000 distinct ones: fewer than several slices' worth would be encoded again and again.
CACHE = 600_000
#: Ends of pieces (marks and the like) that a worker keeps.
TAILS = 20_000
JOIN = 256
_ALNUM = "A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_MARK = r"[!-&(-/:-@\[-`{-~]"
#: Words of Latin-1 letters, with the space that may lead them.
_LETTERS = re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Where every pre-tokenizer of this kind cuts: between ASCII and Latin-1 letters or digits (which normal forms leave alone),
#: ASCII marks but the apostrophe, and a line break that stands alone.
_FINE = re.compile(rf"(?<=[{_ALNUM}])(?={_MARK})|(?<={_MARK})(?=[{_ALNUM}])|(?<=[{_ALNUM}])(?=\n[{_ALNUM}])|(?<={_MARK})(?=\n[{_ALNUM}])|(?<=\S\n)(?=[{_ALNUM}])")
#: White space in a text after which a single space may not be a cut: at its ends, runs, and any but spaces and line breaks.
_UNSURE = "^ | $|  | \n|\n |[\t\r\x0b\x0c\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_TRAIL = ".,;:!?"


class Encoder:
    """``cut="space"``: byte-level tokenizers, where a single space leads the word behind it. ``cut="white"``: tokenizers
    that drop white space and never join across it."""

    def __init__(self, path: str, cut: Literal["space", "white"]) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in json.loads(open(path, encoding="utf-8").read())["added_tokens"]}
        self.cut = cut
        self.mark, self.mark_id = next(iter(self.special.items()))
        self.symbols = {b: c for c, b in byte_symbols().items()}
        #: Pieces known, with the space that leads them; where their ids start in ``pool``, how many, and when last used.
        self.words = pa.array([], pa.string())
        self.start, self.count, self.used = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32)
        self.pool = np.empty(0, dtype="<u4")
        self.tails: dict[str, bytes] = {}
        self.now = 0

    def mixed(self, text: str) -> list[str]:
        """The pieces of any text for ``cut="space"``, with the spaces that lead them."""
        out: list[str] = []
        for i, p in enumerate(text.split(" ")):
            # a cut stands only between a visible character and a space that leads a visible one
            if not i or p and not p[0].isspace() and out[-1] and not out[-1][-1].isspace():
                out.append(" " * bool(i) + p)
            else:
                out[-1] += " " + p
        return out

    def ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces by the library: words of letters by its model, as they are one word of the pre-tokenizer for sure."""
        out: list[bytes] = [b""] * len(pieces)
        tokenize, table, rest, lower = self.lib.model.tokenize, self.symbols, [], self.cut == "white"
        for i, p in enumerate(pieces):
            if _LETTERS.fullmatch(p):
                word = p.lower() if lower else p
                if not word.isascii() or word[0] == " ":
                    word = word.encode().decode("latin-1").translate(table)
                out[i] = array("I", [t.id for t in tokenize(word)]).tobytes()
            else:
                rest.append(i)
        for lo in range(0, len(rest), JOIN):
            part = rest[lo : lo + JOIN]
            # the special token between pieces keeps them apart, and is the same as encoding each on its own
            got = np.array(self.lib.encode(self.mark.join([pieces[i] for i in part]), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(got == self.mark_id) * 4
            raw = got.tobytes()
            for i, a, b in zip(part, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)]):
                out[i] = raw[a:b]
        return out

    def add(self, words: list[str], ids: list[bytes]) -> np.ndarray:
        """Rows of new pieces."""
        count = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) // 4
        self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(count) - count))
        self.pool = np.concatenate((self.pool, np.frombuffer(b"".join(ids), dtype="<u4")))
        self.count = np.concatenate((self.count, count))
        self.used = np.concatenate((self.used, np.full(len(ids), self.now, dtype=np.int32)))
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.string())])
        return np.arange(len(self.words) - len(words), len(self.words))

    def shrink(self) -> np.ndarray:
        """Of the pieces known, those of this call and the ones used last stay; the new row of each old one that does."""
        rank = np.argsort(-self.used, kind="stable")
        keep = np.sort(rank[: max(CACHE // 2, int(np.count_nonzero(self.used == self.now)))])
        to = np.full(len(self.words), -1)
        to[keep] = np.arange(len(keep))
        self.pool = self.gather(keep)
        self.words, self.count, self.used = self.words.take(pa.array(keep)), self.count[keep], self.used[keep]
        self.start = np.cumsum(self.count, dtype=np.int64) - self.count
        return to

    def learn(self, new: list[str]) -> np.ndarray:
        """Adds pieces not known, and tells their rows; those with marks or line breaks inside are cut on, and only new parts
        are encoded."""
        simple: list[int] = []
        cut: list[tuple[int, str, list[str]]] = []
        for i, x in enumerate(new):
            if _LETTERS.fullmatch(x):
                simple.append(i)
            elif (word := x.rstrip(_TRAIL)) != x and _LETTERS.fullmatch(word):
                cut.append((i, word, [x[len(word) :]]))
            elif len(c := _FINE.split(x)) > 1:
                cut.append((i, c[0], c[1:]))
            else:
                simple.append(i)
        rows = np.empty(len(new), dtype=np.int64)
        words = [new[i] for i in simple]
        rows[simple] = self.add(words, self.ids(words))
        if not cut:
            return rows
        heads = dict.fromkeys(h for _, h, _ in cut)
        known = pc.index_in(self.words, value_set=pa.array(heads, pa.string()))
        at = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
        raw, ends = self.gather(at).tobytes(), 4 * np.cumsum(self.count[at], dtype=np.int64)
        names = self.words.take(pa.array(at)).to_pylist()
        heads.update(zip(names, (raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist()))))
        unknown = list(set(heads).difference(names).difference(new))
        heads.update(zip(unknown, got := self.ids(unknown)))
        self.add(unknown, got)
        if None in heads.values():  # a piece that is cut on itself
            rest = [h for h, x in heads.items() if x is None]
            heads.update(zip(rest, self.ids(rest)))
        if len(self.tails) > TAILS:
            self.tails.clear()
        tails = list({t for _, _, tail in cut for t in tail}.difference(self.tails))
        self.tails.update(zip(tails, self.ids(tails)))
        get = self.tails.__getitem__
        joined = [heads[head] + (get(tail[0]) if len(tail) == 1 else b"".join(map(get, tail))) for _, head, tail in cut]
        rows[[i for i, _, _ in cut]] = self.add([new[i] for i, _, _ in cut], joined)
        return rows

    def rows(self, words: pa.Array) -> np.ndarray:
        """Rows of distinct pieces in the table; those not known are learnt."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        new = at < 0
        if new.any():
            self.used[at[~new]] = self.now
            if len(self.words) + int(new.sum()) > CACHE:
                at[~new] = self.shrink()[at[~new]]
            at[new] = self.learn(words.filter(pa.array(new)).to_pylist())
        self.used[at] = self.now
        return at

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of pieces, one after the other."""
        count = self.count[rows].astype(np.int64)
        ends = np.cumsum(count)
        return self.pool[np.repeat(self.start[rows] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without special tokens of its own; null is empty."""
        ids, count = self.flat(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        raw, ends = ids.tobytes(), (4 * np.cumsum(count)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same as one array of ids, and the number of ids of each text."""
        # nothing here makes cycles, and the collector would walk through millions of strings again and again
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._flat(pc.fill_null(texts, ""))
        finally:
            if collects:
                gc.enable()

    def _flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        self.now += 1
        special = np.zeros(len(texts), dtype=bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        odd = np.zeros(len(texts), dtype=bool)
        if self.cut == "space":
            odd = pc.match_substring_regex(texts, _UNSURE).to_numpy(zero_copy_only=False) & ~special
        rest = ~special & ~odd
        if rest.all():
            return self._joined(self._plain(texts), self.cut == "space")
        parts: list[np.ndarray] = [np.empty(0, dtype="<u4")] * len(texts)
        for i in np.flatnonzero(special).tolist():
            parts[i] = np.array(self.lib.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype="<u4")
        for at, led in ((np.flatnonzero(odd), False), (np.flatnonzero(rest), self.cut == "space")):
            if len(at):
                some = texts.take(pa.array(at))
                ids, count = self._joined(self._plain(some) if rest[at[0]] else pa.array(map(self.mixed, some.to_pylist()), pa.list_(pa.string())), led)
                ends = np.cumsum(count)
                for i, a, b in zip(at.tolist(), (ends - count).tolist(), ends.tolist()):
                    parts[i] = ids[a:b]
        return np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)

    def _plain(self, texts: pa.Array) -> pa.ListArray:
        return pc.ascii_split_whitespace(texts) if self.cut == "white" else pc.split_pattern(texts, " ")

    def _joined(self, pieces: pa.ListArray, led: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are lists of pieces. led: a space leads all pieces of a text but the first."""
        bounds = pieces.offsets.to_numpy()
        words, bounds = pieces.values.slice(bounds[0], bounds[-1] - bounds[0]), bounds - bounds[0]
        coded = words.dictionary_encode()
        number, kinds = coded.indices.to_numpy(), coded.dictionary
        if led:
            first = bounds[:-1][np.diff(bounds) > 0]
            opening, opens = np.unique(number[first], return_inverse=True)
            number = number + np.int32(len(opening))
            number[first] = opens
            kinds = pa.concat_arrays([kinds.take(pa.array(opening)), pc.binary_join_element_wise(" ", kinds, "")])
        rows = self.rows(kinds)[number]
        ends = np.concatenate(([0], np.cumsum(self.count[rows], dtype=np.int64)))[bounds]
        return self.gather(rows), np.diff(ends)


def encoder(path: str, cut: Literal["space", "white"]) -> Encoder:
    """One encoder per tokenizer and Python worker."""
    kept = worker_cache(f"encoder {path} {cut}")
    if not kept:
        kept["encoder"] = Encoder(path, cut)
    return kept["encoder"]
