"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer is two deterministic machines. The *splitter* reads code points and cuts a text into pieces
(``'s``-like endings, words, numbers, symbols, white space). Its state fits in four bits, so a chunk of text is a map from
states to states; maps of fixed-size chunks compose, and a parallel prefix scan over the chunk maps of a whole batch gives
the state in which each chunk starts. The *merger* reads the bytes of one piece and is a transducer whose transitions
carry token counts: after each byte it holds, for every start of a token that may still be open, the trie node reached, the
last token before that start and the tokens so far, relative to the least. A prefix has exactly one encoding, whose last
token is the only one that is compatible with the token before it; hence the next state and the change in the count depend
on the state and the byte alone. States are made as texts need them, held in one table, and shared by all pieces.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, slices, table, worker_cache

#: Classes of code points that the splitter tells apart. The order is that of the columns of its table.
OTHER, LETTER, NUMBER, SPACE, WHITE, APOSTROPHE, END = range(7)
CHUNK = 128
#: Bytes of text that are counted at a time, at about 50 bytes of arrays each.
SLICE = 1_000_000
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
#: The most states a merger keeps; beyond that its table starts anew, which costs time and changes no count.
MAX_STATES = 120_000
#: Answers about pairs of tokens that a merger keeps, of some 150 bytes each; beyond that they are worked out anew.
MAX_PAIRS = 100_000
#: The most tokens below a trie node for which open starts are told apart by what can come of them.
FEW = 16


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def point_classes(path: str) -> np.ndarray:
    """The class of every code point, asked of the tokenizer's own pre-tokenizer rather than of a Unicode table."""
    from tokenizers import Tokenizer

    pre = Tokenizer.from_file(path).pre_tokenizer
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    # planes 4 to 13 hold no characters, 15 and 16 private ones: neither letters nor numbers nor white space
    points = [c for c in [*range(0x40000), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 4096):
        part = points[lo : lo + 4096]
        # between "a" and "1" a letter joins the first, a number the second, white space leaves a piece that is not
        # joined to a symbol; "!" in front tells symbols, which join it, from white space
        text = "\n".join(f"a{chr(c)}1!{chr(c)}!" for c in part)
        starts = np.zeros(len(text) + 1, dtype=bool)
        for _, (s, e) in pre.pre_tokenize_str(text):
            starts[s] = starts[e] = True
        at = 7 * np.arange(len(part))
        letter, number = ~starts[at + 1], ~starts[at + 2]
        symbol = ~starts[at + 4] & ~starts[at + 5]
        kind = np.where(letter, LETTER, np.where(number, NUMBER, np.where(symbol, OTHER, WHITE)))
        out[np.array(part)] = kind
    out[ord(" ")], out[ord("'")] = SPACE, APOSTROPHE
    return out


# Splitter states: what the open piece is. Endings are matched only where a piece would start at an apostrophe.
S_START, S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_WHITE = range(6)
N_STATES = 6


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, cut before this code point?) by state and class; endings and the last of white space come after.

    A piece opens at its first code point. A single space opens a piece that the next letter, number or symbol joins. In a
    run of white space all but the last code point form a piece when something else follows; that cut depends on the next
    code point, so it is made where that is known (``cuts``).
    """
    step = np.zeros((N_STATES, 7), dtype=np.uint8)
    cut = np.zeros((N_STATES, 7), dtype=bool)
    opens = {OTHER: S_OTHER, LETTER: S_LETTER, NUMBER: S_NUMBER, SPACE: S_SPACE, WHITE: S_WHITE, APOSTROPHE: S_OTHER, END: S_START}
    stays = {S_LETTER: {LETTER}, S_NUMBER: {NUMBER}, S_OTHER: {OTHER, APOSTROPHE}}
    for s in range(N_STATES):
        for c in range(7):
            if c in stays.get(s, ()):
                step[s, c], cut[s, c] = s, False
            elif s in (S_SPACE, S_WHITE) and c in (SPACE, WHITE):
                step[s, c], cut[s, c] = (S_SPACE if c == SPACE else S_WHITE), False
            elif s == S_SPACE and c not in (END,):
                step[s, c], cut[s, c] = opens[c], False
            else:
                step[s, c], cut[s, c] = opens[c], True
    return step, cut


STEP, CUT = _splitter()


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps, one by row: first, then the other."""
    return np.take_along_axis(then, first, axis=1)


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps by doubling: log2(n) rounds, each over all rows at once."""
    out, gap = maps, 1
    while gap < len(out):
        out = np.concatenate((out[:gap], compose(out[:-gap], out[gap:])))
        gap *= 2
    return out


def states(classes: np.ndarray) -> np.ndarray:
    """The splitter's state before each code point."""
    n = len(classes)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, END, dtype=np.uint8)
    grid[:n] = classes
    grid = grid.reshape(rows, CHUNK).T.copy()
    flat = STEP.ravel()
    at = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    for column in grid:
        at = flat[at * np.uint8(7) + column[:, None]]
    ends = scan(at.astype(np.intp))
    now = np.full(rows, S_START, dtype=np.uint8)
    now[1:] = ends[:-1, S_START]
    out = np.empty((CHUNK, rows), dtype=np.uint8)
    for i, column in enumerate(grid):
        out[i] = now
        now = flat[now * np.uint8(7) + column]
    return out.T.ravel()[:n]


def cuts(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """True where a piece starts. Texts in ``points`` are parted by one code point of class END each."""
    before = states(classes)
    cut = CUT[before, classes]
    # white space before something else: its last code point leaves the run, as a lead of the next piece or on its own
    white = (classes == SPACE) | (classes == WHITE)
    run = white[:-1] & white[1:]
    last = np.zeros(len(classes), dtype=bool)
    last[1:-1] = run[:-1] & ~white[2:] & (classes[2:] != END)
    cut |= last
    # endings: an apostrophe that opens a piece, with one of the suffixes behind it
    open_at = np.flatnonzero((classes == APOSTROPHE) & cut)
    if len(open_at):
        tail = np.zeros((len(open_at), 2), dtype=np.uint32)
        for i in (1, 2):
            ok = open_at + i < len(points)
            tail[ok, i - 1] = points[open_at[ok] + i]
        for suffix in SUFFIXES:
            same = np.all([tail[:, i] == ord(x) for i, x in enumerate(suffix)], axis=0)
            at = open_at[same]
            cut[at + 1] = False
            if len(suffix) == 2:
                cut[at + 2] = False
            cut[at + 1 + len(suffix)] = True
    return cut


class Merger:
    """The transducer of byte pair merges, compiled as it is used."""

    def __init__(self, path: str) -> None:
        model = json.loads(open(path, encoding="utf-8").read())["model"]
        symbol = byte_symbols()
        self.bytes_of = {i: bytes(symbol[c] for c in t) for t, i in model["vocab"].items() if all(c in symbol for c in t)}
        pairs = (x if isinstance(x, list) else x.split(" ", 1) for x in model["merges"])
        vocab = model["vocab"]
        self.merges = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.parts = {new: pair for pair, (_, new) in self.merges.items()}
        made = set(self.parts)
        by_rank = [new for _, new in sorted(self.merges.values())]
        #: Whether ids order as merge ranks do and every token has one way to be made.
        self.ordered = len(made) == len(self.merges) and by_rank == sorted(by_rank) and all(max(p) < new for new, p in self.parts.items())
        self.single = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        # the trie of tokens that merging can make
        self.edges: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for i, text in self.bytes_of.items():
            if len(text) > 1 and (i not in made or self.encode(text) != [i]):
                continue
            node = 0
            for b in text:
                if b not in self.edges[node]:
                    self.edges[node][b] = len(self.edges)
                    self.edges.append({})
                    self.token.append(-1)
                node = self.edges[node][b]
            self.token[node] = i
        # the tokens below a node, where they are few: what can still come of an open start
        self.below: list[tuple | None] = [()] * len(self.edges)
        for node in reversed(range(len(self.edges))):  # children have larger numbers
            found: list[int] = []
            for child in self.edges[node].values():
                rest = self.below[child]
                if rest is None or len(found) > FEW:
                    found = [0] * (FEW + 1)
                    break
                found += [self.token[child]] * (self.token[child] >= 0) + list(rest)
            self.below[node] = tuple(found) if len(found) <= FEW else None
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        #: A state: (trie node, token before its start, tokens before its start less those of the whole prefix) of each open start.
        self.index: dict[tuple, int] = {}
        self.items: list[tuple] = []
        self.kinds: dict[tuple, int] = {}
        self.next = np.full((1024, 256), -1, dtype=np.int32)
        self.gain = np.zeros((1024, 256), dtype=np.int8)
        self.state(((0, -1, 0),))

    def state(self, items: tuple) -> int:
        if (k := self.index.get(items)) is None:
            k = self.index[items] = len(self.items)
            self.items.append(items)
            if k >= len(self.next):
                self.next = np.concatenate((self.next, np.full_like(self.next, -1)))
                self.gain = np.concatenate((self.gain, np.zeros_like(self.gain)))
        return k

    def encode(self, text: bytes) -> list[int]:
        """Plain merging by rank, of short byte strings."""
        ids = [self.single[b] for b in text]
        while len(ids) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def follows(self, a: int, b: int) -> bool:
        """Whether tokens a and b can stand side by side; a = -1: b stands at the start."""
        if a < 0:  # at the start; every token in the trie stays whole
            return True
        if (ok := self.pair_ok.get((a, b))) is None:
            if len(self.pair_ok) >= MAX_PAIRS:
                self.pair_ok.clear()
            ok = self.pair_ok[a, b] = self._follows(a, b) if self.ordered else self.encode(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return ok

    def _follows(self, a: int, b: int) -> bool:
        """Undo the later of both tokens' last merges, again and again: no merge across the seam may come before it.

        A merge across the seam that ranks before the one undone would have happened first. Between equals the left one
        goes first.
        """
        before = len(self.bytes_of) + 256  # ids order as ranks: a merge across the seam counts if its id is less
        while True:
            if (across := self.merges.get((a, b))) is not None and across[1] < before:
                return False
            for left in (True, False) if a > b else (False, True):
                if left and a in self.parts:
                    before, a = a, self.parts[a][1]
                    break
                if not left and b in self.parts:
                    before, b = b + 1, self.parts[b][0]
                    break
            else:
                return True

    def kind(self, node: int, before: int) -> int:
        """A stand-in for the token before an open start: starts with equal prospects share one; -2 if there are none."""
        if (tokens := self.below[node]) is None or before < -1:
            return before
        if (k := self.kinds.get((node, before))) is None:
            good = tuple(t for t in tokens if self.follows(before, t))
            if good:
                # the first token seen with these prospects stands for all of them
                k = self.kinds.setdefault((node, good), before)
            else:
                k = -2
            self.kinds[node, before] = k
        return k

    def transition(self, k: int, b: int) -> None:
        """Fill in one cell: where byte b leads from state k, and how the count changes."""
        found, kept = None, []
        for node, before, count in self.items[k]:
            if (to := self.edges[node].get(b)) is None:
                continue
            kept.append((to, before, count))
            t = self.token[to]
            if found is None and t >= 0 and self.follows(before, t):
                found = (t, count + 1)
        token, gain = found
        open_ = ((n, self.kind(n, t), c - gain) for n, t, c in kept if self.edges[n])
        items = (*(x for x in open_ if x[1] != -2), (0, token, 0))
        to = self.state(items)  # may enlarge the tables
        self.next[k, b], self.gain[k, b] = to, gain

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece data[start:end]; all pieces advance together, the long ones last."""
        if len(self.items) > MAX_STATES:
            self.clear()
        order = np.argsort(starts - ends, kind="stable")
        at, stop = starts[order], ends[order]
        size = stop - at
        now = np.zeros(len(order), dtype=np.int64)
        total = np.zeros(len(order), dtype=np.int64)
        step, live = 0, int(np.count_nonzero(size > 0))
        while live:
            b = data[at[:live] + step]
            key = now[:live] * 256 + b
            to = self.next.ravel()[key]
            new = np.flatnonzero(to < 0)
            if len(new):
                for cell in np.unique(key[new]).tolist():
                    self.transition(cell >> 8, cell & 255)
                to = self.next.ravel()[key]
            total[:live] += self.gain.ravel()[key]
            now[:live] = to
            step += 1
            live = int(np.searchsorted(-size[:live], -step, side="left"))
        out = np.empty(len(order), dtype=np.int64)
        out[order] = total
        return out


class Counter:
    """Counts the tokens of texts as the tokenizer file at ``path`` gives them."""

    def __init__(self, path: str, classes: np.ndarray | None = None) -> None:
        spec = json.loads(open(path, encoding="utf-8").read())
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.classes = point_classes(path) if classes is None else classes
        self.merger = Merger(path)

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; special strings in a text count one each, as the library takes them by default."""
        parts, owner, extra = [], [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            pieces = [text]
            for s in self.special:
                if s in text:
                    pieces = [y for x in pieces for y in x.split(s)]
            extra[i] = len(pieces) - 1
            for x in pieces:
                if x:
                    parts.append(x)
                    owner.append(i)
        if not parts:
            return extra
        points = np.frombuffer("\0".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        gaps = np.cumsum(size + 1)[:-1] - 1
        classes = self.classes[points]
        classes[gaps] = END
        cut = cuts(points, classes)
        cut[gaps] = True
        starts = np.flatnonzero(cut)
        keep = np.ones(len(points), dtype=bool)
        keep[gaps] = False
        # bytes of each code point give the place of each piece in the UTF-8 text
        width = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        place = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(width, out=place[1:])
        data = np.frombuffer("\0".join(parts).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        ends = np.append(starts[1:], len(points))
        real = keep[starts]
        part = np.searchsorted(gaps, starts[real], side="right")
        n = self.merger.counts(data, place[starts[real]], place[ends[real]])
        by_part = np.bincount(part, weights=n, minlength=len(parts)).astype(np.int64)
        return extra + np.bincount(np.array(owner), weights=by_part, minlength=len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, path: str, limit: int = 512, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit) of every text, without begin and end tokens.

    A map without shuffle. Null and empty texts have no bytes and no tokens; equal rows give equal rows; other columns are
    left out, whatever their names. An empty table gives no rows. ``path`` is a byte-level BPE tokenizer file, at the same
    place on every executor; the table of code point classes (1.1 MB, a fixed size) is made once and broadcast.
    """
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(point_classes(path).tobytes())
    kind = docs.schema[ids].dataType
    schema = f"`{ids}` {kind.simpleString()}, n_bytes bigint, n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache(f"counter {path}")
        if not kept:
            kept["counter"] = Counter(path, np.frombuffer(classes.value, dtype=np.uint8))
        count = kept["counter"]
        for batch in batches:
            for part in slices(batch, size=SLICE):
                texts = [x or "" for x in part.column(1).to_pylist()]
                size = pa.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(count(texts))], [ids, "n_bytes", "n_tokens"])
        released()

    rows = docs.select(F.col(ids), F.col(text).alias("text")).mapInArrow(run, schema)
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
