"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, ``://``, digits, plus signs, the cues of identifiers and the
names of streets. A deterministic parser for each kind expands an anchor to its left and right over the characters that its
kind allows, and validates the result (domain labels, octets, the Luhn and the mod-97 sum, word boundaries on both sides).

Kinds: email, ip, card and phone have the base patterns; the method adds address (a URL that names a user and a password),
account (a number or a code behind a cue: bank, identity, passport, licence, tax) and postal (house number, street, and the
place behind it). Where an added span starts inside another one it is left out, first come by kind as listed; base spans may overlap.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Base kinds in the order in which spans are listed; the kinds that the method adds follow.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account", "postal")
CUES = (
    "iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "ssn", "social security", "passport", "reisepass", "passeport", "pasaporte",
    "license", "licence", "tax id", "taxpayer id", "steuernummer", "national id", "identity card", "ausweis", "member id", "patient id", "dni", "nif",
)
#: Words that end (or, of those in ``FRONT``, begin) the name of a street.
STREETS = ("street", "avenue", "road", "boulevard", "lane", "drive", "strasse", "straße", "weg", "platz")
FRONT = ("rue", "calle", "avenida", "via")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+:[^\s/?#@]*@[A-Za-z0-9.-]+(?::[0-9]{1,5})?")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_LINK = r"(?:[ \t]+(?:no|number|nr|num|numbers?|nummer|id|code|is|was|of|my|ist|lautet|est|es|card)\b\.?){0,4}"
_AFTER_CUE = re.compile(rf"{_LINK}[ \t]*[:#=]?{_LINK}[ \t]*[:#=]?[ \t]*", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9]){5,17}(?![0-9])")
#: Letters and digits: 6 to 14, of which some are digits.
_CODE = re.compile(r"(?=[A-Z0-9-]*[0-9][A-Z0-9-]*[0-9])[A-Z0-9](?:-?[A-Z0-9]){5,13}(?![A-Za-z0-9])")
_NAME = r"[A-ZÀ-ÖØ-Þ][\w'’-]{0,30}"
_HOUSE = r"[0-9]{1,5}[A-Za-z]?"
_PLACE = re.compile(rf"(?:,?[ ](?:[0-9]{{4,5}}[ ])?{_NAME}(?:[ ]{_NAME}){{0,2}}(?:,?[ ][A-Z]{{2}})?(?:[ ][0-9]{{5}})?)?")
_BEFORE_STREET = re.compile(rf"(?<!\w)(?:({_HOUSE})[ ])?(?:{_NAME}[ -]){{0,3}}(?:{_NAME})?$")
_AFTER_STREET = re.compile(rf"[ ]{_HOUSE}(?!\w)")
_AFTER_FRONT = re.compile(rf"(?:[ ](?:de|du|des|la|le|del|della|di|l'))*(?:[ ]{_NAME}){{1,3}}")
_BEFORE_FRONT = re.compile(rf"(?<!\w){_HOUSE},?[ ]$")
#: Characters that a name of a street takes at most to the left of its anchor.
_REACH = 100


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str, anchors: list[int]) -> Iterator[Span]:
    """Leftmost, non-overlapping: an at-sign takes the longest local part that no earlier match holds."""
    done = 0
    for at in anchors:
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield Span("email", start, done)


def numbers(text: str, digits: list[int]) -> Iterator[Span]:
    """IP addresses and card numbers; ``digits`` are the places where a run of digits opens, and only there a match starts."""
    done = 0
    for at in digits:
        if at >= done and (m := _IP.match(text, at)):
            done = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                yield Span("ip", at, done)
    done = 0
    for at in digits:
        if at >= done and (m := _CARD.match(text, at)):
            done = m.end()
            code = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(code) <= 19 and luhn(code):
                yield Span("card", at, done)


def phones(text: str, anchors: list[int]) -> Iterator[Span]:
    done = 0
    for at in anchors:
        if at >= done and (m := _PHONE.match(text, at)):
            done = m.end()
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                yield Span("phone", at, done)


def addresses(text: str, anchors: list[int]) -> Iterator[Span]:
    """URLs whose authority names a user and a password; ``anchors`` are the places of ``://``."""
    for at in anchors:
        start = at
        while start > 0 and at - start < 20 and text[start - 1] in _SCHEME:
            start -= 1
        if start < at and (m := _USERINFO.match(text, at + 3)):
            yield Span("address", start, m.end())


def accounts(text: str, cues: list[tuple[int, int]]) -> Iterator[Span]:
    """Bank and identity numbers right behind a cue, a word of its own: an IBAN with a valid check sum, else 6 to 18 digits,
    else a code of capitals and digits."""
    done = 0
    for start, end in cues:
        if end < done or end < len(text) and (text[end].isalnum() or text[end] == "_") or start > 0 and (text[start - 1].isalnum() or text[start - 1] == "_"):
            continue
        at = _AFTER_CUE.match(text, end).end()
        if m := _IBAN.match(text, at):
            # the longest prefix that is valid, so a capitalised word behind it stays outside
            for stop in range(m.end(), at + 14, -1):
                code = text[at:stop].replace(" ", "")
                if 15 <= len(code) <= 34 and text[stop - 1] != " " and mod97(code):
                    done = stop
                    yield Span("account", at, stop)
                    break
            if done > at:
                continue
            if text[at + 4 : at + 5] == " ":  # an IBAN that fails its check
                continue
        if at > end and (both := [m for m in (_NUMBER.match(text, at), _CODE.match(text, at)) if m]):
            done = max(m.end() for m in both)
            yield Span("account", at, done)


def postals(text: str, ends: list[tuple[int, int]], fronts: list[tuple[int, int]]) -> Iterator[Span]:
    """Streets with a house number, and the place behind them; anchors are the places of words for streets."""
    done = 0
    for start, end in ends:
        if start < done or end < len(text) and text[end].isalnum():
            continue
        low = max(done, start - _REACH)
        m = _BEFORE_STREET.search(text[low:start]) if start > low else None
        left = low + m.start() if m else start
        # a name before the anchor, or one that it ends, as in German
        if not (text[left:start].strip() and (text[start].isupper() or text[start - 1].isalpha() or text[start - 1] == " " and text[start].islower() and m.group(1))):
            continue
        house = m.group(1)
        stop = end
        if not house:
            if not (n := _AFTER_STREET.match(text, end)):
                continue
            stop = n.end()
            left += len(text[left:start]) - len(text[left:start].lstrip())
        done = _PLACE.match(text, stop).end()
        yield Span("postal", left, done)
    done = 0
    for start, end in fronts:
        if start < done or start == 0 or text[start - 1].isalnum():
            continue
        if (m := _AFTER_FRONT.match(text, end)) and (h := _BEFORE_FRONT.search(text[max(0, start - 8) : start])):
            done = _PLACE.match(text, m.end()).end()
            yield Span("postal", max(0, start - 8) + h.start(), done)


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("digit", "0123456789"), ("://", ["://"]), ("cue", CUES), ("street", STREETS), ("front", FRONT)):
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def lower_ascii(text: str) -> str:
    """Lower case of the same length."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def find(text: str, ac) -> list[Span]:
    """All spans of a text, by kind as listed and then by start; offsets in code points, ends exclusive."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in ("@", "+", "digit", "://", "cue", "street", "front")}
    last = -2
    for end, (what, size) in ac.iter(lower_ascii(text)):
        if what == "digit":
            if end != last + 1:
                found[what].append((end, end + 1))
            last = end
        else:
            found[what].append((end + 1 - size, end + 1))
    at = {k: [start for start, _ in v] for k, v in found.items()}
    out: list[Span] = []
    if at["@"]:
        out += emails(text, at["@"])
    if at["digit"]:
        out += numbers(text, at["digit"])
        out += phones(text, at["+"])
    more: list[Span] = []
    if at["://"]:
        more += addresses(text, at["://"])
    if at["digit"]:
        more += accounts(text, found["cue"])
        more += postals(text, found["street"], found["front"])
    if not more:
        return out
    # of the spans added, those go that start inside another one, where neither is an address that holds the other
    held = sorted((s for s in out if s.kind != "email"), key=lambda s: s.start)
    starts, ends = [s.start for s in held], list(itertools.accumulate((s.end for s in held), max))
    kept: list[Span] = []
    for s in more:
        k = bisect.bisect_right(starts, s.start)
        if s.kind == "address" or not (k and ends[k - 1] > s.start):
            kept.append(s)
    reach: list[Span] = []
    done = 0
    for s in sorted(kept, key=lambda s: (s.start, KINDS.index(s.kind))):
        if s.start >= done:
            reach.append(s)
            done = s.end
    return out + sorted(reach, key=lambda s: (KINDS.index(s.kind), s.start))


def spans(docs: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, spans array of (kind, start, end)), one per row of ``docs``, by kind as listed, then by start.

    A map without shuffle over whole texts. Null and empty texts have no spans (an empty array); repeated rows repeat;
    other columns are left out. Every parser reads a character a bounded number of times, so very long texts cost in
    proportion to their length.
    """
    kind = docs.schema[ids].dataType.simpleString()
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ac = automaton()
        for batch in batches:
            for part in slices(batch):
                found = [[s._asdict() for s in find(x, ac)] if x else [] for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, item)], [ids, "spans"])

    rows = docs.select(F.col(ids), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{ids}` {kind}, spans array<struct<kind:string,start:int,end:int>>")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
