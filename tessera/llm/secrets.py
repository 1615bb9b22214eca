"""Secret scans by character Markov models, in DataFrame operations only.

Two first-order models over characters, one of random strings and one of ordinary identifiers and words, are trained from
labelled samples. A candidate is a long run of key characters; the log-likelihood ratio of both models, summed over its
transitions, decides. Patterns for assignments, access keys and hexadecimal keys give the base spans; these are cut out of the
candidates, and what is left of them and the models take for random is added as kind ``markov``.

Spark's regular expressions tell no offsets. They follow from the pieces between matches (``split``) and the matches
(``regexp_extract_all``), whose lengths alternate; both run only over texts that have a match.
"""

from __future__ import annotations

import random
import string
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: Base kinds in the order in which spans at one place are listed.
BASE = ("assign", "access", "hex")
MIN_TOKEN = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{{{MIN_TOKEN},}}"
#: An identifier that is random, but no secret.
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
#: Sum of the log-likelihood ratio (nats) from which a candidate counts as random: odds of one in three million.
THRESHOLD = 15.0
ALPHABET = string.ascii_letters + string.digits + "+/=_-"
#: Symbols of the models: 0 is any other character.
SIZE = len(ALPHABET) + 1

WORDS = (
    "account action active address admin agent alert align amount anchor answer append array asset async audio author backup balance "
    "banner base batch binary block border bottom bridge browser bucket buffer build button cache callback camera cancel canvas carbon "
    "center change channel check child choice class clean client close cloud cluster code color column command comment commit common "
    "compare compile config connect console contact container content context control convert copy count country create cursor custom "
    "data database date default delete deploy design detail device dialog digest direct display document domain download driver edit "
    "element email empty enable engine entry error event example exception execute export factory false field file filter final first "
    "folder font format forward frame function gateway general global graph group handler header height history home host image import "
    "index input insert instance integer internal invoice item iterator join kernel label language layer layout length level library "
    "license limit line link list loader local location logger login machine manager mapping master matrix member memory message method "
    "metric migration minute mobile model module monitor mount name namespace native network node normal note notification number "
    "object offset online operation option order origin output owner package page parameter parent parser partition password path "
    "pattern payload payment pipeline plugin pointer policy pool port position prefix preview price primary printer priority process "
    "product profile project property protocol provider proxy public publish quality quantity query queue quick quota radius random "
    "range rating reader record redirect reference region register release remote render replica report request reset resource "
    "response result retry return review role rollback root route runtime sample schedule schema scope screen script search section "
    "security select sequence server service session setting shadow shard shared signal simple single socket source space span "
    "stack stage standard start state static status storage stream string style subject submit summary support switch symbol sync "
    "system table target task template tenant terminal test thread ticket time title toggle topic total track transaction transfer "
    "transform tree trigger tuple type unique unit update upload usage user utility validate value variable vector vendor version "
    "video view virtual visible volume wait warning watch weight widget width window worker wrapper write yaml year yield zone zoom"
).split()


def samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled samples made by rule: 1 for random strings over the alphabets of keys, 0 for identifiers and words."""
    rnd = random.Random(seed)
    keys = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.hexdigits[:16], string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-"]
    out = [("".join(rnd.choices(rnd.choice(keys), k=rnd.randint(20, 64))), 1) for _ in range(n)]
    forms = [
        lambda w: "_".join(w),
        lambda w: "-".join(w),
        lambda w: w[0] + "".join(x.title() for x in w[1:]),
        lambda w: "".join(x.title() for x in w),
        lambda w: "_".join(w).upper(),
        lambda w: "/".join(w),
        lambda w: "".join(w),
        lambda w: "".join(w).upper(),
        lambda w: "/".join(w) + f"/{rnd.randint(1, 9999)}",
        lambda w: "_".join(w) + f"_{rnd.randint(0, 99)}",
        lambda w: f"20{rnd.randint(10, 30)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}-" + "-".join(w),
        lambda w: "=" * rnd.randint(20, 60),
        lambda w: "-" * rnd.randint(20, 60),
        lambda w: "_" * rnd.randint(20, 60),
    ]
    out += [(rnd.choice(forms)(rnd.choices(WORDS, k=rnd.randint(2, 6))), 0) for _ in range(2 * n)]
    # words of other languages: any consonants and vowels in turn, so unseen words stay likelier than random ones
    syllables = [a + b + c for a in ("", *"bcdfghjklmnpqrstvwz", "th", "st", "ch", "qu", "pr") for b in "aeiou" for c in ("", *"nrstl", "nd", "ng", "tion")]
    out += [("".join(rnd.choices(syllables, k=rnd.randint(6, 14))), 0) for _ in range(n)]
    return out


def train(labelled: Iterable[tuple[str, int]]) -> np.ndarray:
    """The table of log-likelihood ratios, random over ordinary, by (symbol, next symbol); add-one smoothing."""
    at = {c: i + 1 for i, c in enumerate(ALPHABET)}
    seen = np.ones((2, SIZE, SIZE))
    for text, label in labelled:
        codes = [at.get(c, 0) for c in text]
        np.add.at(seen[int(label)], (codes[:-1], codes[1:]), 1)
    p = np.log(seen / seen.sum(axis=2, keepdims=True))
    return p[1] - p[0]


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Prefix results of an associative function over an array, by doubling: n log n steps for n values, and no array is
    built value by value. ``combine`` gets null where there is nothing before."""
    gaps = F.filter(F.lit([1 << i for i in range(31)]), lambda g: g < F.size(values))
    return F.aggregate(gaps, values, lambda acc, g: F.transform(acc, lambda x, i: combine(x, F.get(acc, i - g))))


def total(values: Column) -> Column:
    return running(values, lambda x, before: x + F.coalesce(before, F.lit(0)))


def most(values: Column) -> Column:
    return running(values, lambda x, before: F.greatest(x, before))


def first_not(values: Column, test: Callable[[Column], Column]) -> Column:
    """How many values at the front of an array pass a test that none behind passes, by bisection."""
    steps = F.filter(F.lit([1 << i for i in reversed(range(31))]), lambda g: g <= F.size(values))
    return F.aggregate(steps, F.lit(0), lambda n, g: F.when(F.coalesce(test(F.get(values, n + g - 1)), F.lit(False)), n + g).otherwise(n))


def found(df: DataFrame, text: str, pattern: str, out: str, maybe: Column | None = None) -> DataFrame:
    """``df`` with ``out``: array of (start, end, value) of the matches of ``pattern`` in a column; null where there are none."""
    hit = F.col(text).rlike(pattern)
    if maybe is not None:
        hit = maybe & hit
    gap, value, end = f"{out}_gap", f"{out}_value", f"{out}_end"
    # lengths of the pieces before matches and of the matches; steps are columns of their own, so none is evaluated twice
    df = df.withColumns({value: F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), gap: F.when(hit, F.transform(F.split(F.col(text), pattern, -1), F.char_length))})
    df = df.withColumn(end, total(F.zip_with(F.slice(gap, 1, F.size(value)), F.col(value), lambda g, v: g + F.char_length(v))))
    match = F.zip_with(end, value, lambda e, v: F.struct((e - F.char_length(v)).alias("start"), e.alias("end"), v.alias("value")))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), match)).drop(gap, value, end)


def ratio(token: Column, table_: Column, codes: Column) -> Column:
    """The summed log-likelihood ratio of a string."""
    code = lambda i: F.coalesce(F.get(codes, F.ascii(F.substring(token, i, F.lit(1)))), F.lit(0))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.get(table_, code(i) * SIZE + code(i + 1)))


def scan(docs: DataFrame, llr: np.ndarray | None = None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with secrets_: array of (start, pos, kind, end), sorted; offsets in code points, ends exclusive.

    A narrow projection over whole texts: no shuffle, no Python on executors. Null and empty texts get an empty array;
    repeated rows repeat; other columns stay, whatever their names but secrets_ and those that end in ``_tsx``. ``llr`` is
    the table of ``train``; without it one is trained from ``samples()``.
    """
    llr = train(samples()) if llr is None else llr
    codes = F.lit([ALPHABET.find(chr(c)) + 1 for c in range(128)])
    scores = F.lit([float(x) for x in np.round(llr, 6).ravel()])
    t, df = F.col(text), docs
    for out, pattern, maybe in (("assign", ASSIGN, t.contains(":") | t.contains("=")), ("access", ACCESS, t.contains("AKIA")), ("hex", HEX, None), ("token", CANDIDATE, None)):
        df = found(df, text, pattern, f"{out}_tsx", maybe)
    value = lambda x: x["value"]
    ok = {
        "assign": lambda x: F.char_length(F.regexp_extract(value(x), ASSIGN, 1)) >= 6,
        "access": lambda x: F.char_length(value(x)) >= 20,
        "hex": lambda x: F.char_length(value(x)) >= 24,
    }
    empty = F.array().cast("array<struct<start:int,pos:int,kind:string,end:int>>")

    def spans(name: str, pos: int, test) -> Column:
        rows = F.transform(F.filter(f"{name}_tsx", test), lambda x: F.struct(x["start"].alias("start"), F.lit(pos).alias("pos"), F.lit(name if name != "token" else "markov").alias("kind"), x["end"].alias("end")))
        return F.coalesce(rows, empty)

    df = df.withColumn("base_tsx", F.array_sort(F.concat(*(spans(k, i, ok[k]) for i, k in enumerate(BASE)))))
    df = df.withColumn("reach_tsx", most(F.transform("base_tsx", lambda b: b["end"])))  # how far spans up to each one reach

    def free(x: Column) -> Column:
        """The parts of a candidate outside of base spans that are long enough."""
        # spans are sorted by their start, so those that can touch it stand together
        lo = first_not(F.col("reach_tsx"), lambda e: e <= x["start"])
        hi = first_not(F.col("base_tsx"), lambda b: b["start"] < x["end"])
        touching = F.filter(F.slice("base_tsx", lo + 1, F.greatest(hi - lo, F.lit(0))), lambda b: x["start"] < b["end"])
        first = F.struct(x["start"].alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

        def part(acc: Column, end: Column) -> Column:
            cut = F.struct(acc["at"].alias("start"), end.alias("end"), F.substring(value(x), acc["at"] - x["start"] + 1, end - acc["at"]).alias("value"))
            return F.when(end - acc["at"] >= MIN_TOKEN, F.concat(acc["out"], F.array(cut))).otherwise(acc["out"])

        step = lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), part(acc, b["start"]).alias("out"))
        return F.when(F.size(touching) == 0, F.array(x)).otherwise(F.aggregate(touching, first, step, lambda acc: part(acc, x["end"])))

    random_ = lambda x: ~value(x).rlike(UUID) & (ratio(value(x), scores, codes) >= threshold)
    df = df.withColumn("token_tsx", F.when(F.size("base_tsx") > 0, F.flatten(F.transform("token_tsx", free))).otherwise(F.col("token_tsx")))
    more = F.when(F.col("token_tsx").isNotNull(), spans("token", len(BASE), random_)).otherwise(empty)
    df = df.withColumn("secrets_", F.array_sort(F.concat("base_tsx", more)))
    return df.drop("assign_tsx", "access_tsx", "hex_tsx", "token_tsx", "base_tsx", "reach_tsx")


def redacted(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", chars: str = "n_chars") -> DataFrame:
    """``docs`` with every secret of ``scan`` in ``text`` replaced by a mask; overlapping spans are replaced as one. A column
    ``chars`` is set to the new length.

    Every row stays, with its other columns, whatever their names but those that end in ``_tsx`` or ``secrets_``; null texts
    stay null and empty ones empty; repeated rows are masked alike; an empty table gives no rows. Very long texts with very
    many secrets cost in proportion to their length, but for a logarithm.
    """
    df = scan(docs, text=text).withColumn("reach_tsx", most(F.transform("secrets_", lambda s: s["end"])))
    # as an array of code points, parts of the text are found without reading what is before them
    df = df.withColumn("chars_tsx", F.when(F.size("secrets_") > 0, F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))))
    part = lambda lo, hi: F.array_join(F.slice("chars_tsx", lo + 1, F.greatest(hi - lo, F.lit(0))), "")
    before = lambda i: F.coalesce(F.get("reach_tsx", i - 1), F.lit(0))
    masked = F.transform("secrets_", lambda s, i: F.when(s["start"] >= before(i), F.concat(part(before(i), s["start"]), F.lit(mask))).otherwise(""))
    clean = F.concat(F.array_join(masked, ""), part(F.element_at("reach_tsx", -1), F.size("chars_tsx")))
    df = df.withColumn(text, F.when(F.size("secrets_") > 0, clean).otherwise(F.col(text))).drop("secrets_", "reach_tsx", "chars_tsx")
    return df.withColumn(chars, F.when(F.col(text).isNotNull(), F.char_length(text)).otherwise(F.col(chars)).cast(docs.schema[chars].dataType)) if chars in docs.columns else df


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets_")
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("secrets_", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("secrets_", lambda s: s["kind"].isin(*BASE))
    return df.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets_")).alias("spans"))
