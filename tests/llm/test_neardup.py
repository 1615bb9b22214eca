import random
import re

import pytest

import tessera.llm.neardup as neardup
from tessera.llm.neardup import deduplicated, found_groups, groups, marked, prepared, shingles

from .conftest import DATA, frame, needs_data


def word_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """component and set size of each id, ids without nulls."""
    sets = {i: word_sets(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, n_groups=12, copies=14, n_words=120):
    """Groups of edited copies with similarities around the threshold, exact copies, and a passage that many share."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 6)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for _ in range(n_groups):
        base = [word() for _ in range(rnd.randint(6, n_words))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 12))):
                w[rnd.randrange(len(w))] = word()
            text = " ".join(w)
            rows.append(passage + " " + text if rnd.random() < 0.3 else text.upper() if rnd.random() < 0.2 else text)
    rows += [rows[0]] * 9 + ["", " \n", "one", "One", "one two three four", "a b c d e", "A  b\tc\nd\x0be", "x y z " * 9000]
    rnd.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)] + [(10_000, None)]


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 5)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "COLUMNS", 64)
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in groups(frame(spark, rows)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("block", [512, 5])
def test_exact_groups_leave_nothing_to_sketches(spark, monkeypatch, block):
    """Sketches so short that they lose most links change nothing where sets are kept whole."""
    monkeypatch.setattr(neardup, "K", 3)
    monkeypatch.setattr(neardup, "MIN_SHARED", 3)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus(3)
    want = brute(rows)
    df = frame(spark, rows)
    by = lambda found: {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert by(groups(df, exact=True)) == want
    assert by(groups(df)) != want
    kept = {i for i, (n, c) in want.items() if not n or i == c}
    assert {r.doc_id for r in deduplicated(df, exact=True).collect()} == kept


def test_many_far_copies(spark):
    """A hub with copies too far from it, some of which are near one another."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdefghij", k=5))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rnd.randint(0, 14)):
            w[rnd.randrange(150)] = word()
        rows.append((i, " ".join(w)))
        if i % 20 == 0:
            w[3] = "other"
            rows.append((1000 + i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in groups(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_edge_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away"
    rows = [(5, text), (5, text), (3, text + " now"), (None, text), (None, None), (7, "something else entirely is written in this row"), (7, "and a second text that shares its id with others here")]
    df = frame(spark, rows).withColumnRenamed("lang", "rep").withColumnRenamed("source", "component_id")
    got = sorted(map(str, groups(df).collect()))
    assert len(got) == len(rows)
    by = {}
    for r in groups(df).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for r in by[5]} == {3} and not any(r.kept for r in by[5]) and by[3][0].kept
    assert sorted(str(r.component_id) for r in by[None]) == ["3", "None"]
    assert {r.component_id for r in by[7]} == {7}
    left = deduplicated(df)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == ["3", "7", "7", "None", "None"]
    assert groups(df.limit(0)).count() == 0 and deduplicated(df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    rnd = random.Random(8)
    x, y, z = (" ".join(rnd.choices("abcdefghijklmnop", k=40)) for _ in range(3))
    near = lambda t: t + " end"
    rows = [(5, x), (5, y), (9, y), (12, y), (13, near(y)), (None, z), (None, near(z)), (20, near(z) + " too"), (20, near(z) + " too"), (30, x)]
    df = frame(spark, rows)
    got = sorted(((str(r.doc_id), r.component_id) for r in groups(df).collect()), key=str)
    assert got == sorted([("5", 5), ("5", 5), ("9", 5), ("12", 5), ("13", 5), ("30", 5), ("None", 20), ("None", 20), ("20", 20), ("20", 20)], key=str)
    left = sorted(((r.doc_id, r.text) for r in deduplicated(df).collect()), key=str)
    assert left == sorted([(5, x), (5, y), (20, near(z) + " too"), (None, z), (None, near(z))], key=str)
    assert deduplicated(frame(spark, [(1, x), (1, x), (2, None), (2, None)])).count() == 3


def test_shingles():
    texts = ["a b c d e f", "A b  c\td e f", "a b", "", "é É x y z", None]
    got = shingles([(t or "").encode() for t in texts])
    assert [len(x) for x in got] == [len(word_sets(t)) for t in texts]
    assert got[0].tolist() == got[1].tolist() and got[2].tolist() != got[0].tolist()


@needs_data
def test_on_the_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in groups(docs).collect()} == brute(rows)


def test_rows_without_ids_are_judged_on_demand(spark):
    """Against a brute-force version: of each group the row of the least (null last, id, hash) stays once."""
    rnd = random.Random(11)
    x, y, z, u = (" ".join(rnd.choices("abcdefghijklmnop", k=40)) for _ in range(4))
    near = lambda t: t + " end"
    rows = [(5, x), (5, x), (5, y), (9, near(y)), (None, x), (None, x), (None, z), (None, near(z)), (None, z), (7, u), (None, near(u)), (None, None), (None, ""), (3, None)]
    df = frame(spark, rows).withColumnRenamed("lang", "component")
    left = sorted(((r.doc_id, r.text) for r in deduplicated(df, null_ids="judge").collect()), key=str)
    groups_ = [[(5, x), (None, x)], [(5, y), (9, near(y))], [(None, z), (None, near(z))], [(7, u), (None, near(u))]]
    named = [g for g in groups_ if g[0][0] is not None]
    assert [r for r in left if r[0] is not None] == sorted([g[0] for g in named] + [(3, None)], key=str)
    nulls = [t for i, t in left if i is None]
    assert sum(t in (z, near(z)) for t in nulls) == 1 and not {x, near(u)} & set(nulls) and sorted(map(str, nulls))[:2] == ["", "None"] and len(nulls) == 3
    assert deduplicated(df.limit(0), null_ids="judge").count() == 0


def test_marked_rows_are_all_the_wanted_and_few_others(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("if(id = 7, null, id) as i", "id * 3 as h")
    wanted = rows.where("i is null or i % 1000 = 1").selectExpr("i as a", "h as b")
    need = {(r.a, r.b) for r in wanted.collect()}
    got = [(r.i, r.h) for r in marked(rows, ["i", "h"], wanted, ["a", "b"]).collect()]
    assert len(got) == len(set(got)) and need <= set(got) and len(got) < 3_000
    monkeypatch.setattr(neardup, "MAP_WORDS", 1)
    assert need <= {(r.i, r.h) for r in marked(rows, ["i", "h"], wanted, ["a", "b"]).collect()}
    assert not marked(rows, ["i", "h"], wanted.limit(0), ["a", "b"]).collect()


def test_disk_is_given_back_on_the_way(spark, monkeypatch):
    """No shuffle outlives its step, all shingles of sets are counted once, and a map of bits takes texts for them."""
    plans, staged = [], neardup.staged

    def seen(df, what):
        plans.append((what, df._jdf.queryExecution().analyzed().toString()))
        return staged(df, what)

    monkeypatch.setattr(neardup, "staged", seen)
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    df = frame(spark, corpus(1))
    before = tracker.shuffleStatuses().size()
    found = found_groups(prepared(df))
    assert tracker.shuffleStatuses().size() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert found.count() == df.count()
    assert [w for w, p in plans if "explode(set#" in p] == ["able"]
    assert [w for w, p in plans if "bit_or(" in p and "text#" in p] == ["sets"]
