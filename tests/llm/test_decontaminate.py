import random

import tessera.llm.decontaminate as d
from tessera.llm.decontaminate import Index, clean, leaks, split_item, words

from .conftest import DATA, frame, needs_data


def vocabulary(rnd, n):
    return ["".join(rnd.choices("abcdefghijklm", k=rnd.randint(2, 9))) for _ in range(n)]


def brute(index, items, text):
    """Every passage scored against every item, and verified."""
    x, out = words(text), {}
    for start in range(0, max(1, len(x)), index.stride):
        passage = x[start : start + 2 * index.stride]
        have = {index.term[w] for w in passage if w in index.term}
        for i, (item, q, a) in enumerate(items):
            score = sum(w for t, j, w in zip(index.terms_, index.items, index.weights) if j == i and t in have)
            if score >= index.threshold - 1e-9:
                ov = [p.overlap({n: d.ngrams(passage, n) for n in (1, 2, 3)} | {0: set()}) for p in index.parts[i]]
                if min(ov) >= d.OVERLAP:
                    out[item] = max(out.get(item, 0), round(score, 9))
    return out


def test_against_brute_force(monkeypatch):
    rnd = random.Random(1)
    monkeypatch.setattr(d, "ITEMS_PER_BLOCK", 4)
    common, rare = vocabulary(rnd, 30), vocabulary(rnd, 2000)
    item = lambda: rnd.choices(common, k=rnd.randint(3, 20)) + rnd.choices(rare, k=rnd.randint(2, 20))
    items = []
    for i in range(40):
        w = item()
        rnd.shuffle(w)
        items.append((i, *split_item(w)))
    index = Index(items)
    import numpy as np

    index.terms_ = np.repeat(np.arange(len(index.first) - 1), np.diff(index.first))
    found = 0
    for _ in range(250):
        text = rnd.choices(common, k=rnd.randint(0, 150)) + rnd.choices(rare, k=rnd.randint(0, 30))
        rnd.shuffle(text)
        if rnd.random() < 0.7:
            i, q, a = rnd.choice(items)
            leak = list(q + a)
            for _ in range(rnd.randint(0, 5)):
                leak[rnd.randrange(len(leak))] = rnd.choice(rare)
            at = rnd.randint(0, len(text))
            text[at:at] = leak
        text = " ".join(text)
        got = {i: round(s, 9) for i, s, _, _ in index.search(text)}
        assert got == brute(index, items, text)
        found += len(got)
    assert found > 60


def test_rows(spark, monkeypatch):
    bench = [(1, "What is the tallest mountain on the moon? It is Mons Huygens near the rim"), (2, "one two three four five six seven eight"), (3, None), (4, ""), (2, "one two three four five six seven eight")]
    rows = [(10, "Before. WHAT is the tallest mountain on the moon?\nIt is Mons Huygens near the rim! after"), (11, None), (12, ""), (13, "what is the moon and the rim of it"), (None, "zero one two three four five six seven eight nine"), (14, "filler " * 60_000 + bench[1][1]), (10, "clean")]
    df = frame(spark, rows).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "score")
    benchmark = spark.createDataFrame(bench, "item_id bigint, text string")
    got = sorted(map(str, ((r.doc_id, r.item_id) for r in leaks(df, benchmark).collect())))
    want = sorted(map(str, [(10, 1), (None, 2), (None, 2), (14, 2), (14, 2)]))
    assert got == want
    monkeypatch.setattr(d, "MAX_ITEMS", 1)
    assert sorted(map(str, ((r.doc_id, r.item_id) for r in leaks(df, benchmark).collect()))) == want
    assert leaks(df.limit(0), benchmark).count() == leaks(df, benchmark.limit(0)).count() == 0
    # an id goes with all of its rows
    assert sorted(str(r.doc_id) for r in clean(df, benchmark).collect()) == ["11", "12", "13", "None"]
    split = spark.createDataFrame([(7, "what is the tallest mountain", "mons huygens near the rim")], "item_id bigint, question string, answer string")
    assert [(r.doc_id, r.item_id) for r in leaks(df, split).collect()] == [(10, 7)]


def test_cut_items_are_found(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    others = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(2, 40)]
    benchmark = spark.createDataFrame([(1, item), *others], "item_id bigint, text string")
    x = item.split()
    rows = [(1, " ".join(["before", *x[:15], "after"])), (2, " ".join(x[6:])), (3, item), (4, " ".join(x[:8])), (5, " ".join(sorted(x)))]
    assert sorted((r.doc_id, r.item_id) for r in leaks(frame(spark, rows), benchmark).collect()) == [(1, 1), (2, 1), (3, 1)]


def test_blocks_of_items_score_like_one_index(spark, monkeypatch):
    rnd = random.Random(9)
    common, rare = vocabulary(rnd, 20), vocabulary(rnd, 300)
    items = [(i, rnd.choices(common, k=rnd.randint(2, 30)) + rnd.choices(rare, k=rnd.randint(2, 20))) for i in range(30)]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    df = frame(spark, [(i, " ".join(rnd.choices(common, k=30) + w[: rnd.randint(3 * len(w) // 4, len(w))] + rnd.choices(rare, k=5))) for i, w in items])
    found = lambda: sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in leaks(df, benchmark).collect())
    want = found()
    monkeypatch.setattr(d, "MAX_ITEMS", 7)
    assert len(want) > 10 and found() == want


def test_items_held_in_both_parts_only():
    x = [f"w{k}" for k in range(9)]
    index = Index([(1, x, []), *((i, [f"v{i}x{k}" for k in range(9)], []) for i in range(2, 9))])
    # 3 of 4 trigrams of the first part and the one of the second, but 4 of 7 of the whole
    assert [i for i, *_ in index.search(" ".join([*x[:5], "gap", *x[6:]]))] == [1]


def test_rows_without_ids_are_judged_on_demand(spark):
    item = "one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = [(None, f"so {item} end"), (None, f"so {item} end"), (None, "clean"), (None, None), (4, item), (4, "other"), (5, "clean")]
    df = frame(spark, rows).withColumnRenamed("lang", "item_id")
    got = sorted(((r.doc_id, r.text) for r in clean(df, benchmark, null_ids="judge").collect()), key=str)
    assert got == sorted([(None, "clean"), (None, None), (5, "clean")], key=str)
    assert clean(df, benchmark.limit(0), null_ids="judge").count() == len(rows)


@needs_data
def test_on_the_tables(spark):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    plain = lambda s: " ".join(s.split())
    want = {(r.doc_id, b.item_id) for r in docs.collect() for b in bench.collect() if plain(b.text) in plain(r.text)}
    assert {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()} == want
