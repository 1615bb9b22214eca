"""What writes send, move and sort, by the plans that ran."""

import re

import pytest

from tessera.errors import ConstraintError
from tessera.model import Field, Model
from tessera.sources.engine import Engine


class PItems(Model, table="p_items"):
    id = Field("bigint", pk=True)
    name = Field("string")


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, warehouse=str(tmp_path / "w"))
    e.create(PItems, spark.range(1000).selectExpr("id", "concat('n', id) AS name").repartition(2))
    return e


@pytest.fixture
def ran(spark):
    """Runs something and gives the plans of its queries."""
    store = spark._jsparkSession.sharedState().statusStore()

    def run(work):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        seen = {x.executionId() for x in _each(store.executionsList())}
        work()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return [x.physicalPlanDescription() for x in _each(store.executionsList()) if x.executionId() not in seen]

    return run


def _each(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _sent(plan):
    """What lies below each broadcast of a plan."""
    tree = plan.split("Initial Plan")[0].split("\n\n")[0].splitlines()
    depth = lambda x: re.search(r"[A-Z]", x).start() if re.search(r"[A-Z]", x) else 0
    for i, line in enumerate(tree):
        if "BroadcastExchange" in line:
            below = next((j for j in range(i + 1, len(tree)) if depth(tree[j]) <= depth(line)), len(tree))
            yield "\n".join(tree[i + 1 : below])


def test_few_keys_are_sent_and_the_table_streams(engine, ran):
    for work in (
        lambda: engine.insert(PItems(id=-1, name="x")).execute(),
        lambda: engine.insert_batch(PItems, [PItems(id=5, name="x"), PItems(id=2000, name="y")]).on_conflict_do_nothing([PItems.id]).execute(),
    ):
        plans = [p for p in ran(work) if "LeftSemi" in p]
        # with the table on the right its keys were sent to all tasks, or shuffled and sorted
        assert plans and not any("SortMergeJoin LeftSemi" in p for p in plans)
        assert not any("Scan parquet" in x and "LeftSemi" not in x for p in plans for x in _sent(p))
    with pytest.raises(ConstraintError):
        engine.insert(PItems(id=7, name="again")).execute()
    rows = {r.id: r.name for r in engine.query(PItems).all()}
    assert len(rows) == 1002 and rows[5] == "n5" and rows[2000] == "y"


def test_parts_are_written_without_a_sort(engine, ran, spark):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    plans = ran(lambda: engine.delete(PItems).where(PItems.id < 10).execute())
    writes = [p for p in plans if "WriteFiles" in p or "InsertIntoHadoopFs" in p]
    assert writes and not any(re.search(r"\bSort\b", p) for p in writes)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert sorted(r.id for r in engine.query(PItems).all()) == list(range(10, 1000))
    engine.insert_batch(PItems, [PItems(id=10, name="ten"), PItems(id=1, name="one")]).on_conflict([PItems.id], [PItems.name]).execute()
    rows = {r.id: r.name for r in engine.query(PItems).all()}
    assert len(rows) == 991 and rows[10] == "ten" and rows[1] == "one" and rows[11] == "n11"


def test_conditions_reach_the_files_that_are_searched(engine, ran):
    plans = ran(lambda: engine.delete(PItems).where(PItems.id < 10).execute())
    searched = [p for p in plans if "input_file_name" in p]
    assert searched and all("LessThan(id,10)" in p for p in searched)
