"""Every query runs, and equals its SQL where it has one."""

import pytest
from comparing import assert_same, connected
from conftest import DATA

from landsight import catalogue

SF = DATA / "sf0.001"


@pytest.fixture(scope="module")
def con():
    return connected(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert_same(catalogue.queries()[name](spark, str(SF)), con, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, str(SF)).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(entry.queries())


def test_tables_of_the_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from landsight import storage

    before = storage.written()
    one, two = (storage.stored(spark.range(n), "x") for n in (3, 4))
    storage.forget_others(spark, before, two)
    assert storage.written() == [*before, two._landsight_path] and two.count() == 4
    storage.forget(one, two)
    assert storage.written() == before
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://a:1"))
    with pytest.raises(RuntimeError):
        storage.shared_folder(unset)
