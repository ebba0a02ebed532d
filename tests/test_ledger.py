"""Tables that survive a write that dies and a batch that comes again."""

import pytest

from barwright.sources.ledger import Conflict, Ledger, Manifest

SCHEMA = "k long, v long, n long"


def rows(spark, *given):
    return spark.createDataFrame([*given], SCHEMA)


def values(table):
    return sorted(tuple(r) for r in table.read().collect())


def dies(monkeypatch, table):
    """The next commit of the table fails after its data is written."""
    commit = table._commit

    def fail(made):
        monkeypatch.setattr(table, "_commit", commit)
        raise RuntimeError("killed before the commit")

    monkeypatch.setattr(table, "_commit", fail)


def test_append_dies_and_is_replayed(spark, tmp_path, monkeypatch):
    table = Ledger(spark, str(tmp_path / "t"))
    assert table.read() is None
    assert table.append(rows(spark, (1, 1, 1)), "s", 0)
    dies(monkeypatch, table)
    with pytest.raises(RuntimeError, match="killed"):
        table.append(rows(spark, (2, 2, 2)), "s", 1)
    assert values(table) == [(1, 1, 1)]
    assert table.append(rows(spark, (2, 2, 2)), "s", 1) and not table.append(rows(spark, (2, 2, 2)), "s", 1)
    assert table.append(rows(spark, (3, 3, 3)), "other", 0) and values(table) == [(1, 1, 1), (2, 2, 2), (3, 3, 3)]


def test_upsert_dies_and_is_replayed(spark, tmp_path, monkeypatch):
    table = Ledger(spark, str(tmp_path / "t"))
    assert table.upsert(rows(spark, (1, 10, 1), (2, 20, 1), (2, 21, 2)), ["k"], "n", "s", 0, buckets=3)
    before = values(table)
    dies(monkeypatch, table)
    with pytest.raises(RuntimeError, match="killed"):
        table.upsert(rows(spark, (2, 99, 3), (4, 40, 1)), ["k"], "n", "s", 1)
    assert values(table) == before == [(1, 10, 1), (2, 21, 2)]
    for done in (True, False):
        assert table.upsert(rows(spark, (2, 99, 3), (4, 40, 1), (1, 9, 0)), ["k"], "n", "s", 1, buckets=7) is done
    assert values(table) == [(1, 10, 1), (2, 99, 3), (4, 40, 1)] and table.manifest().buckets == 3


def test_buckets_split(spark, tmp_path):
    table = Ledger(spark, str(tmp_path / "t"))
    table.upsert(rows(spark, *((i, i, 1) for i in range(50))), ["k"], "n", buckets=2)
    table.split(["k"], 3)
    table.upsert(rows(spark, (7, 70, 2), (60, 60, 1)), ["k"], "n", buckets=2)
    assert table.manifest().buckets == 6 and values(table) == sorted([(i, 70 if i == 7 else i, 2 if i == 7 else 1) for i in range(50)] + [(60, 60, 1)])


def test_two_writers_of_one_version_conflict(spark, tmp_path):
    table = Ledger(spark, str(tmp_path / "t"))
    table.append(rows(spark, (1, 1, 1)))
    with pytest.raises(Conflict):
        table._commit(Manifest(1, SCHEMA, 1, {"0": []}, {}))
    assert values(table) == [(1, 1, 1)]


def test_a_stream_restarted_without_its_checkpoint_adds_nothing(spark, tmp_path):
    table = Ledger(spark, str(tmp_path / "t"))
    rows(spark, (1, 1, 1), (2, 2, 2)).coalesce(1).write.parquet(str(tmp_path / "in"))
    for turn in range(2):
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(table.sink("feed")).option("checkpointLocation", str(tmp_path / f"c{turn}")).trigger(availableNow=True).start().awaitTermination()
    assert values(table) == [(1, 1, 1), (2, 2, 2)]
    empty = table.append(rows(spark, (0, 0, 0)).where("false"), "feed", 9)
    assert empty and values(table) == [(1, 1, 1), (2, 2, 2)]
