"""Erasure over all tables, stopped wherever it may be."""

import pytest

from brookledger.sources import erasure
from brookledger.sources.erasure import Table

TABLES = (Table("splits"), Table("sources", (), "txn_id", "ledger", "txn_id"), Table("missing"), Table("ledger", ("year_month", "kind")), Table("categories"))


def made(spark, folder):
    user = lambda k: None if k % 11 == 0 else k % 4
    ledger = [(k, user(k), f"2024-{1 + k % 3:02d}" if user(k) != 2 else "2024-09", "a" if k % 2 else "b") for k in range(60)]
    spark.createDataFrame(ledger, "txn_id long, user_id long, year_month string, kind string").write.partitionBy("year_month", "kind").parquet(f"{folder}/ledger")
    spark.createDataFrame([(k, k % 70) for k in range(140)], "source_id long, txn_id long").write.parquet(f"{folder}/sources")
    spark.createDataFrame([(k, user(k)) for k in range(30)], "split_id long, user_id long").write.parquet(f"{folder}/splits")
    spark.createDataFrame([(k, 2) for k in range(3)], "category_id long, user_id long").write.parquet(f"{folder}/categories")


def rows(spark, folder):
    return {t: {tuple(sorted(r.asDict().items(), key=str)) for r in spark.read.parquet(f"{folder}/{t}").collect()} for t in ("ledger", "sources", "splits", "categories")}


def without(before, user):
    ids = {dict(r)["txn_id"] for r in before["ledger"] if dict(r)["user_id"] == user}
    return {t: {r for r in some if (dict(r)["txn_id"] not in ids if t == "sources" else dict(r)["user_id"] != user)} for t, some in before.items()}


@pytest.mark.parametrize("stop", [None, 0, 1, 2, 3, 5, 7])
def test_erasure_goes_on_where_it_stopped(spark, tmp_path, monkeypatch, stop):
    """It is stopped before the line of the journal that is the ``stop``-th, and called again."""
    folder, journal = str(tmp_path / "t"), str(tmp_path / "journal")
    made(spark, folder)
    before = rows(spark, folder)
    if stop is not None:
        lines, add = [], erasure.Journal.add

        def failing(self, *what):
            if len(lines) == stop:
                raise RuntimeError("stopped")
            lines.append(what)
            add(self, *what)

        monkeypatch.setattr(erasure.Journal, "add", failing)
        with pytest.raises(RuntimeError):
            erasure.erase_user(spark, folder, 2, journal, TABLES)
        monkeypatch.undo()
    erasure.erase_user(spark, folder, 2, journal, TABLES)
    assert rows(spark, folder) == without(before, 2)
    assert erasure.erase_user(spark, folder, 2, journal, TABLES) == 0
    if stop is None:
        erasure.erase_user(spark, folder, 1, journal, TABLES)
        assert rows(spark, folder) == without(without(before, 2), 1)
