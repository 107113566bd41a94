"""What the entry gives: queries with SQL, and a package that workers find."""

import zipfile
from pathlib import Path

import __spark_entry__ as entry
from marlstone import session


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["genre", "avg_rating", "rated_titles"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and {f"s{k}" for k in range(1, 9)} <= set(entry.queries())


def test_package_is_shipped_once_where_it_is_not_found(spark, monkeypatch, tmp_path):
    sent = []
    monkeypatch.setattr(spark.sparkContext, "addPyFile", sent.append)
    monkeypatch.setattr(session, "_SHIPPED", set())
    monkeypatch.setenv("PYTHONPATH", str(session.ROOT))
    session.ship(spark)
    assert not sent
    monkeypatch.delenv("PYTHONPATH")
    monkeypatch.chdir(tmp_path)
    session.ship(spark)
    session.ship(spark)
    assert len(sent) == 1 and "marlstone/session.py" in zipfile.ZipFile(sent[0]).namelist() and Path(sent[0]).exists()
