import decimal
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from frameloom import queries as engine

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5) + 0.0
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, db, name):
    df = engine.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name not in engine.SQL:
        assert rows
        return
    cursor = db.execute(engine.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.columns, rows) == table(names, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_union_typed_vocab_has_all_languages(spark, tmp_path):
    rows = [(1, "abc", "de"), (2, "abd", "de"), (3, "xy", "it"), (4, "xy", "en"), (5, "é🙂", "zh"), (6, "n", None), (7, "", "en"), (8, None, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = engine.QUERIES["union_typed_vocab"](spark, str(tmp_path))
    cursor = con.execute(engine.SQL["union_typed_vocab"])
    assert table(df.columns, df.collect()) == table([c[0] for c in cursor.description], cursor.fetchall())
