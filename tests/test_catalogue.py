"""Each query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from doclathe.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    show = lambda v: "null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.select(names).collect()) == plain(found.fetchall())


def test_every_query_without_sql_runs(spark):
    for name in set(catalogue.queries()) - set(catalogue.oracle_sql()):
        assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("part", ["part-0.parquet", "day=1/part-0.parquet"])
def test_tables_that_are_folders(spark, tmp_path, part):
    for i, t in enumerate(TABLES):
        at = tmp_path / f"{t}.parquet" / part if i % 3 else tmp_path / f"{t}.parquet"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"not read")
    (tmp_path / "documents.parquet" / "part-1.parquet").write_bytes(b"not read")
    (tmp_path / "notes.txt").write_text("no table")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "other.parquet").write_bytes(b"no table of this folder")
    found = duckdb.connect().execute(catalogue.oracle_sql()["folder_files"]).fetchall()
    assert plain(catalogue.queries()["folder_files"](spark, str(tmp_path)).collect()) == plain(found)


def test_store_of_texts_in_several_languages(spark, tmp_path):
    own = [("a", "en"), ("a", "fr"), ("a", "de"), ("b", "en"), ("b", "en"), ("c", "de"), (None, "fr"), (None, "en"), ("d", None), ("a", None), (None, None), ("", "es"), ("", ""), ("x|y", "de"), ("y", "de|x"), ("|", "en")]
    spark.createDataFrame(own, "text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = con.execute(catalogue.oracle_sql()["store_load_remove"]).fetchall()
    assert found == [(8, 5, 8)]
    assert plain(catalogue.queries()["store_load_remove"](spark, str(tmp_path)).collect()) == plain(found)
