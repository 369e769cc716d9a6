import duckdb
import pytest
from pathlib import Path

from lodestock.llm import queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, data, name):
    db = duckdb.connect()
    for f in Path(data).iterdir():
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    rel = db.sql(queries.SQL[name])
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


COLUMNS = {
    "p1_found": ["seq", "class_id"],
    "p2_found": ["plan_id", "label"],
    "p5_found": ["seq"],
    "p6_ids": ["doc_id", "ids"],
    "p7_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id_a", "doc_id_b"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_runs_on_the_smallest_tables(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert name not in COLUMNS or df.columns == COLUMNS[name]
    assert df.count() > 0 or name == "p8_plain"  # the smallest tables have no such pair


def test_every_problem_has_a_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"p{i}" for i in (1, 2, 4, 5, 6, 7, 8)}
