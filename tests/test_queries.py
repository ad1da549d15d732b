"""Every registered query against its SQL, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = [f.removesuffix(".parquet") for f in os.listdir(DATA)]
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op")]


def rendered(v) -> str:
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(rendered, v)) + "]"
    return str(v)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(rendered(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def tables(duck):
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        duck.execute(f"create or replace view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return duck


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, tables, name):
    ours = entry.queries()[name](spark, DATA)
    cursor = tables.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(ours.columns) == sorted(columns)
    assert bag(ours.columns, [tuple(r) for r in ours.collect()]) == bag(columns, cursor.fetchall())


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"])
def test_query_reads_a_given_table(spark, name):
    assert any(f.startswith(f"file://{DATA}/") for f in entry.queries()[name](spark, DATA).inputFiles())


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["doc_id", "score", "quality", "flags"]
    assert out.count() > 200
