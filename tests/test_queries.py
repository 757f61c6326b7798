"""Each query without the training-data operators, against its SQL on the smallest tables."""

import duckdb
import pytest

from seamline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cur = con.execute(catalogue.ORACLES[name])
    expected = canonical([d[0] for d in cur.description], cur.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_f1_matrix_has_every_user(spark):
    users = {r["lecture_id"] for r in catalogue._sweep(spark, SF).select("lecture_id").distinct().collect()}
    assert len(users) > 3
    assert {r["user_id"] for r in catalogue.QUERIES["f1_matrix"](spark, SF).collect()} == users | {None}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
