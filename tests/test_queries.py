"""Every query of the tree engine on a small table, against its SQL where it has one."""

import os

import pytest

from boscage.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def rows(pdf):
    cols = sorted(pdf.columns)
    out = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    clean = lambda v: None if v is None else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
    return cols, sorted(str(tuple(clean(v) for v in r)) for r in out.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLES])
def test_equals_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(queries.ORACLES[name]).df())


@pytest.mark.parametrize("values", [4, 1])
@pytest.mark.parametrize("name", ["train_stump_positive_weight", "train_stump_squared"])
def test_stump_of_a_label_without_signal(spark, tmp_path, name, values):
    import duckdb

    path = str(tmp_path / "lineitem.parquet")
    own = spark.range(50 * values).selectExpr("id l_orderkey", "cast(id % 3 as int) l_linenumber", "cast(id div 50 as double) l_quantity", "cast(id % 5 * 1000 as double) l_extendedprice", "if(id % 5 < 2 or id = 62, 'R', 'A') l_returnflag")
    own.toPandas().to_parquet(path)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{path}'")
    want = rows(c.sql(queries.ORACLES[name]).df())
    assert len(want[1]) == (values > 1) and rows(queries.QUERIES[name](spark, str(tmp_path)).toPandas()) == want


def test_entry(spark):
    assert queries.entry(spark, DATA).count() > 0
