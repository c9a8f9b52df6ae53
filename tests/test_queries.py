"""Every registered raster query against its SQL, on the smallest tables."""

import glob
import os

import pytest

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def names():
    from rastrel.queries import QUERIES

    return list(QUERIES)


def test_all_have_sql():
    from rastrel.queries import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", names())
def test_query(spark, tables, name):
    from rastrel.queries import ORACLES, QUERIES

    out = QUERIES[name](spark, DATA)
    columns = sorted(out.columns)
    want = tables.execute(ORACLES[name])
    at = [d[0] for d in want.description]
    assert sorted(at) == columns
    got = sorted(repr(tuple(r[c] for c in columns)) for r in out.collect())
    assert got == sorted(repr(tuple(r[at.index(c)] for c in columns)) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2  # 1,500 orders: the second image is filled up
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bicubic_meets_halves_at_the_edge(spark, tmp_path):
    """In the first column weights don't sum to one; the sample at (57, 0) is exactly 48.5, which a quotient a pass makes 48.499..."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from rastrel.queries import ORACLES, QUERIES

    v = np.random.default_rng(2117).integers(0, 256, 1024)
    pq.write_table(pa.table({"o_orderkey": np.arange(1024), "o_custkey": np.arange(1024), "o_totalprice": v.astype(float)}), tmp_path / "orders.parquet")
    c = duckdb.connect()
    c.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    got = {(r.y, r.x): r.v for r in QUERIES["resize_bicubic"](spark, str(tmp_path)).collect()}
    want = {(y, x): v for _, y, x, _, v in c.execute(ORACLES["resize_bicubic"]).fetchall()}
    assert got == want and got[57, 0] == 49


def test_docs_cut_tiles_in_one_pass(spark, tmp_path):
    from rastrel.queries import ORACLES, QUERIES

    texts = ["", None, "a", "x" * 255, "x" * 256, "x" * 257, "\0b\0", " \n\r\n\t ", "é" * 300, "😀" * 256 + "z", "\\E.*$" * 60, "汉字 " * 200, " " * 512]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    out = QUERIES["px_docs"](spark, str(tmp_path))
    assert sorted(map(tuple, out.select("image_id", "y", "x", "c", "v").collect())) == sorted(c.execute(f"select image_id, y, x, c, v from ({ORACLES['px_docs']})").fetchall())
    assert "substr" not in out._jdf.queryExecution().optimizedPlan().toString()  # its cost is the sample's place
