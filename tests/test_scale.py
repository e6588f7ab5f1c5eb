"""Results on tables repeated with shifted keys, where equal rows tie, and sizes that must not grow with the tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.operators import similarity
from formline.plans import catalog
from formline.sources import adapters

KEYS = {"orders": {"o_orderkey": "o_orderkey", "o_custkey": "c_custkey"}, "customer": {"c_custkey": "c_custkey"}, "supplier": {"s_suppkey": "s_suppkey"}, "part": {"p_partkey": "p_partkey"}, "lineitem": {"l_orderkey": "o_orderkey", "l_suppkey": "s_suppkey", "l_partkey": "p_partkey"}}


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """sf0.001's tables eight times, and a connection that has them as views."""
    out, con = tmp_path_factory.mktemp("repeated"), duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    at = "/root/testdata/sf0.001"
    shift = {k: con.execute(f"SELECT max({k}) + 1 FROM '{at}/{t}.parquet'").fetchall()[0][0] for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))}
    for t, keys in KEYS.items():
        moved = ", ".join(f"{c} + k * {shift[of]} AS {c}" for c, of in keys.items())
        con.execute(f"COPY (SELECT * REPLACE ({moved}) FROM '{at}/{t}.parquet', range(8) AS r(k)) TO '{out}/{t}.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * FROM '{at}/nation.parquet') TO '{out}/nation.parquet' (FORMAT parquet)")
    for t in (*KEYS, "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{out}/{t}.parquet'")
    return str(out), con


def same(spark, repeated, name):
    sf, con = repeated
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    result = con.execute(catalog.ORACLE[name])
    order = [[d[0] for d in result.description].index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)


def test_equal_rows_tie_as_in_sql(spark, repeated):
    same(spark, repeated, "q13_similar_table")


def test_pairs_of_blocks_are_not_shuffled(spark):
    """Against all pairs, with one vector that many rows share, and with few rows in a block."""
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(260, 3)), np.repeat(rng.normal(size=(1, 3)), 60, 0)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for metric, s in (("cosine", u @ u.T), ("euclidean", -np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)))):
        s = np.round(s, 9)
        got = similarity.topk(df, 4, metric, "id", "v", block=16, digits=9)
        assert "CartesianProduct" in got._jdf.queryExecution().executedPlan().toString()
        wanted = {(i, j, k + 1) for i in range(320) for k, j in enumerate(sorted((j for j in range(320) if j != i), key=lambda j: (-s[i, j], j))[:4])}
        assert {(r.id, r.other, r["rank"]) for r in got.collect()} == wanted


def test_schedules_come_in_pages(spark, monkeypatch):
    monkeypatch.setattr(adapters, "PAGE", 512)
    sizes = adapters.leagues(spark, "/root/testdata/sf0.01").select(F.size("dates").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    assert sizes.most <= 512 and sizes.n == 15000
