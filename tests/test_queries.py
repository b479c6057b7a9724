"""Every registered query of the library runs on the smallest tables; those with SQL equal DuckDB's rows."""

import math
import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from seqspark.plans.registry import load_all

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = load_all()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def results(spark, request):
    """Each asked query's rows, as futures: small queries wait for the driver more than for the cores."""
    names = [i.callspec.params["name"] for i in request.session.items if getattr(i, "callspec", None) and "name" in i.callspec.params and i.module is request.module]

    def run(name):
        df = QUERIES[name][0](spark, DATA)
        return df.columns, df.collect()

    with ThreadPoolExecutor(6) as pool:
        yield {n: pool.submit(run, n) for n in names}


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(results, duck, name):
    sql = QUERIES[name][1]
    columns, rows = results[name].result()
    if not sql:
        assert rows
        return
    r = duck.execute(sql)
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(columns)
    want = r.fetchall()
    k = sorted(cols)
    key = lambda out, names: sorted((tuple(norm(x[names.index(c)]) for c in k) for x in out), key=repr)
    assert key(rows, columns) == key(want, cols)


def test_cluster_queries_cover_all_lengths(spark):
    from seqspark.plans import q_cluster
    from seqspark.plans.views import labelled

    d = "/root/testdata/sf0.001"
    lengths = {r.n_clicks for r in labelled(spark, d).where("n_clicks between 3 and 10").select("n_clicks").distinct().collect()}
    assert {r.n_clicks for r in q_cluster.c09(spark, d).select("n_clicks").distinct().collect()} == lengths
    assert {r.n_clicks for r in q_cluster.c10(spark, d).collect() if r.n_clicks is not None} == lengths


def test_residual_pool_is_whole(spark):
    from seqspark.plans.flows import pooled

    rows = spark.createDataFrame([(i, 3, [0.1, 0.1 + i / 1000], "A", 1.0) for i in range(0, 40)] + [(101, 3, [9.0, 9.0], "B", 1.0), (104, 3, [5.0, 5.0], "5-LOW", 1.0)], "row_id long, n_clicks int, ici array<double>, label string, dur double")
    pool = {r.row_id for r in pooled(rows).where("__pool").collect()}
    assert {101, 104} <= pool and not pool & set(range(0, 40, 4))


def test_flows_end_in_written_rows(spark):
    """The labelled patterns and the classes are written once, not made again for each of their readers."""
    files = QUERIES["f01_classify_events"][0](spark, DATA).inputFiles()
    assert files and not [f for f in files if "lineitem" in f or "orders" in f]
    files = QUERIES["j03_threshold_accept"][0](spark, DATA).inputFiles()
    assert files and not [f for f in files if "lineitem" in f or "orders" in f]
