"""The catalogue against SQL, and streams against batches."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from sparkscreen.plans import catalogue
from sparkscreen.streaming import state

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: "-" if pd.api.types.is_scalar(v) and pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else f"{v:.6f}" if isinstance(v, float) else str(v)
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sql, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    if name in catalogue.oracle_sql():
        assert rows(got) == rows(sql.execute(catalogue.oracle_sql()[name]).df())
    else:
        assert len(got)


def test_stream_freshness_equals_replay(spark, tmp_path):
    from sparkscreen.operators import cache

    batch = spark.read.parquet(f"{SF}/events.parquet")
    events = spark.createDataFrame(batch.selectExpr("user_id as key", "cast(ts as timestamp) as ts", "event_id").toPandas())
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    got = state.run_to_end(state.freshness(stream, "key", "ts", "event_id", 86400), "freshness_test", "append")
    want = cache.replay(batch.selectExpr("user_id as key", "event_id", "ts", "86400 as ttl_seconds"))
    assert sorted(map(tuple, got.select("key", "event_id", "hit").collect())) == sorted(map(tuple, want.select("key", "event_id", "hit").collect()))


def test_results_do_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    from sparkscreen.functions import patterns

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, many = (sorted(map(str, d.select("doc_id", patterns.scan(F.col("text"))).collect())) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == many


def test_stream_recency_equals_replay(spark, tmp_path):
    from collections import OrderedDict

    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id % 3 as cache", "event_id % 17 as key", "cast(ts as timestamp) as ts", "event_id", "1 + event_id % 5 as size").toPandas()
    events = spark.createDataFrame(rows)
    for k in range(2):
        events.where(f"event_id % 2 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "accesses"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "accesses"))
    got = state.run_to_end(state.recency(stream, "cache", "key", "ts", "event_id", "size", 20, 6), "recency_test", "append")
    want = []
    for cache, own in rows.groupby("cache"):
        held = OrderedDict()
        for r in own.sort_values(["ts", "event_id"]).itertuples():
            want.append((cache, r.event_id, r.key in held))
            held.pop(r.key, None)
            held[r.key] = r.size
            while sum(held.values()) > 20 or len(held) > 6:
                held.popitem(last=False)
    assert sorted(map(tuple, got.select("cache", "event_id", "hit").collect())) == sorted(want)


def test_look_alikes_with_a_table(spark):
    from pyspark.sql import functions as F

    from sparkscreen.operators import forms

    table = spark.createDataFrame([("ⲟ", "o"), ("ǀ", "l"), ("a", "b"), ("к", "q")], "source string, target string")
    texts = ["ignⲟre", "plain", "ϲafe к", "ǀgnore", "´x", None]
    read = forms.with_table(table, True)
    got = [list(r[0]["forms"]) for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(read(F.col("t"))).collect()]
    assert got == [["ignⲟre", "ignore"], ["plain"], ["ϲafe к", "cafe k"], ["ǀgnore", "lgnore", "ignore"], ["´x", "'x"], [""]]
