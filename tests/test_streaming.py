"""Uniqueness over arrivals: restarts, late repeats, other streams' rows, expiry."""

import time
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veladura.plans.create import take_in
from veladura.streaming.intake import first_of_each_key, protect_stream, read_stream


@pytest.fixture
def incoming(spark, sf_dir):
    from suite.data import rough_table

    return rough_table(spark, sf_dir).select("id", "nome", "cpf", "email", "pan", "dob").filter("id < 60")


def start(spark, schema, root, keys, checkpoint, **more):
    stream = read_stream(spark, f"{root}/in", schema, maxFilesPerTrigger=1)
    query = protect_stream(
        stream, f"{root}/accepted", f"{root}/rejected", f"{root}/{checkpoint}", keys, unique=True, **more
    )
    query.awaitTermination()
    return query


def test_restart_late_rows_and_other_streams(spark, incoming, keys, tmp_path):
    root = str(tmp_path)
    arrive = lambda rows: rows.coalesce(1).write.mode("append").parquet(f"{root}/in")
    arrive(incoming.filter("id % 2 = 0"))
    arrive(incoming.filter("id % 3 = 0"))
    start(spark, incoming.schema, root, keys, "a")
    arrive(incoming)  # all that came before comes again, late
    again = start(spark, incoming.schema, root, keys, "a")
    expected = sorted(r[0] for r in take_in(incoming, keys).accepted.select("cpf_protected").collect())

    def stored():
        return sorted(r[0] for r in spark.read.parquet(f"{root}/accepted").select("cpf_protected").collect())

    assert stored() == expected
    # nothing that this stream stored is read again, and there are no files of keys
    assert all(s.numInputRows == 0 for p in again.recentProgress for s in p.sources if "/accepted" in s.description)
    assert {p.name for p in Path(root).iterdir()} == {"in", "accepted", "rejected", "a"}
    # a stream with a new checkpoint learns what the other one stored, once, and adds nothing
    fresh = start(spark, incoming.schema, root, keys, "b")
    read = sum(s.numInputRows for p in fresh.recentProgress for s in p.sources if "/accepted" in s.description)
    assert read == len(expected) and stored() == expected


def test_keys_are_forgotten_after_a_while(spark, incoming, keys, tmp_path):
    root, few = str(tmp_path), incoming.filter("id in (1, 2, 4)").coalesce(1)
    n = take_in(few, keys).accepted.count()
    assert n > 0
    for count, wait in ((n, 0), (2 * n, 2.5)):
        time.sleep(wait)
        few.write.mode("append").parquet(f"{root}/in")
        start(spark, incoming.schema, root, keys, "a", forget_after=timedelta(seconds=2))
        assert spark.read.parquet(f"{root}/accepted").count() == count


def test_lowest_row_stays_and_rows_without_key_all_do(spark, tmp_path):
    schema = "id bigint, k string, v string"
    rows = [(i, "hot" if i % 3 else None, None if i % 2 else "x") for i in range(40, 0, -1)] + [(0, "k", "a"), (9, "k", "b")]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/in")
    first = first_of_each_key(read_stream(spark, f"{tmp_path}/in", schema), key="k")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = first.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/state"
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r for r in rows if r[1] is None} | {(1, "hot", None), (0, "k", "a")}
    assert spark.read.parquet(f"{tmp_path}/out").filter(F.col("k").isNull()).count() == 13


def test_keys_without_expiry_need_no_python_state(spark, incoming, keys, tmp_path):
    """State is kept by Spark's own operator; rows without a key leave nothing in it."""
    schema = "id bigint, k string"
    rows = [(i, f"k{i % 50}" if i % 4 else None) for i in range(400)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/in")
    stored = spark.createDataFrame([("k1",), ("k2",), (None,)], "k string").coalesce(1)
    stored.write.parquet(f"{tmp_path}/stored")
    first = first_of_each_key(
        read_stream(spark, f"{tmp_path}/in", schema), read_stream(spark, f"{tmp_path}/stored", "k string"), key="k"
    )
    query = first.writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/state"
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    operators = [o for p in query.recentProgress for o in p.stateOperators]
    assert {o.operatorName for o in operators} == {"dedupe"}
    assert max(o.numRowsTotal for o in operators) == 50
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.k)
    lowest = {}
    for i, k in rows:
        if k and k not in ("k1", "k2"):
            lowest.setdefault(k, i)
    assert got == sorted((i, k) for k, i in lowest.items())
    assert spark.read.parquet(f"{tmp_path}/out").filter("k IS NULL").count() == 100
