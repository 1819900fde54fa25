"""Protecting customers as they arrive."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager
from datetime import timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from veladura import policy as P
from veladura.keys import Keyring
from veladura.operators.protect import NULL, named, protect
from veladura.operators.views import stored_names
from veladura.plans.create import take_in
from veladura.session import settings

KEY_BUCKETS = 4096


def read_stream(spark: SparkSession, path: str, schema, format: str = "parquet", **options):
    return spark.readStream.schema(schema).options(**options).format(format).load(path)


def protect_stream(
    raw: DataFrame,
    accepted_path: str,
    rejected_path: str,
    checkpoint: str,
    keyring: Keyring,
    policy: P.ProtectionPolicy = P.keep_name_policy,
    role: str = "api-role",
    unique: bool = False,
    trigger: dict | None = None,
    forget_after: timedelta | None = None,
) -> StreamingQuery:
    """Protect a stream of raw customers into a table, rejections into another.

    Each micro-batch writes its own folder, named by the stream's id (which lives in
    its checkpoint) and the batch number, and overwrites it if it is run again.  So a
    restart neither loses nor repeats rows, and a stream under a new checkpoint adds to
    what others stored.

    With ``unique``, rows whose CPF is already stored, by whichever stream, or repeated in
    this batch, are left out; see ``first_of_each_key``.  What other streams have stored is
    a second source of this one: each of their files is read once per checkpoint, one
    column of it, and before any row that arrives with it.  One unique stream at a time
    may write to a table.  ``forget_after`` is the time after which a key may come again;
    without it no key is forgotten.
    """
    spark = raw.sparkSession
    run = _stream_id(spark, checkpoint)
    intake = take_in(raw, keyring, policy, role, on_error=NULL)
    accepted, rejected = intake.accepted, intake.rejected
    if unique:
        stored = _stored_by_others(spark, accepted_path, run)
        ends = not {"availableNow", "once"}.isdisjoint(trigger or {"availableNow": True})
        accepted = first_of_each_key(accepted, stored, forget_after=forget_after, purge=not ends)
    both = accepted.select(
        F.struct(*[named(c) for c in accepted.columns]).alias("accepted"),
        F.lit(None).cast(rejected.schema).alias("rejected"),
    ).unionByName(
        rejected.select(
            F.lit(None).cast(accepted.schema).alias("accepted"),
            F.struct(*[named(c) for c in rejected.columns]).alias("rejected"),
        )
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for part, path in (("accepted", accepted_path), ("rejected", rejected_path)):
                rows = batch.filter(F.col(part).isNotNull()).select(f"{part}.*")
                rows.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")
        finally:
            batch.unpersist()

    writer = both.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    with state_on_disk(spark):
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def state_on_disk(spark: SparkSession) -> AbstractContextManager[None]:
    """A query that is started here keeps its state in RocksDB: memory does not bound it."""
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ours = {
        "spark.sql.streaming.stateStore.providerClass": provider,
        # a batch uploads what it changed, not the whole state
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    return settings(spark, ours)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that has this checkpoint; a new one is given its id here."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    system = path.getFileSystem(conf)
    if not system.exists(path):
        out = system.create(path, False)
        out.write(bytearray(json.dumps({"id": str(uuid.uuid4())}).encode()))
        out.close()
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def _stored_by_others(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The keys in the table's folders of other runs, as a stream."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).mkdirs(folder)
    stored = read_stream(spark, path, "cpf_protected string, run string, batch bigint")
    # a condition on the folder: files of this run are listed, not read
    return stored.filter(F.col("run") != run).select("cpf_protected")


def _tagged(rows: DataFrame, own_key: Column, stored: DataFrame | None, key: str) -> DataFrame:
    """``_key``, the columns of ``rows``, ``_known``: rows that arrive, and keys that are stored."""
    tagged = rows.select(own_key.alias("_key"), *[named(c) for c in rows.columns], F.lit(False).alias("_known"))
    if stored is None:
        return tagged
    held = stored.filter(named(key).isNotNull()).select(
        named(key).cast("string").alias("_key"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema],
        F.lit(True).alias("_known"),
    )
    return tagged.unionByName(held)


def _lowest(rows: pa.Table) -> pa.Table:
    """One row per ``_key``, the first column: a known one, else the one with the lowest columns."""
    *columns, known = rows.column_names
    order = [(columns[0], "ascending"), (known, "descending"), *[(c, "ascending") for c in columns[1:]]]
    rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start"))
    keys = rows.column(0).combine_chunks()
    new = np.ones(len(keys), bool)
    new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
    return rows.filter(pa.array(new))


def _lowest_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _lowest(pa.Table.from_batches([batch])).to_batches()


def _first_ever(rows: DataFrame, stored: DataFrame | None, key: str) -> DataFrame:
    keyed = rows.filter(named(key).isNotNull())
    reduced = _tagged(keyed, named(key).cast("string"), stored, key).mapInArrow(
        _lowest_of_batches, _tagged(keyed, named(key).cast("string"), None, key).schema
    )
    # a bucket holds all rows of its keys in this batch, so one of each key is left
    bucket = F.pmod(F.xxhash64("_key"), F.lit(KEY_BUCKETS))
    once = reduced.groupBy(bucket).applyInArrow(_lowest, reduced.schema)
    new = once.dropDuplicates(["_key"]).filter(~F.col("_known"))
    return new.select(*[named(c) for c in rows.columns]).unionByName(rows.filter(named(key).isNull()))


def first_of_each_key(
    rows: DataFrame,
    stored: DataFrame | None = None,
    key: str = "cpf_protected",
    forget_after: timedelta | None = None,
    purge: bool = True,
) -> DataFrame:
    """Of a stream, the rows whose key did not occur before and is not in the stream ``stored``.

    Exact, however late a repeat comes: one small entry per key in the query's state,
    which a restart finds again; nothing stored is read a second time.  With
    ``forget_after`` a key that was last let through longer ago counts as new, and ``purge``
    also removes it from the state, which then is bounded.  Purging keeps a query awake
    between batches: one that is to end when its input ends (``availableNow``) must run
    without it; a checkpoint is used in one way or the other.  Of repeats within a batch the row with the lowest columns stays.  Rows without a key all stay and leave
    nothing in the state.  Repeats within an Arrow batch go before the shuffle, so a key
    that fills a third of the input crowds no task.

    Without ``forget_after`` a batch is reduced to one row per key, in buckets of keys, and
    Spark's own ``dropDuplicates`` keeps the keys.  Expiry needs a time per key, which a
    stateful processor keeps: that costs a call to Python and two to the state per key.
    """
    if forget_after is None:
        return _first_ever(rows, stored, key)
    columns = rows.columns
    spread = F.coalesce(named(key).cast("string"), F.concat(F.lit("\0"), F.uuid()))
    tagged = _tagged(rows, spread, stored, key)
    lasts, clock = forget_after.total_seconds(), purge

    class First(StatefulProcessor):
        def init(self, handle):
            self.seen = handle.getValueState("seen", "at double", int(lasts * 1000) if clock else None)

        def handleInputRows(self, given, rows, timers):
            keyless, now = given[0].startswith("\0"), time.time()
            before = None if keyless else self.seen.get()
            if before is not None and now - before[0] < lasts:
                return
            best = None
            for row in rows:
                if row[-1]:
                    best = None
                    break
                rank = [(v is not None, v) for v in row[1:-1]]
                if best is None or rank < best[0]:
                    best = (rank, row)
            if not keyless:
                self.seen.update((now,))
            if best is not None:
                yield Row(**dict(zip(columns, best[1][1:-1])))

        def close(self):
            pass

    reduced = tagged.mapInArrow(_lowest_of_batches, tagged.schema)
    return reduced.groupBy("_key").transformWithState(
        First(), rows.schema, "Append", "ProcessingTime" if clock else "None"
    )


def protect_append(
    raw: DataFrame,
    path: str,
    checkpoint: str,
    keyring: Keyring,
    policy: P.ProtectionPolicy,
    role: str = "api-role",
    on_error: str = NULL,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Protect any stream straight into a Parquet sink; no row is left out, no state kept."""
    return (
        stored_names(protect(raw, policy, keyring, role, on_error))
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def first_per_key(
    protected: DataFrame, time: str, delay: str, key: str = "cpf_protected"
) -> DataFrame:
    """Within a stream: the first row per key, forgetting keys after the watermark delay."""
    return protected.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
