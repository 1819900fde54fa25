"""Tampering with a sealed trail, entry by entry, head by head, block by block."""

import json
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from veladura.keys import Keyring
from veladura.operators import audit, sealed_trail
from veladura.operators.sealed_trail import ConflictError, SealedTrail

SCHEMA = "actor string, key bigint, at timestamp"


@pytest.fixture
def trail(spark, keys, tmp_path):
    made = SealedTrail(spark, str(tmp_path / "trail"), keys, rows_per_part=10)
    rows = spark.range(25).selectExpr("IF(id % 5 = 0, NULL, 'dpo') AS actor", "id AS key", "timestamp_micros(id * 1000001) AS at")
    made.append(rows)
    made.append(spark.createDataFrame([("", 1, None)] * 12, SCHEMA))
    return made


def findings(trail, expected=None):
    return sorted(tuple(r) for r in trail.verify(expected).collect())


def edit(trail, folder, block, change):
    """Rewrite one file of a block as somebody with access to the files would."""
    for path in sorted(Path(f"{trail.root}/{folder}/{trail._block(block)['folder']}").glob("part-*.parquet")):
        rows = pq.read_table(path)
        new = change(rows.to_pylist())
        if new is not None:
            path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
            pq.write_table(pa.Table.from_pylist(new, rows.schema), path, use_deprecated_int96_timestamps=True)
            return


def place(rows, key):
    return next(((r["part"], r["pos"], i) for i, r in enumerate(rows) if r["key"] == key), None)


def test_whole_trail(spark, trail):
    assert findings(trail, trail.last_seal()) == []
    read = trail.read()
    assert read.count() == 37 and read.filter("block = 0").select("part").distinct().count() == 3
    assert read.groupBy("block", "part").count().agg({"count": "max"}).first()[0] <= 10
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        assert findings(trail) == []  # seals do not depend on the session
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_changed_entry_is_located(trail):
    where = []

    def change(rows):
        if place(rows, 7):
            part, pos, i = place(rows, 7)
            where.append((0, part, pos, "changed", 1))
            rows[i]["actor"] = "nobody"
            return rows

    edit(trail, "entries", 0, change)
    assert findings(trail) == where


def test_null_and_empty_are_different(trail):
    where = []

    def change(rows):
        if place(rows, 5):
            part, pos, i = place(rows, 5)
            where.append((0, part, pos, "changed", 1))
            rows[i]["actor"] = ""
            return rows

    edit(trail, "entries", 0, change)
    assert findings(trail) == where


@pytest.mark.parametrize("at", ["inside", "end"])
def test_removed_entries(trail, at):
    where = []

    def change(rows):
        rows.sort(key=lambda r: r["pos"])
        gone = rows[2:4] if at == "inside" else rows[-1:]
        where.append((0, gone[0]["part"], gone[0]["pos"], "missing", len(gone)))
        return [r for r in rows if r not in gone]

    edit(trail, "entries", 0, change)
    assert findings(trail) == where


def test_swapped_and_added_entries(trail):
    where = []

    def change(rows):
        rows.sort(key=lambda r: r["pos"])
        a, b = rows[1], rows[4]
        a["pos"], b["pos"] = b["pos"], a["pos"]  # with their hashes
        where.extend((0, a["part"], p, "changed", 1) for p in (1, 4))
        where.append((0, a["part"], 6, "added", 1))
        return rows + [dict(rows[6])]

    edit(trail, "entries", 0, change)
    assert findings(trail) == sorted(where)


def test_entry_moved_to_another_block(trail):
    edit(trail, "entries", 1, lambda rows: [dict(r, actor="x") if r["pos"] == 0 else r for r in rows])
    assert [f[0::3] for f in findings(trail)] == [(1, "changed")]


def test_heads_and_blocks(trail):
    end = trail.last_seal()
    edit(trail, "heads", 0, lambda rows: [dict(r, n=r["n"] - 1) for r in rows])
    found = findings_by_kind(trail)
    assert found["block"] == {0} and found["added"] == {0}
    path = Path(f"{trail.root}/blocks/{1:012d}")
    path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    path.unlink()
    assert "end" in {f[3] for f in trail.verify(end).collect()}


def findings_by_kind(trail):
    out = {}
    for block, _, _, kind, _ in (tuple(r) for r in trail.verify().collect()):
        out.setdefault(kind, set()).add(block)
    return out


def test_forged_block_and_other_key(spark, trail):
    path = Path(f"{trail.root}/blocks/{0:012d}")
    row = json.loads(path.read_text())
    row["entries"] -= 1
    path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    path.write_text(json.dumps(row))
    assert findings_by_kind(trail) == {"block": {0}}
    stranger = SealedTrail(spark, trail.root, Keyring(b"another secret of enough bytes"))
    assert {"changed", "block"} <= set(findings_by_kind(stranger))


def test_append_reads_no_entries_and_one_writer_wins(spark, trail, monkeypatch):
    for path in Path(f"{trail.root}/entries/{trail._block(0)['folder']}").iterdir():
        path.unlink()  # an append does not miss them
    more = spark.createDataFrame([("late", 1, None)], SCHEMA)
    with monkeypatch.context() as slow:
        slow.setattr(SealedTrail, "_numbers", lambda self: [0])
        with pytest.raises(ConflictError):
            SealedTrail(spark, trail.root, trail.keyring).append(more)
    assert {f[0] for f in findings(trail)} == {0}  # block 1 is as it was
    trail.append(more)
    assert {f[3] for f in findings(trail)} >= {"missing"} and {f[0] for f in findings(trail)} <= {0, 1}


def test_empty_block_and_refused_columns(spark, keys, tmp_path):
    trail = SealedTrail(spark, str(tmp_path / "t"), keys)
    assert trail.last_seal() == "" and findings(trail) == []
    trail.append(spark.createDataFrame([], SCHEMA))
    trail.append(spark.createDataFrame([("a", None, None)], SCHEMA))
    assert findings(trail) == [] and trail.read().count() == 1
    with pytest.raises(ValueError, match="named"):
        trail.append(spark.range(1).selectExpr("id AS Pos"))
    with pytest.raises(ValueError, match="nested"):
        trail.append(spark.range(1).selectExpr("array(id) AS a"))


def test_summary_is_dealt_to_bounded_tasks(spark, monkeypatch):
    """Distinct keys are counted in as many tasks as their number asks for, null keys anywhere."""
    monkeypatch.setattr(audit, "ENTRIES_PER_TASK", 100)
    rows = spark.range(1000).selectExpr(
        "IF(id % 3 = 0, NULL, 'dpo') AS actor", "'r' AS role", "'decode' AS operation",
        "IF(id % 2 = 0, 'a', 'b') AS column", "IF(id % 10 = 0, NULL, id % 97) AS key",
    ).coalesce(1)
    got = audit.trail_summary(rows)
    assert "Exchange hashpartitioning" in got._jdf.queryExecution().toString() and ", 11), REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()
    plain = rows.groupBy("actor", "role", "operation", "column").agg(
        F.count(F.lit(1)).alias("n_values"), F.countDistinct("key").alias("n_rows")
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_many_parts_are_few_tasks_and_files(spark, keys, tmp_path, monkeypatch):
    """Parts are bounded whatever a task writes, and small parts share a file."""
    monkeypatch.setattr(sealed_trail, "FILES_AT_ONCE", 2)
    trail = SealedTrail(spark, str(tmp_path / "t"), keys, rows_per_part=10)
    trail.append(spark.range(1000).selectExpr("'a' AS actor", "id AS key", "timestamp_micros(id) AS at"))
    folder = f"{trail.root}/entries/{trail._block(0)['folder']}"
    assert len(list(Path(folder).glob("part-*.parquet"))) == 2
    sizes = [r[0] for r in trail.read().groupBy("part").count().select("count").collect()]
    assert max(sizes) == 10 and sum(sizes) == 1000 and findings(trail, trail.last_seal()) == []
    where = []

    def change(rows):
        gone = [r for r in rows if r["key"] in (500, 501)]
        where.extend((0, r["part"], r["pos"], "missing", 1) for r in gone)
        return [r for r in rows if r not in gone]

    for path in Path(folder).glob("part-*.parquet"):
        rows = pq.read_table(path)
        path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
        pq.write_table(pa.Table.from_pylist(change(rows.to_pylist()), rows.schema), path, use_deprecated_int96_timestamps=True)
    assert sum(f[4] for f in findings(trail)) == 2 and {f[3] for f in findings(trail)} == {"missing"}
    assert {f[1] for f in findings(trail)} == {w[1] for w in where}
