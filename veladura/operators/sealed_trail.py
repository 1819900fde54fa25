"""An audit trail in which removed, changed, swapped and added entries are found.

A trail is a folder.  Every append makes one block: its entries in parts of bounded size,
each entry with a keyed hash of itself and its place (``mac``) and a ``seal`` that chains it to the
entries before it in its part; the parts' last seals (``heads``); and one small file with the root
of a hash tree over the heads, chained to the block before.  An append reads the last of these
files only, none of the entries stored before, and the block exists once that file does.  Each
append writes to folders of its own, which its file names: what a broken-off append leaves
behind belongs to no block, and of two writers of the same block the second is refused.

``verify`` reads everything once and names block, part and position of what is wrong.  All
hashes are keyed, so whoever can write the files but lacks the master secret cannot
mend them.  Cutting off whole blocks at the end leaves a valid shorter trail: to notice that, keep
``last_seal`` elsewhere and pass it to ``verify``.

Entries may hold nulls (told apart from empty text), repeated rows and any plain columns but
``block, part, pos, mac, seal``; nested columns are refused.  An append without entries makes an
empty block.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, BinaryType, StructType, TimestampType

from veladura.functions.tokens import token
from veladura.keys import Keyring
from veladura.operators.protect import named
from veladura.session import kept

ROWS_PER_PART = 100_000
ROWS_PER_FILE, FILES_AT_ONCE = 100_000, 32
FANOUT = 1024
_OWN = ("block", "part", "pos", "mac", "seal")
_FINDINGS = "block bigint, part bigint, pos bigint, finding string, n bigint"


class ConflictError(RuntimeError):
    """Another writer has made this block in the meantime."""


def _content(schema: StructType) -> Column:
    """An entry as one text from which all of its values could be read back."""
    cells = []
    for f in sorted(schema.fields, key=lambda f: f.name):
        if not isinstance(f.dataType, AtomicType):
            raise ValueError(f"column {f.name} is nested: an entry has plain columns")
        value = named(f.name)
        if isinstance(f.dataType, TimestampType):
            value = F.unix_micros(value)  # does not depend on the session's time zone
        text = F.hex(value) if isinstance(f.dataType, BinaryType) else value.cast("string")
        cells += [F.lit(f"{len(f.name)}:{f.name}"), F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-"))]
    return F.concat(*cells)


def _mac(schema: StructType, keyring: Keyring) -> Column:
    place = F.concat_ws("/", *[named(c).cast("string") for c in ("block", "part", "pos")])
    return token(F.concat(place, F.lit("/"), _content(schema)), "audit-entry", keyring)


def _link(key: bytes, before: str, mac: str) -> str:
    return hmac.new(key, f"{before}{mac}".encode(), hashlib.sha256).hexdigest()


def _start(block: int, part: int) -> str:
    return f"{block}/{part}/"


def _root(heads: DataFrame, parts: int) -> str:
    """The root of a tree over the heads of one block; no node has more than ``FANOUT`` children."""
    level = heads.select("part", F.concat_ws("/", "part", "n", "head").alias("hash"))
    while True:
        children = F.sort_array(F.collect_list(F.struct("part", "hash")))["hash"]
        level = level.groupBy(F.call_function("div", F.col("part"), F.lit(FANOUT)).alias("part")).agg(
            F.sha2(F.array_join(children, "|"), 256).alias("hash")
        )
        parts = -(-parts // FANOUT)
        if parts <= 1:
            # more than one row only if the heads were tampered with
            return "|".join(r.hash for r in level.orderBy("part").limit(2).collect())


def _heads(entries: DataFrame) -> DataFrame:
    return entries.groupBy("block", "part").agg(F.count(F.lit(1)).alias("n"), F.max_by("seal", "pos").alias("head"))


class SealedTrail:
    def __init__(self, spark: SparkSession, root: str, keyring: Keyring, rows_per_part: int = ROWS_PER_PART):
        self.spark, self.root, self.keyring, self.rows_per_part = spark, root.rstrip("/"), keyring, rows_per_part

    # files

    def _path(self, *below: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *below]))

    def _system(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        path = self._path("blocks")
        if not self._system().exists(path):
            return []
        names = [s.getPath().getName() for s in self._system().listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit())

    def _block(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/blocks/{number:012d}", wholetext=True).first()[0])

    def _block_seal(self, block: dict) -> str:
        held = json.dumps([block[k] for k in ("block", "folder", "previous", "root", "parts", "entries", "schema")])
        return hmac.new(self.keyring.store("audit-block"), held.encode(), hashlib.sha256).hexdigest()

    # use

    def last_seal(self) -> str:
        """What the trail ends with; empty for a trail without blocks."""
        numbers = self._numbers()
        return self._block(numbers[-1])["seal"] if numbers else ""

    def append(self, entries: DataFrame) -> str:
        """Add one block and return its seal."""
        clash = set(_OWN) & {c.lower() for c in entries.columns}
        if clash:
            raise ValueError(f"an entry cannot have columns named {sorted(clash)}")
        schema, numbers = entries.schema, self._numbers()
        _content(schema)
        block, previous = (numbers[-1] + 1, self.last_seal()) if numbers else (0, "")
        entries = kept(entries, "entries")  # computed once: counted, then sealed
        rows, size = entries.count(), F.lit(self.rows_per_part).cast("bigint")
        # a task and a file for each of a few parts; of many small parts a file holds several
        tasks = min(-(-rows // self.rows_per_part), max(FILES_AT_ONCE, -(-rows // ROWS_PER_FILE)))
        tasks = max(1, tasks)
        # dealt evenly whatever the entries hold; a part is made by one task, so a repeated task seals all of its parts
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        dealt = entries.repartition(tasks).select(
            "*",
            F.lit(block).cast("bigint").alias("block"),
            (F.spark_partition_id() + F.call_function("div", row, size) * tasks).alias("part"),
            (row % size).alias("pos"),
        )
        folder = uuid.uuid4().hex
        where = f"{self.root}/entries/{folder}"
        key = self.keyring.store("audit-chain")
        sealed = StructType(list(dealt.schema.fields)).add("mac", "string").add("seal", "string")

        def chain(batches):
            last, of = None, None
            for batch in batches:
                seals = []
                for part, mac in zip(batch["part"].to_pylist(), batch["mac"].to_pylist()):
                    last, of = _link(key, last if part == of else _start(block, part), mac), part
                    seals.append(last)
                yield batch.append_column("seal", pa.array(seals, pa.string()))

        macs = dealt.withColumn("mac", _mac(schema, self.keyring))
        macs.mapInArrow(chain, sealed).write.parquet(where)
        _heads(self.spark.read.schema(sealed).parquet(where)).write.parquet(f"{self.root}/heads/{folder}")
        heads = self._head_rows([folder])
        entered, last = heads.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("part"), F.lit(0))).first()
        parts = last + 1
        row = {
            "block": block,
            "folder": folder,
            "previous": previous,
            "root": _root(heads, parts),
            "parts": parts,
            "entries": entered,
            "schema": schema.json(),
        }
        row["seal"] = self._block_seal(row)
        try:
            out = self._system().create(self._path("blocks", f"{block:012d}"), False)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in str(error.java_exception):
                raise ConflictError(f"block {block} of {self.root} exists already") from None
            raise
        out.write(bytearray(json.dumps(row).encode()))
        out.close()
        return row["seal"]

    def _folders(self, kind: str, folders: list[str]) -> list[str]:
        return [f"{self.root}/{kind}/{f}" for f in folders if self._system().exists(self._path(kind, f))]

    def _entries(self, folders: list[str], schema: StructType) -> DataFrame:
        full = StructType(list(schema.fields))
        for name, kind in (("block", "long"), ("part", "long"), ("pos", "long"), ("mac", "string"), ("seal", "string")):
            full = full.add(name, kind)
        paths = self._folders("entries", folders)
        return self.spark.read.schema(full).parquet(*paths) if paths else self.spark.createDataFrame([], full)

    def read(self) -> DataFrame:
        """All entries with their places; blocks that were never finished are not among them."""
        numbers = self._numbers()
        if not numbers:
            raise FileNotFoundError(f"{self.root} has no blocks")
        blocks = [self._block(n) for n in numbers]
        return self._entries([b["folder"] for b in blocks], StructType.fromJson(json.loads(blocks[-1]["schema"])))

    def verify(self, expected: str | None = None) -> DataFrame:
        """What is wrong: ``block, part, pos, finding, n``; no rows for a trail that is whole.

        * ``changed``: the entry at this place is not the one that was sealed there.
        * ``missing``: ``n`` entries are gone, the first of them at this place.
        * ``added``: the place is taken twice, or lies in a part or block that never was.
        * ``chain``: the entry is whole, but its seal does not follow from the one before.
        * ``head``: the part's head is not its last seal, or is gone.
        * ``block``: the block's file is gone, or does not fit its heads or the block before.
        * ``end``: the trail does not end with ``expected``.
        """
        numbers = self._numbers()
        wrong, previous, blocks = [], "", []
        for number in range(numbers[-1] + 1 if numbers else 0):  # one small file per append
            if number not in numbers:
                wrong.append((number, None, None, "block", 1))
                previous = None
                continue
            row = self._block(number)
            blocks.append(row)
            heads = self._head_rows([row["folder"]])
            good = hmac.compare_digest(self._block_seal(row), row["seal"]) and row["block"] == number
            good = good and (previous is None or row["previous"] == previous)
            if not good or _root(heads, row["parts"]) != row["root"]:
                wrong.append((number, None, None, "block", 1))
            previous = row["seal"]
        if expected is not None and self.last_seal() != expected:
            wrong.append((None, None, None, "end", 1))
        found = self.spark.createDataFrame(wrong, _FINDINGS)
        by_schema: dict[str, list[str]] = {}
        for row in blocks:
            by_schema.setdefault(row["schema"], []).append(row["folder"])
        for schema, held in by_schema.items():
            found = found.unionByName(self._check_entries(held, StructType.fromJson(json.loads(schema))))
        return found

    def _head_rows(self, folders: list[str]) -> DataFrame:
        schema, paths = "block bigint, part bigint, n bigint, head string", self._folders("heads", folders)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _check_entries(self, folders: list[str], schema: StructType) -> DataFrame:
        key = self.keyring.store("audit-chain")
        rows = self._entries(folders, schema)
        good = named("mac").eqNullSafe(_mac(schema, self.keyring)).alias("good")
        order = ["block", "part", "pos"]
        # parts have a bounded number of entries; each is read in order by one task
        placed = rows.select(*order, "mac", "seal", good).repartition("block", "part").sortWithinPartitions(*order)

        def check(batches):
            at, last, whole = None, None, True  # the part, its last place and seal, was that entry whole
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    block, part, pos = r["block"], r["part"], r["pos"]
                    if part is None or pos is None or part < 0 or pos < 0:
                        out.append((block, part, pos, "added", 1))
                        continue
                    if at != (block, part):
                        at, last, whole = (block, part), (-1, _start(block, part)), True
                    if pos == last[0]:
                        out.append((block, part, pos, "added", 1))
                        continue
                    gap = pos - last[0] - 1
                    if gap:
                        out.append((block, part, last[0] + 1, "missing", gap))
                    if not r["good"]:
                        out.append((block, part, pos, "changed", 1))
                    elif not gap and whole and r["seal"] != _link(key, last[1], r["mac"]):
                        out.append((block, part, pos, "chain", 1))
                    last, whole = (pos, r["seal"] or ""), r["good"]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip((*order, "finding", "n"), x)) for x in out],
                    pa.schema([(c, pa.int64()) for c in order] + [("finding", pa.string()), ("n", pa.int64())]),
                )

        inside = placed.mapInArrow(check, _FINDINGS)
        ends = rows.filter("part >= 0 AND pos >= 0").groupBy("block", "part").agg(
            F.max("pos").alias("_last"), F.max_by("seal", "pos").alias("_seal")
        )
        heads = self._head_rows(folders).groupBy("block", "part").agg(
            F.max("n").alias("n"), F.max_by("head", "n").alias("head"), F.count(F.lit(1)).alias("_heads")
        )
        held = F.coalesce(F.col("_last") + 1, F.lit(0))
        short = F.when(F.col("n") > held, F.struct(held.alias("pos"), F.lit("missing").alias("finding"), (F.col("n") - held).alias("n")))
        more = F.when(F.col("n") < held, F.struct(F.col("n").alias("pos"), F.lit("added").alias("finding"), (held - F.col("n")).alias("n")))
        same_end = F.col("n") == held
        unlike = F.col("n").isNull() | (F.col("_heads") > 1) | (same_end & ~F.col("head").eqNullSafe(F.col("_seal")))
        nothing = F.lit(None).cast("bigint")
        odd = F.when(unlike, F.struct(nothing.alias("pos"), F.lit("head").alias("finding"), F.lit(1).cast("bigint").alias("n")))
        outside = ends.join(heads, ["block", "part"], "full").select(
            "block", "part", F.inline(F.array_compact(F.array(short, more, odd)))
        )
        return inside.unionByName(outside)
