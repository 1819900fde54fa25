"""Removal of long repeated byte strings by bucket-pointer refinement.

A pointer is a place in a text; a bucket holds the pointers whose next bytes agree.
Two equal strings of ``LENGTH`` bytes are two pointers in one bucket of that order.

1. Initial buckets are the 8-grams.  A bucket of order 2m is named by the identifiers of
   the buckets of order m at the pointer and m bytes later, so each round reuses the
   identifiers of the round before: 8, 16, 32, 64, 128, and by overlap 200 and 400.
   Identifiers are fingerprints, so a task computes them without asking others.
2. Not every pointer goes to Spark.  A window of 400 bytes is represented by its leftmost
   smallest bucket of order 200 inside; following windows mostly share theirs and make a
   run.  Equal windows have the same representative at the same distance.  One pointer
   per run (about one per 100 bytes) is shuffled, and buckets with one pointer are done:
   nothing in their runs repeats.
3. Buckets that are left are refined by the identifiers of all later offsets of the run.
   Where two or more pointers agree on all of them, all windows of their runs repeat.
4. A run that agrees with none as a whole may still repeat in part, at the edges of a
   repeated passage.  For these, and one pointer of each refined bucket beside them, the
   windows are refined one by one, by their own identifiers of order 400.

Only step 4 takes every place, and only near the edges of repeated passages.  Texts are
shuffled where something in them has to be looked up, found by a bit map of fixed size
(``MAP_BITS``) that lets a few others through, and at any scale the join decides.
Copies of a text need no special care: a bucket's members are counted, not paired, so
its cost follows its size; joins on hot buckets are ordinary skewed joins.

Results are judged on the input, not on what is left.  Memory per task is bounded by the
blocks in which a text is read (``BLOCK``) and by the spans of one text.

Edge cases: null and empty texts have no bytes; texts shorter than ``LENGTH`` keep all;
repeated rows are copies of each other, so of equal texts nothing stays where they reach
``LENGTH``; rows are told apart by id and text, and equal rows share their result;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.llm.common import cut, map_batches, ship

ship(__name__)

LENGTH, ORDER, BLOCK, MAP_BITS = 400, 200, 1 << 16, 25

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_S29, _S32 = np.uint64(29), np.uint64(32)


def _paired(ids: np.ndarray, step: int) -> np.ndarray:
    """Identifiers of the buckets named by those at a pointer and ``step`` bytes later."""
    later = ids[step:]
    out = later ^ (later >> _S32)
    out *= _M2
    out += ids[: len(later)] * _M1
    out ^= out >> _S29
    out *= _M3
    out ^= out >> _S32
    return out


def bucket_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of orders 200 and 400 for every place that has as many bytes."""
    n = len(data) - 7
    ids = np.empty(n, "<u8")
    for a in range(8):
        ids[a::8] = np.frombuffer(data, "<u8", (len(data) - a) // 8, a)[: len(range(a, n, 8))]
    for step in (8, 16, 32, 64):
        ids = _paired(ids, step)
    ids = _paired(ids, ORDER - 128)
    return ids, _paired(ids, LENGTH - ORDER)


def smallest_inside(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``width`` values its smallest, and how far in the leftmost of these is."""
    least, far = ids, np.zeros(len(ids), np.uint8)
    span = 1
    while span < width:
        step = min(span, width - span)
        right = least[step:]
        left = least[: len(right)]
        later = right < left
        far = np.where(later, far[step:] + np.uint8(step), far[: len(right)])
        least = np.where(later, right, left)
        span += step
    return least, far


def runs(data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Per block: first window, number of windows, bucket and refined bucket of every run."""
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        ids, whole = bucket_ids(data[at : at + BLOCK + LENGTH - 1])
        least, far = smallest_inside(ids, LENGTH - ORDER + 1)
        place = np.arange(len(whole))
        chosen = place + far[: len(whole)]
        first = np.flatnonzero(np.diff(chosen, prepend=-1))
        size = np.diff(first, append=len(whole))
        inside = (place - np.repeat(first, size)).astype(np.uint64)
        refined = np.add.reduceat((whole ^ (whole >> _S29)) * ((inside * _M2 + _M1) | np.uint64(1)), first)
        yield first + at, size, least[first], refined


def _key(doc_id: Column, text: Column) -> dict[str, Column]:
    """Two numbers that tell rows apart, 128 bits together."""
    return {"k1": F.xxhash64(doc_id, text), "k2": F.xxhash64(text, F.lit(7), doc_id)}


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumns(_key(F.col("doc_id"), F.col("text")))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def find_runs(keyed: DataFrame) -> DataFrame:
    """``k1, k2, first, size, bucket, refined``: a row per run of windows."""

    def prepare():
        def run(columns):
            out = {c: [] for c in ("k1", "k2", "first", "size", "bucket", "refined")}
            for k1, k2, text in zip(columns["k1"], columns["k2"], columns["text"]):
                for first, size, bucket, refined in runs(text.encode()):
                    out["k1"].append(np.full(len(first), k1, np.int64))
                    out["k2"].append(np.full(len(first), k2, np.int64))
                    out["first"].append(first)
                    out["size"].append(size)
                    out["bucket"].append(_signed(bucket))
                    out["refined"].append(_signed(refined))
            return {c: np.concatenate(v) if v else [] for c, v in out.items()}

        return run

    long_enough = keyed.filter(F.octet_length("text") >= LENGTH)
    return map_batches(
        long_enough.select("k1", "k2", "text"),
        "k1 bigint, k2 bigint, first bigint, size int, bucket bigint, refined bigint",
        prepare,
    )


def key_map(keys: DataFrame) -> np.ndarray:
    """A bit map of the keys' low bits: 2 ** MAP_BITS bits, whatever the number of keys."""
    low = F.col("k1").bitwiseAND(F.lit((1 << MAP_BITS) - 1)) + 1
    rows = (
        keys.select(F.bitmap_bucket_number(low).alias("part"), F.bitmap_bit_position(low).alias("bit"))
        .groupBy("part")
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()
    )
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for r in rows:
        at = (r["part"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def marked(keyed: DataFrame, bits: np.ndarray, wanted: bool) -> DataFrame:
    """Rows whose key is (or is not) marked in the bit map."""
    sent = keyed.sparkSession.sparkContext.broadcast(bits)
    place = keyed.columns.index("k1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            low = batch.column(place).to_numpy() & ((1 << MAP_BITS) - 1)
            yield batch.filter(pa.array((held[low >> 3] >> (low & 7) & 1).astype(bool) == wanted))

    return keyed.mapInArrow(run, keyed.schema)


def _edge_windows(keyed: DataFrame, edges: DataFrame) -> DataFrame:
    """``bucket, window, k1, k2, at, edge``: the windows of the given runs, one by one."""
    asked = cut(
        edges.groupBy("k1", "k2").agg(
            F.collect_list(F.struct("first", "size", "bucket", "edge")).alias("runs")
        ),
        "edge-runs",
    )
    texts = marked(keyed.select("k1", "k2", "text"), key_map(asked), True)
    # equal rows are one place here: they agree with each other and are never an edge
    joined = texts.join(asked, ["k1", "k2"])

    def prepare():
        def run(columns):
            out = {c: [] for c in ("bucket", "window", "k1", "k2", "at", "edge")}
            for k1, k2, text, asked in zip(*(columns[c] for c in ("k1", "k2", "text", "runs"))):
                data = text.encode()
                for near in _adjoining(asked):
                    first, size = near[0]["first"], sum(r["size"] for r in near)
                    sizes = [r["size"] for r in near]
                    whole = bucket_ids(data[first : first + size + LENGTH - 1])[1]
                    out["bucket"].append(np.repeat([r["bucket"] for r in near], sizes))
                    out["window"].append(_signed(whole))
                    out["k1"].append(np.full(size, k1, np.int64))
                    out["k2"].append(np.full(size, k2, np.int64))
                    out["at"].append(np.arange(first, first + size))
                    out["edge"].append(np.repeat([r["edge"] for r in near], sizes))
            return {c: np.concatenate(v) if v else [] for c, v in out.items()}

        return run

    return map_batches(
        joined,
        "bucket bigint, window bigint, k1 bigint, k2 bigint, at bigint, edge boolean",
        prepare,
        rows=16,  # each becomes up to a row per byte
    )


def _adjoining(asked: list[dict]) -> Iterator[list[dict]]:
    """Runs in order of place, in lists without gaps, of about a block at most."""
    near: list[dict] = []
    for r in sorted(asked, key=lambda r: r["first"]):
        if near and (
            r["first"] != near[-1]["first"] + near[-1]["size"] or r["first"] - near[0]["first"] > BLOCK
        ):
            yield near
            near = []
        near.append(r)
    if near:
        yield near


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """``k1, k2, spans``: for rows with repeats, ranges of bytes that may overlap, unordered."""
    found = cut(find_runs(keyed), "runs")
    n = found.count()
    shared = cut(found.groupBy("bucket").count().filter("count > 1").select("bucket"), "buckets", n)
    pointers = cut(found.join(shared, "bucket"), "pointers", n)
    place = ["bucket", "size", "refined"]
    refined = cut(
        pointers.groupBy(place).agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "first")).alias("one")
        ),
        "refined",
        n,
    )
    whole = pointers.join(refined.filter("n > 1").select(place), place)
    mixed = cut(
        refined.groupBy("bucket").agg(F.count_if(F.col("n") == 1).alias("edges")).filter("edges > 0")
        .select("bucket"), "mixed", n,
    )
    edges = refined.join(mixed, "bucket").select("one.*", "size", "bucket", (F.col("n") == 1).alias("edge"))
    windows = cut(_edge_windows(keyed, edges), "windows")
    twice = cut(
        windows.groupBy("bucket", "window").count().filter("count > 1").select("bucket", "window"),
        "twice",
    )
    part = windows.filter("edge").join(twice, ["bucket", "window"])
    spans = whole.select(
        "k1", "k2", F.col("first").alias("start"), (F.col("first") + F.col("size") - 1 + LENGTH).alias("end")
    ).unionByName(
        part.select("k1", "k2", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end"))
    )
    return cut(
        spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans"
    )


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: removed byte ranges and the bytes that are left."""
    keyed = _keyed(docs)
    spans = repeated_spans(keyed)
    bits = key_map(spans)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )

    def prepare():
        def run(columns):
            out = {c: [] for c in ("doc_id", "n_bytes", "spans", "kept")}
            for doc_id, text, found in zip(*(columns[c] for c in ("doc_id", "text", "spans"))):
                data, kept, at = text.encode(), [], 0
                ranges = merged(found or [])
                for a, b in ranges:
                    kept.append(data[at:a])
                    at = b
                out["doc_id"].append(doc_id)
                out["n_bytes"].append(len(data))
                out["spans"].append([{"start": a, "end": b} for a, b in ranges])
                out["kept"].append(b"".join([*kept, data[at:]]))
            return out

        return run

    touched = marked(keyed, bits, True).join(spans, ["k1", "k2"], "left")
    changed = map_batches(touched.select("doc_id", "text", "spans"), schema, prepare)
    untouched = marked(keyed, bits, False).select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
        F.col("text").cast("binary").alias("kept"),
    )
    return changed.unionByName(untouched)
