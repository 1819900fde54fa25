"""Short codes for vectors: each part of a vector becomes the number of its codebook's nearest entry.

The nearest entry is found in a geometric near-neighbour access tree (GNAT) over a
codebook's entries.  A node picks split points far from each other, deals its other
entries to the nearest of them, and stores for every split point and every subtree the
least and greatest distance between the two.  A query at distance ``d`` from a split point
with best distance ``b`` so far cannot find anything as near in a subtree whose stored
distances all lie outside ``[d - b, d + b]``; such a subtree is left out.  Stored
distances are rounded outward and a query's towards keeping, and only what lies strictly
outside is left out; whatever is reached is compared by its integer distance, then by
number.  So ties go to the lower number as if all entries had been compared.

Spark deals out the vectors.  A task builds the trees (they follow from the codebooks,
``parts * entries`` rows, which travel with the job), walks them with many vectors at a
time, and when it ends returns one sum per entry and component.  What is shuffled in a
round grows with the tasks, not with the rows.  The driver holds the codebooks only.

``label_error`` joins each label's total back to its rows.  Labels with at least a
thousandth of all rows are at most a thousand; these are broadcast, so no task gets the
rows of a frequent label; the others are joined by Spark as it sees fit.

Edge cases: vectors that are null or hold a null, NaN or infinite component are left out.
The length of most vectors (of equally many the greatest) counts; vectors of another
length, of a length that ``parts`` does not divide (0 included), or with a component
beyond ``vectors.bound(length)`` are returned with null code and error and take no part.
Rows without an id come last where the first entries are chosen; rows with equal ids are
told apart by their vectors; repeated rows count each.  Fewer vectors than ``entries``
give as many entries; an empty table gives an empty result.  Equal entries: the lower
number gets the parts, the other one stays.  A label's
sum beyond 64 bits is null.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veladura.llm import vectors
from veladura.llm.common import cut, ship

ship(__name__)

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SPLITS, LEAF = 8, 12
_ROUND = 1e-12


class _Node:
    """Split points with the distance ranges to each other's subtrees; or a leaf of entries."""

    def __init__(self, points: np.ndarray, numbers: np.ndarray):
        own = points[numbers]
        self.children: list[_Node | None] = []
        if len(numbers) <= LEAF:
            self.numbers, self.points = numbers, own
            return
        apart = vectors.squared(own, own)
        chosen = [0]
        while len(chosen) < SPLITS:
            chosen.append(int(apart[chosen].min(0).argmax()))
        chosen = sorted(set(chosen))
        self.numbers, self.points = numbers[chosen], own[chosen]
        rest = np.setdiff1d(np.arange(len(numbers)), chosen)
        nearest = apart[np.ix_(chosen, rest)].argmin(0)
        roots = np.sqrt(apart[chosen].astype(np.float64))
        self.low = np.zeros((len(chosen), len(chosen)))
        self.high = np.zeros((len(chosen), len(chosen)))
        for j in range(len(chosen)):
            members = rest[nearest == j]
            if len(members) == 0:
                self.children.append(None)
                continue
            self.low[:, j] = roots[:, members].min(1) * (1 - _ROUND)
            self.high[:, j] = roots[:, members].max(1) * (1 + _ROUND)
            self.children.append(_Node(points, numbers[members]))


class Tree:
    """The entries of one codebook, ready to be searched."""

    def __init__(self, entries: np.ndarray):
        self.root = _Node(entries, np.arange(len(entries)))
        self.compared = 0  # distances computed so far

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry and the squared distance to it, for every row."""
        best = np.full(len(x), np.iinfo(np.int64).max, dtype=np.int64)
        number = np.full(len(x), np.iinfo(np.int64).max, dtype=np.int64)
        self._visit(self.root, x, np.arange(len(x)), best, number)
        return number, best

    def _visit(self, node: _Node, x, rows, best, number) -> None:
        if len(rows) == 0:
            return
        distance = vectors.squared(x[rows], node.points)
        self.compared += distance.size
        nearest = distance.min(1)
        at = np.where(distance == nearest[:, None], node.numbers[None, :], np.iinfo(np.int64).max).min(1)
        better = (nearest < best[rows]) | ((nearest == best[rows]) & (at < number[rows]))
        best[rows[better]], number[rows[better]] = nearest[better], at[better]
        if not node.children:
            return
        roots = np.sqrt(distance.astype(np.float64))
        least, most = roots * (1 - _ROUND), roots * (1 + _ROUND)
        home = distance.argmin(1)
        # first where the query most likely belongs, then wherever its best is not yet enough
        for first in (True, False):
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                reach = np.sqrt(best[rows].astype(np.float64))[:, None] * (1 + _ROUND)
                outside = (least - reach > node.high[:, j]) | (most + reach < node.low[:, j])
                goes = ~outside.any(1) & ((home == j) == first)
                self._visit(child, x, rows[goes], best, number)


def _blocks(batches, dim: int):
    for batch in batches:
        for start in range(0, batch.num_rows, vectors.BLOCK):
            part = batch.slice(start, vectors.BLOCK)
            yield part, vectors.matrix(part.column("whole"), dim)


def _gather(stored: DataFrame, books: np.ndarray) -> dict[int, int]:
    """Per part and entry the sums of the components assigned to it, then their number."""
    parts, entries, width = books.shape

    def run(batches):
        trees = [Tree(book) for book in books]
        sums = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for _, x in _blocks(batches, parts * width):
            for p, tree in enumerate(trees):
                own = x[:, p * width : (p + 1) * width]
                number, _ = tree.nearest(own)
                np.add.at(sums[p, :, :width], number, own)
                sums[p, :, width] += np.bincount(number, minlength=entries)
        held = np.flatnonzero(np.repeat(sums[:, :, width].ravel() > 0, width + 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int64()), pa.array(sums.ravel()[held], pa.int64())], ["slot", "total"]
        )

    return vectors.summed(stored.select("whole").mapInArrow(run, "slot bigint, total bigint"))


def move(books: np.ndarray, sums: dict[int, int]) -> np.ndarray:
    """Every entry at the floor of its parts' mean; unused entries stay."""
    parts, entries, width = books.shape
    moved = books.copy()
    for slot in range(parts * entries):
        n = sums.get(slot * (width + 1) + width, 0)
        if n:
            p, e = divmod(slot, entries)
            moved[p, e] = [sums[slot * (width + 1) + i] // n for i in range(width)]
    return moved


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def usual_length(kept: DataFrame) -> int:
    """The length of most vectors; of equally many the greatest; 0 without vectors."""
    lengths = kept.groupBy(F.size("vector").alias("n")).count()
    row = lengths.orderBy(F.desc("count"), F.desc("n")).first()
    return row["n"] if row else 0


def encode(
    df: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """``id, code, error, label_error, codebooks_sha256`` and the codebooks.

    ``code`` has one byte of two hexadecimal digits for each part, so ``entries`` is 256 at most.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code byte tells 1 to 256 entries apart")
    kept = df.select(
        F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("vector")
    ).filter(vectors.finite(F.col("vector")))
    dim = usual_length(kept)
    fits = vectors.whole(F.col("vector"), dim) if dim % parts == 0 and dim else F.lit(None).cast("array<bigint>")
    every = cut(kept.select("id", "label", fits.alias("whole")), "vectors")
    stored = every.filter("whole is not null")
    first = stored.orderBy(F.asc_nulls_last("id"), "whole").limit(entries).select("whole").collect()
    books = np.array([r[0] for r in first], dtype=np.int64).reshape(len(first), parts, -1 if first else 0)
    books = np.ascontiguousarray(books.transpose(1, 0, 2))
    for _ in range(rounds if first else 0):
        books = move(books, _gather(stored, books))

    def run(batches):
        trees = [Tree(book) for book in books]
        width = books.shape[2]
        for part, x in _blocks(batches, parts * width):
            found = [t.nearest(x[:, p * width : (p + 1) * width]) for p, t in enumerate(trees)]
            codes = np.stack([n for n, _ in found], 1).astype(np.uint8)
            columns = [
                part.column("id"), part.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()),
                pa.array(sum(d for _, d in found), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "code", "error"])

    kind = {f.name: f.dataType.simpleString() for f in every.schema}
    coded = stored.mapInArrow(run, f"id {kind['id']}, label {kind['label']}, code string, error bigint")
    none = every.filter("whole is null").select(
        "id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")
    )
    coded = with_label_error(cut(coded.unionByName(none), "codes"))
    return coded.select(
        F.col("id").alias(id), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    ), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``id, code, error`` and the sum of ``error`` over all rows with an equal label; nulls are equal."""
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint")
    per_label = coded.groupBy(F.col("label").alias("of")).agg(
        total.alias("label_error"), F.count(F.lit(1)).alias("n")
    )
    totals, rows = cut(per_label, "label-totals"), coded.count()
    same = F.col("label").eqNullSafe(F.col("of"))
    frequent = F.col("n") * 1000 >= rows
    few = F.broadcast(totals.filter(frequent).drop("n"))  # a thousand labels at most
    often = coded.join(few, same)
    seldom = coded.join(few.select("of"), same, "left_anti")
    seldom = seldom.join(totals.filter(~frequent).drop("n"), same)
    columns = ["id", "code", "error", "label_error"]
    return often.select(columns).unionByName(seldom.select(columns))
