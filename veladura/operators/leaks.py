"""Raw values anywhere in any output text: inside longer values, of other rows, in free text.

Texts are indexed by their q-grams, and each raw value is looked up by one of its own: the
one that fewest raw values have, so that a surname or a mail domain shared by millions
leads nowhere.  A value shorter than ``GRAM`` is its own gram.  What meets in the join is
a gram with its surroundings against ``(gram, value)``; each meeting is then verified on the
text, so the result is exact.

What it costs: one pass over the texts, which asks a bitmap of the values' grams about every
character.  The bitmap has a few bytes per value and never more than ``MOST_BITS``; what it
lets through by chance (one place in some thousands, more only above 16 million values) goes
into the join and is left out there.  So the places that are shuffled grow with what is found,
not with the texts.  Texts are cut into pieces with overlaps, so a long one costs time in
proportion to its length and never crowds memory.  Values longer than ``REACH`` are verified in a second
join, of their meetings with the pieces.  There is no comparison of all values with all texts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.operators.protect import has_value, named
from veladura.session import kept

GRAM = 8
PIECE = 4096
REACH = 128
BITS_PER_VALUE, MOST_BITS = 32, 1 << 29
_SECTION = 1 << 15  # bits that one value of bitmap_construct_agg holds
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = tuple(np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))
_MET = "place bigint, at int, gram string, lead int, window string"


def raw_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct ``column, value`` of some raw columns; null and blank values are none."""
    entries = [F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*entries))).filter(has_value(F.col("value"))).distinct()


def output_texts(df: DataFrame, key: str, columns: list[str], table: str) -> DataFrame:
    """``table, key, shown_in, text``: every given column of every row as a text of its own."""
    entries = [F.struct(F.lit(c).alias("shown_in"), named(c).cast("string").alias("text")) for c in columns]
    return df.select(
        F.lit(table).alias("table"), named(key).cast("string").alias("key"), F.inline(F.array(*entries))
    ).filter("text is not null")


def _grams(text: Column, size: int, last: Column) -> Column:
    """``array<struct<gram,at>>`` of all grams that begin at 1 to ``last`` (code points)."""
    at = F.sequence(F.lit(1), F.least(last, F.length(text) - (size - 1)))
    grams = F.transform(
        at, lambda i: F.struct(F.xxhash64(F.substr(text, i, F.lit(size))).alias("gram"), i.alias("at"))
    )
    none = F.array().cast("array<struct<gram:bigint,at:int>>")
    return F.when(F.length(text) >= size, grams).otherwise(none)


def _anchors(values: DataFrame) -> DataFrame:
    """``gram, before, value``: the rarest gram of each value and the characters before it."""
    each = values.select("value").distinct().withColumn("n", F.length("value"))
    short = each.filter(F.col("n") < GRAM).select(
        F.xxhash64("value").alias("gram"), F.lit(0).alias("before"), "value"
    )
    long = each.filter(F.col("n") >= GRAM)
    parts = long.select("value", F.inline(_grams(F.col("value"), GRAM, F.col("n"))))
    rare = parts.groupBy("gram").agg(F.least(F.count(F.lit(1)), F.lit((1 << 31) - 1)).alias("held_by"))
    # the smallest count, then the first place: one number, for which no rows need to be sorted
    best = F.min(F.shiftleft("held_by", 32) + F.col("at")).alias("best")
    chosen = parts.join(rare, "gram").groupBy("value").agg(best)
    at = F.col("best").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    gram = F.xxhash64(F.substr("value", at, F.lit(GRAM))).alias("gram")
    return short.unionByName(chosen.select(gram, (at - 1).alias("before"), "value"))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(codes: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """A number for each place of ``codes``, or each that is given, at which ``size`` characters begin."""
    n = max(0, len(codes) - size + 1)
    out = np.full(n if at is None else len(at), size, np.uint64)
    for k in range(size):
        out *= _STEP
        out += codes[k : k + n] if at is None else codes[at + k]
    out ^= out >> np.uint64(29)
    return out


def _bits(hashes: np.ndarray, factor: np.uint64, width: int) -> np.ndarray:
    return (hashes * factor) >> np.uint64(64 - width)


def _bitmap(anchors: DataFrame) -> tuple[int, Broadcast]:
    """A Bloom filter of the anchors' grams: ``2 ** width`` bits, few per value, for all tasks."""
    width = (BITS_PER_VALUE * max(anchors.count(), _SECTION // BITS_PER_VALUE) - 1).bit_length()
    width = min(width, MOST_BITS.bit_length() - 1)

    def places(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            codes, lengths = _codes("".join(texts)), np.array([len(t) for t in texts], np.int64)
            begins = np.cumsum(lengths) - lengths
            hashes = [_hashes(codes, n, begins[lengths == n]) for n in np.unique(lengths).tolist()]
            each = np.concatenate([np.empty(0, np.uint64), *hashes])
            set_bits = np.concatenate([_bits(each, factor, width) for factor in _SPREAD])
            yield pa.RecordBatch.from_arrays([pa.array(set_bits.astype(np.int64) + 1)], ["bit"])

    grams = anchors.select(F.substr("value", F.col("before") + 1, F.lit(GRAM)))
    sections = grams.mapInArrow(places, "bit bigint").groupBy(F.bitmap_bucket_number("bit").alias("section"))
    held = sections.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bitmap, size = bytearray((1 << width) // 8), _SECTION // 8
    for section, bits in held.toLocalIterator():
        bitmap[(section - 1) * size : section * size] = bits
    return width, anchors.sparkSession.sparkContext.broadcast(bytes(bitmap))


def _pieces(texts: DataFrame, overlap: int) -> DataFrame:
    """``place, piece, lead, own, around``: a text's pieces, with ``overlap`` characters of what is beside them."""
    near = -(-overlap // PIECE)  # so many neighbours on each side

    def beside(cut: Column, piece: Column, steps: range) -> Column:
        parts = [F.coalesce(F.get(cut, piece + k), F.lit("")) for k in steps]
        return F.concat(*parts) if parts else F.lit("")

    def widened(cut: Column):
        def one(own: Column, piece: Column) -> Column:
            lead = F.right(beside(cut, piece, range(-near, 0)), F.lit(overlap))
            after = F.left(beside(cut, piece, range(1, near + 1)), F.lit(overlap))
            return F.struct(
                piece.alias("piece"), F.length(lead).alias("lead"), F.length(own).alias("own"),
                F.concat(lead, own, after).alias("around"),
            )

        return one

    cut = texts.select("place", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), 0).alias("cut"))
    return cut.select("place", F.inline(F.transform("cut", widened(F.col("cut")))))


def _met(pieces: DataFrame, sizes: list[int], reach: int, width: int, bitmap: Broadcast) -> DataFrame:
    """``place, at, gram, lead, window``: where a gram stands that the bitmap knows.

    ``window`` is the gram and up to ``reach`` characters before it (``lead`` of them) and
    from its beginning on; for grams that are a whole value, no more than the gram.
    """
    piece = PIECE

    def look(batches):
        known = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            rows = dict(zip(batch.schema.names, batch.columns))
            texts = rows["around"].to_pylist()
            numbers = {c: rows[c].to_numpy() for c in ("place", "piece", "lead", "own")}
            step = max(1, (1 << 20) // (piece + 2 * reach + 1))
            for first in range(0, len(texts), step):
                some = slice(first, first + step)
                yield from among(known, texts[some], {c: n[some] for c, n in numbers.items()})

    def among(known, texts, numbers):
        joined = "".join(texts)
        codes, lengths = _codes(joined), np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(lengths) - lengths
        for size in sizes:
            hashes = _hashes(codes, size)
            found = np.arange(len(hashes))
            for factor in _SPREAD:
                bit = _bits(hashes, factor, width)
                hit = np.flatnonzero(known[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                found, hashes = found[hit], hashes[hit]
            # the text of each place; no place of a neighbour, none that runs into the next text
            of = np.searchsorted(begins, found, "right") - 1
            inside = found - begins[of]
            own = inside - numbers["lead"][of]
            good = (own >= 0) & (own < numbers["own"][of]) & (inside + size <= lengths[of])
            found, of, inside, own = found[good], of[good], inside[good], own[good]
            lead = np.minimum(inside, reach) if size == GRAM else np.zeros(len(found), np.int64)
            after = np.minimum(lengths[of] - inside, reach if size == GRAM else size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(numbers["place"][of]),
                    pa.array((numbers["piece"][of] * piece + own + 1).astype(np.int32)),
                    pa.array([joined[i : i + size] for i in found.tolist()], pa.string()),
                    pa.array(lead.astype(np.int32)),
                    pa.array([joined[a:b] for a, b in zip((found - lead).tolist(), (found + after).tolist())], pa.string()),
                ],
                ["place", "at", "gram", "lead", "window"],
            )

    return pieces.mapInArrow(look, _MET)


def leaks_anywhere(values: DataFrame, texts: DataFrame) -> DataFrame:
    """Where raw values stand in texts: the columns of ``texts`` but its text, ``column, value, start, n``.

    ``values`` has ``column, value``, ``texts`` has ``text`` and columns that say where it
    is.  One row per text and value; ``start`` is its first place there (from 1), ``n`` how
    often it occurs, overlaps included.  A null text holds nothing; a blank value is none.
    """
    where = [c for c in texts.columns if c != "text"]
    own = F.struct(*[named(c) for c in where]) if where else F.lit(None)
    texts = texts.select(own.alias("where"), "text", F.monotonically_increasing_id().alias("place"))
    texts = kept(texts, "leak-texts")
    values = kept(values.filter(has_value(F.col("value"))).select("column", "value").distinct(), "leak-values")
    anchors = kept(_anchors(values), "leak-anchors")
    # at most GRAM lengths, and the longest value
    sizes = sorted(r[0] for r in values.select(F.least(F.length("value"), F.lit(GRAM))).distinct().collect())
    longest = values.agg(F.max(F.length("value"))).first()[0] or 0
    reach, given = min(longest, REACH), texts.filter("text is not null")
    met = _met(_pieces(given, reach), sizes, reach, *_bitmap(anchors))
    met = met.withColumn("gram", F.xxhash64("gram")).join(anchors, "gram")
    size, first = F.length("value"), F.col("lead") + 1 - F.col("before")
    start = F.col("at") - F.col("before")
    whole = (size <= reach) & (first > 0) & (F.substr("window", first, size) == F.col("value"))
    found = met.filter(whole).select("place", "value", start.alias("start"))
    if longest > reach:
        # of a longer value the window has a part; what has that part is looked up in the text
        skipped, begin = F.greatest(F.lit(0), 1 - first), F.greatest(F.lit(1), first)
        n = F.least(size - skipped, F.length("window") - begin + 1)
        part = F.substr("window", begin, n) == F.substr("value", skipped + 1, n)
        at_piece = F.call_function("div", F.col("at") - 1, F.lit(PIECE)).cast("int")
        maybe = met.filter((size > reach) & part).select(
            F.col("place").alias("of"), at_piece.alias("of_piece"), "at", "before", "value"
        )
        same = (F.col("place") == F.col("of")) & (F.col("piece") == F.col("of_piece"))
        begin = F.col("lead") + F.col("at") - F.col("piece") * PIECE - F.col("before")
        held = (begin > 0) & (F.substr("around", begin, size) == F.col("value"))
        longer = _pieces(given, longest).join(maybe, same).filter(held)
        found = found.unionByName(longer.select("place", "value", start.alias("start")))
    found = found.groupBy("place", "value").agg(F.min("start").alias("start"), F.count(F.lit(1)).alias("n"))
    return (
        found.join(texts.drop("text"), "place")
        .join(values, "value")
        .select(*[F.col("where")[c].alias(c) for c in where], "column", "value", "start", "n")
    )


def tables_with_leaks(found: DataFrame) -> DataFrame:
    """Per table, output column and raw column: how many values and texts are concerned."""
    return found.groupBy("table", "shown_in", "column").agg(
        F.countDistinct("value").alias("n_values"), F.countDistinct("key").alias("n_texts")
    )


def all_outputs(*texts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, texts)
