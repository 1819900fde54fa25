"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words joined by single blanks, so that case,
punctuation and line breaks don't matter.  An item of m characters may differ by
k = ``ERRORS`` * m edits from the passage of a text that holds it.  Cut into k + 1
pieces, at least one piece survives k edits unharmed; an automaton over all pieces
(Aho-Corasick) finds these in one pass over the text.  Around each hit Myers'
bit-parallel algorithm computes the smallest edit distance of the item to any
substring, and the item counts as held if that is k or less.  Before that the hit must
hold with its neighbours: halving the pieces again and again, of j pieces together
with j - 1 edits or fewer at least one half again has fewer edits than pieces, so some
hit passes at every step up to the whole item, and chance hits end at the first one.

The items are not part of the corpus that grows: their distinct texts go to all tasks in
blocks of about ``BLOCK_CHARS`` characters, one pass over the documents per block, and with
several blocks a pass is written before the next one begins: driver and tasks hold one block
at a time, whatever the table holds.  Documents are never shuffled for finding.

Edge cases: null and empty texts hold nothing; items without words are never held;
an item too short for one edit must be held as it is, and not inside a longer word; equal
items are found each; null
ids of documents give rows like any other; empty tables give empty results (and drop
nothing); other columns are ignored, and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veladura.llm.common import cut, free_name, map_batches, ship, with_text_value

ship(__name__)

#: Edits allowed per character of an item, and characters of items in one block.
ERRORS, BLOCK_CHARS = 0.1, 4_000_000

_WORD = re.compile(r"\w+")


def normal(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 pieces of an item, as even as possible, with their offsets."""
    n = budget + 1
    borders = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(borders, borders[1:])]


def letter_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def best_distance(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to a substring of ``text``, and where it ends.

    Myers' algorithm: one column of the distance matrix is two bit vectors of its
    vertical differences, and the text's next letter updates all rows at once.
    """
    full = (1 << size) - 1
    top = 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = size, 0
    get = masks.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full  # a match may start anywhere: the top row stays 0
        down = down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        if score < best:
            best, end = score, i
    return best, end


def halvings(n: int) -> list[list[tuple[int, int]]]:
    """For each of ``n`` pieces the ranges that hold it, from two or three pieces up to half of all."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    below = [(0, n)]
    while below:
        a, b = below.pop()
        if b - a > 1:
            if b - a < n:
                for i in range(a, b):
                    out[i].insert(0, (a, b))
            below += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return out


class ItemMatcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[object, str]], errors: float):
        import ahocorasick

        self.items, owners = [], {}
        for number, text in items:
            words = normal(text)
            if not words:
                continue
            budget = math.floor(len(words) * errors)
            at = len(self.items)
            self.items.append((number, len(words), budget, letter_masks(words)))
            cut = pieces(words, budget)
            ends = [*(a for a, _ in cut), len(words)]
            parts = {}  # shared by the pieces in them
            for (offset, piece), ranges in zip(cut, halvings(budget + 1)):
                steps = []
                for a, b in ranges:
                    if (a, b) not in parts:
                        part = words[ends[a] : ends[b]]
                        parts[a, b] = (ends[a], len(part), b - a - 1, letter_masks(part))
                    steps.append(parts[a, b])
                owners.setdefault(piece, []).append((at, offset, steps))
        self.automaton = ahocorasick.Automaton()
        for piece, held in owners.items():
            self.automaton.add_word(piece, (len(piece), held))
        if owners:
            self.automaton.make_automaton()

    def search(self, text: str | None) -> list[tuple]:
        """``(item id, distance, start, end)``: the best match of each held item.

        The positions are those of the words' text; a match starts at the earliest
        place that the distance allows for.
        """
        if not self.items or not text:
            return []
        words = normal(text)
        best: dict[int, tuple] = {}
        tried: dict[int, int] = {}
        for last, (size, held) in self.automaton.iter(words):
            begin = last + 1 - size
            for at, offset, steps in held:
                number, length, budget, masks = self.items[at]
                start = begin - offset
                # the window tried last also covers matches that begin a few edits later
                if at in tried and tried[at] <= start <= tried[at] + budget:
                    continue
                if at in best and best[at][0] == 0:
                    continue
                if not budget and (words[start - 1 : start].strip() or words[last + 1 : last + 2].strip()):
                    continue  # inside a longer word
                if not all(_near(words, start, step) for step in steps):
                    continue
                tried[at] = start
                low = max(0, start - budget)
                high = start + length + 3 * budget
                distance, end = best_distance(masks, length, words[low:high])
                if distance <= budget and (at not in best or distance < best[at][0]):
                    best[at] = (distance, low + end)
        return sorted(
            (self.items[at][0], d, max(0, end - self.items[at][1] - d), end)
            for at, (d, end) in best.items()
        )


def _near(words: str, start: int, step: tuple) -> bool:
    offset, size, edits, masks = step
    low = max(0, start + offset - edits)
    return best_distance(masks, size, words[low : start + offset + size + edits])[0] <= edits


def item_key(text: Column) -> Column:
    return F.sha2(text, 256)


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[bool, list[tuple]]]:
    """The distinct items with their keys, in blocks taken to the driver one at a time.

    Equal texts count once, so a text that fills the benchmark fills no block.  A block is
    a share of the texts' hashes; whether there are several is told with each.
    """
    items = benchmark.select("text").filter(F.length("text") > 0).distinct()
    total = items.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    n = max(1, math.ceil(total / block_chars))
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    for i in range(n if total else 0):
        block = items.filter(part == i).select(item_key(F.col("text")), "text")
        yield n > 1, sorted(tuple(r) for r in block.collect())


def contaminated(
    docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``doc_id, item_id, distance, start, end`` for each item that a document holds."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, item_key string, distance int, start bigint, end bigint"
    found = docs.sparkSession.createDataFrame([], schema)
    for several, items in item_blocks(benchmark, block_chars):

        def prepare(items=items):
            matcher = ItemMatcher(items, errors)

            def run(columns):
                rows = [
                    (doc, *hit)
                    for doc, text in zip(columns["doc_id"], columns["text"])
                    for hit in matcher.search(text)
                ]
                names = ("doc_id", "item_key", "distance", "start", "end")
                return dict(zip(names, zip(*rows) if rows else [[]] * 5))

            return run

        hits = map_batches(docs.select("doc_id", "text"), schema, prepare)
        # of several blocks each is done with before the next one is taken
        found = found.unionByName(cut(hits, "item-hits") if several else hits)
    items = benchmark.filter(F.length("text") > 0)
    items = items.select("item_id", item_key(F.col("text")).alias("of_key"))
    joined = found.join(items, F.col("item_key") == F.col("of_key"))
    return joined.select("doc_id", "item_id", "distance", "start", "end")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The documents that hold no item, with the columns they had."""
    columns = docs.columns
    for several, items in item_blocks(benchmark, block_chars):
        name = free_name(docs, "n_items")

        def prepare(items=items):
            matcher = ItemMatcher(items, errors)
            return lambda text: len(matcher.search(text))

        docs = with_text_value(docs, name, "bigint", prepare).filter(F.col(name) == 0).select(*columns)
        if several:
            docs = cut(docs, "without-items")
    return docs
