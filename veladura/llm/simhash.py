"""SimHash near-duplicates through BK-trees.

A text's fingerprint has a bit where more than half of its word shingles' hashes have
it.  Fingerprints that differ in at most ``RADIUS`` bits are linked, and linked
fingerprints form components.

Search.  Two fingerprints within the radius agree on at least one of RADIUS + 1 blocks
of bits, and on at least one of as many blocks of the rest, and so on.  The shards are
the values of such block pairs (nine ways to pair them), so every link lies inside a
shard.  Each shard becomes a BK-tree: a child hangs under its parent at the edge named
by their integer Hamming distance, and a search at distance d follows only the edges
d - RADIUS to d + RADIUS.  The tree is built by the task that holds its shard and is
searched there by the shard's members, which are all that can match it; broadcasting
trees that grow with the corpus would have no size bound.

Only distinct fingerprints are searched, so copies cost nothing.  A shard above
``SHARD`` members is cut on further blocks until it fits or no bits are left, which
loses no link.  A shard returns a star per linked group, not its pairs.

Edge cases: null and empty texts, and texts of blanks, have fingerprint zero and are
linked like any other; with fewer words than a shingle the whole sequence is the only
shingle; repeated rows are rows of the same component; null ids never become a
component's id unless it has no other (then null); an empty table gives an empty
result; other columns are ignored, and kept by ``drop_near_copies``.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veladura.llm.common import cut, free_name, map_batches, ship, with_text_value
from veladura.llm.components import components

ship(__name__)

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Members of the largest shard that one tree takes.
SHARD = 4096
_SLICE = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint, as a signed number."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and [\x20\x09-\x0D] only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    width = min(shingle, len(words))
    starts = [0, *ends[: len(words) - width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SLICE):
        block = hashes[at : at + _SLICE].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint`` of every whole text."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def prepare():
        def run(columns):
            return {
                "doc_id": columns["doc_id"],
                "fingerprint": [fingerprint(t, shingle) for t in columns["text"]],
            }

        return run

    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, fingerprint bigint", prepare)


class BkTree:
    """Numbers by Hamming distance; each node is its value and its children by distance."""

    def __init__(self, radius: int):
        self.radius, self.root = radius, None

    def add(self, value: int) -> list[int]:
        """Put a value in; what it already held within the radius of it."""
        found: list[int] = []
        if self.root is None:
            self.root = (value, {})
            return found
        radius, below = self.radius, [self.root]
        while below:
            held, children = below.pop()
            d = (held ^ value).bit_count()
            if d <= radius:
                found.append(held)
            for e in range(max(d - radius, 1), d + radius + 1):
                if e in children:
                    below.append(children[e])
        held, children = self.root
        while d := (held ^ value).bit_count():
            if d not in children:
                children[d] = (value, {})
                break
            held, children = children[d]
        return found


def link_shard(values: list[int], radius: int) -> list[tuple[int, int]]:
    """``(value, root)`` for each value that is linked to a smaller one of its shard."""
    tree, up = BkTree(radius), {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    mask = (1 << 64) - 1
    for v in sorted(set(values)):
        up[v] = v
        for near in tree.add(v & mask):
            a, b = root(v), root(near - (1 << 64) if near >> 63 else near)
            if a != b:
                up[max(a, b)] = min(a, b)
    return [(v, r) for v in up if (r := root(v)) != v]


def block_masks(depth: int, radius: int) -> list[int]:
    """Bits that a shard's members agree on, for every way to choose ``depth`` blocks in turn."""
    chosen: list[tuple[int, list[int]]] = [(0, list(range(64)))]
    for _ in range(depth):
        chosen = [
            (mask | sum(1 << b for b in part), [b for b in rest if b not in set(part)])
            for mask, rest in chosen
            for part in (x.tolist() for x in np.array_split(rest, radius + 1))
        ]
    return [mask - (1 << 64) if mask >> 63 else mask for mask, _ in chosen]


def near_links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``u, v``: stars over the linked fingerprints of each shard of distinct ``fingerprint``s."""
    if shard < 4:
        raise ValueError("a shard takes four members at least: so many differ in two bits only")
    of = F.col("fingerprint")
    ways = [
        F.struct(F.lit(i).alias("way"), of.bitwiseAND(F.lit(m)).alias("bits"))
        for i, m in enumerate(block_masks(2, radius))
    ]
    links = []
    depth, n = 2, distinct.count()
    members = distinct.select("fingerprint", F.explode(F.array(*ways)).alias("s")).select(
        "s.way", "s.bits", "fingerprint"
    )
    while True:
        sizes = members.groupBy("way", "bits").count().filter("count > 1")
        sizes = cut(sizes, "shard-sizes", len(ways) * n)
        fits = sizes.filter(F.col("count") <= shard).select("way", "bits")
        held = members.join(fits, ["way", "bits"]).groupBy("way", "bits").agg(
            F.collect_list("fingerprint").alias("values")
        )

        def prepare():
            def run(columns):
                pairs = [p for values in columns["values"] for p in link_shard(values, radius)]
                return {"u": [u for u, _ in pairs], "v": [v for _, v in pairs]}

            return run

        found = map_batches(held.select("values"), "u bigint, v bigint", prepare)
        links.append(cut(found, "near", 8 * n))  # trees cost more than rows that are only moved
        large = sizes.filter(F.col("count") > shard).select("way", "bits")
        if large.isEmpty():
            break
        depth += 1
        finer = [(i // (radius + 1), i, m) for i, m in enumerate(block_masks(depth, radius))]
        finer = distinct.sparkSession.createDataFrame(finer, "way int, finer int, mask bigint")
        members = cut(
            members.join(large, ["way", "bits"])
            .join(F.broadcast(finer), "way")  # (radius + 1) ** depth rows
            .select(F.col("finer").alias("way"), of.bitwiseAND(F.col("mask")).alias("bits"), "fingerprint"),
            "shards",
        )
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def fingerprint_components(
    prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, n: int | None = None
) -> DataFrame:
    """``fingerprint, root, component_id, n_docs`` for every distinct fingerprint.

    ``n`` is the number of documents, if that is known more cheaply than by counting
    ``prints``, which are read once apart from that.
    """
    n = prints.count() if n is None else n
    distinct = cut(
        prints.groupBy("fingerprint").agg(
            F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_docs")
        ),
        "fingerprints",
        n,
    )
    links = near_links(distinct.select("fingerprint"), radius, shard)
    roots = components(links, links.count())
    rooted = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = cut(
        rooted.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least", "n_docs"),
        "rooted",
        n,
    )
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components", n)
    return cut(
        rooted.join(named, "root").select("fingerprint", "root", "component_id", "n_docs"), "classes", n
    )


def near_copies(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document; fingerprints in hex."""
    prints = cut(fingerprints(docs, shingle), "prints", docs.count(), gather=True)
    classes = fingerprint_components(prints, radius, shard)
    return prints.join(classes, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, shard: int = SHARD
) -> DataFrame:
    """One document of each component: that with the component's id, with the columns it had."""
    classes = fingerprint_components(fingerprints(docs, shingle), radius, shard, docs.count())
    # the fingerprints follow from the texts again, so rows need no key of their own
    name = free_name(docs, "fingerprint")
    marked = with_text_value(docs, name, "bigint", lambda: lambda text: fingerprint(text, shingle))
    rows = marked.select(F.struct(*docs.columns).alias("row"), F.col(name).alias("fingerprint"))
    kept = rows.join(classes, "fingerprint").filter(
        F.col("row.doc_id").eqNullSafe(F.col("component_id"))
    )
    one = kept.groupBy("root").agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    return one.select("row.*")
