"""SimHash near-dedup against brute force."""

import random

import pytest
import xxhash

from veladura.llm import simhash
from veladura.llm.components import components
from veladura.llm.queries import QUERIES


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def slow_components(numbers, radius=2):
    up = {v: v for v in numbers}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    values = sorted(up)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                up[root(a)] = root(b)
    return {v: root(v) for v in values}


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO", "a b c", "É b\x0bc\x1cd e f É b", "x " * 9000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == slow_fingerprint(text)


def near_numbers(n, seed):
    chance = random.Random(seed)
    out = [0, (1 << 64) - 1]
    while len(out) < n:
        v = chance.getrandbits(64)
        for _ in range(chance.choice([1, 1, 5, 40])):
            out.append(v)
            for _ in range(chance.randint(1, 3)):
                v ^= 1 << chance.randrange(64)
    return out[:n]


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("shard", [4096, 8])
def test_components_match_brute_force(spark, shard):
    numbers = near_numbers(700, 5) + near_numbers(100, 6)[:50] * 3
    rows = [(i, signed(v)) for i, v in enumerate(numbers)]
    df = spark.createDataFrame(rows, "doc_id bigint, fingerprint bigint").repartition(5)
    got = simhash.fingerprint_components(df, shard=shard).collect()
    roots = slow_components(numbers)
    least = {}
    for i, v in enumerate(numbers):
        least[roots[v]] = min(i, least.get(roots[v], i))
    assert {r.fingerprint: r.component_id for r in got} == {
        signed(v): least[roots[v]] for v in roots
    }
    assert sum(r.n_docs for r in got) == len(numbers)


def test_tree_finds_all_within_radius():
    numbers = near_numbers(400, 9)
    tree, seen = simhash.BkTree(2), set()
    for v in numbers:
        assert set(tree.add(v)) == {s for s in seen if (s ^ v).bit_count() <= 2}
        seen.add(v)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "u bigint, v bigint")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {i: 0 for i in range(1, 301)} | {901: 900}


def test_drop_keeps_one_of_each_group(spark):
    rows = [
        (5, "the same words stand here twice", "x"),
        (5, "the same words stand here twice", "x"),
        (3, "The SAME words stand here twice", "y"),
        (5, "something else entirely is told in this one", "z"),
        (None, "only here and without any id", "w"),
        (None, "only here and without any id", "w"),
        (8, None, "v"),
        (9, "", "u"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string")
    out = simhash.drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.fingerprint) for r in out.collect()) == [
        ("3", "y"), ("5", "z"), ("8", "v"), ("None", "w"),
    ]
    assert simhash.drop_near_copies(df.limit(0)).isEmpty()


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: slow_fingerprint(t) for i, t in texts.items()}
    roots = slow_components(set(prints.values()))
    least = {}
    for i, v in prints.items():
        least[roots[v]] = min(i, least.get(roots[v], i))
    rows = QUERIES["op10_simhash"](spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {
        (i, f"{v:016x}", least[roots[v]]) for i, v in prints.items()
    }
    assert len(rows) == len(texts)
