"""Vector codes, clusters and mixing against brute force."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veladura.llm import centroids, codes, mixing, vectors


def whole(v):
    return [math.floor(1024 * float(np.float32(x))) for x in v]


def nearest(x, centres):
    return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centres))


def moved(centres, groups):
    return [
        [sum(col) // len(groups[i]) for col in zip(*groups[i])] if groups[i] else c for i, c in enumerate(centres)
    ]


def brute_clusters(rows, k, rounds):
    xs = [(i, whole(v)) for i, v in rows]
    first = sorted(xs, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [x for _, x in first[:k]]
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in xs:
            groups[nearest(x, centres)[1]].append(x)
        centres = moved(centres, groups)
    found = [(i, *nearest(x, centres)) for i, x in xs]
    total = sum(d for _, d, _ in found)
    of = defaultdict(int)
    for _, d, c in found:
        of[c] += d
    return sorted((i, c, d, of[c], total, centroids.digest(np.array(centres[c]))) for i, d, c in found)


def brute_codes(rows, parts, entries, rounds):
    width = len(rows[0][1]) // parts
    xs = [(i, whole(v), label) for i, v, label in rows]
    first = sorted(xs, key=lambda r: (r[0], r[1]))[:entries]
    cut = lambda x, p: x[p * width : (p + 1) * width]
    books = [[cut(x, p) for _, x, _ in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, x, _ in xs:
                groups[nearest(cut(x, p), books[p])[1]].append(cut(x, p))
            books[p] = moved(books[p], groups)
    found = []
    for i, x, label in xs:
        near = [nearest(cut(x, p), books[p]) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), label))
    of = defaultdict(int)
    for _, _, error, label in found:
        of[label] += error
    digest = codes.digest(np.array(books))
    return sorted((i, c, e, of[label], digest) for i, c, e, label in found)


def made(n, dim, seed, values=None):
    r = random.Random(seed)
    one = (lambda: r.choice(values)) if values else (lambda: r.gauss(0, 0.3))
    return [(i, [one() for _ in range(dim)], r.choice([None, 1, 2])) for i in range(n)]


KIND = "vec_id bigint, embedding array<float>, label int"
#: Vectors that are left out, then those that are returned without a result.
ODD = [(-1, None, 1), (-2, [None] * 8, 1), (-3, [math.nan] * 8, 1), (-4, [math.inf] + [0.0] * 7, None)]
UNFIT = [(900, [3e38] * 8, 2), (901, [1.0], 2), (902, [], 2)]


@pytest.mark.parametrize("values", [None, [0.0, 0.25], [-0.0005, 0.0, 0.0005]])
def test_clusters(spark, values):
    """Random vectors; and few distinct ones, with many ties between centroids."""
    rows = made(120, 8, 1, values) + [(5, [0.1] * 8, 1)] * 3
    df = spark.createDataFrame([(*r, "clash") for r in rows + ODD + UNFIT], KIND + ", cluster string")
    out, _ = centroids.cluster(df, k=6, rounds=4, dim=8)
    assert out.columns[0] == "vec_id"
    got = [tuple(r) for r in out.collect()]
    assert sorted(r for r in got if r[0] < 900) == brute_clusters([r[:2] for r in rows], 6, 4)
    total = next(r[4] for r in got if r[0] < 900)
    assert [r for r in got if r[0] >= 900] == [(900, None, None, None, total, None)]


@pytest.mark.parametrize("values", [None, [0.0, 0.25], [-0.0005, 0.0, 0.0005]])
def test_codes(spark, values):
    rows = made(150, 8, 2, values) + [(3, [0.1] * 8, 1)] * 3
    df = spark.createDataFrame([(*r, "clash") for r in rows + ODD + UNFIT], KIND + ", code string")
    out, books = codes.encode(df, parts=4, entries=40, rounds=3)
    got = [tuple(r) for r in out.collect()]
    assert sorted(r for r in got if r[0] < 900) == brute_codes(rows, 4, 40, 3)
    assert sorted(r[0] for r in got if r[0] >= 900) == [900, 901, 902]
    assert all(r[1] is None and r[2] is None and r[3] is not None for r in got if r[0] >= 900)
    assert books.shape == (4, 40, 2)


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i)] * 8, None) for i in range(3)]
    df = spark.createDataFrame(rows, KIND)
    assert sorted(tuple(r) for r in codes.encode(df)[0].collect()) == brute_codes(rows, 4, 256, 4)
    got = sorted(tuple(r) for r in centroids.cluster(df, dim=8)[0].collect())
    assert got == brute_clusters([r[:2] for r in rows], 8, 10)
    none = df.limit(0)
    assert codes.encode(none)[0].isEmpty() and centroids.cluster(none)[0].isEmpty()
    unfit = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 7), (None, [1.0, 2.0, 3.0], 7)], KIND)
    assert [r.code for r in codes.encode(unfit)[0].collect()] == [None, None]
    assert centroids.cluster(unfit)[0].isEmpty()
    with pytest.raises(ValueError):
        codes.encode(df, entries=257)


def test_searches_leave_out_and_agree():
    """On clustered points most distances are never computed, also beyond exact doubles."""
    r = np.random.default_rng(3)
    for scale in (1, 2**12):
        middles = r.integers(-9000, 9000, (32, 16))
        entries = np.concatenate([m + r.integers(-40, 40, (8, 16)) for m in middles]) * scale
        x = (np.concatenate([middles] * 20) + r.integers(-60, 60, (640, 16))) * scale
        every = vectors.squared(x, entries)
        assert every.tolist() == [[sum((a - b) ** 2 for a, b in zip(p, q)) for q in entries.tolist()] for p in x.tolist()]
        tree, search = codes.Tree(entries), centroids.Search(entries)
        for found in (tree.nearest(x), search.nearest(x)):
            assert (found[0] == every.argmin(1)).all() and (found[1] == every.min(1)).all()
        assert tree.compared < every.size / 3 and search.compared < every.size / 3


def brute_mix(rows, weights=(1, 2, 3), epochs=3):
    size = lambda t: len((t or "").encode().split())
    of = defaultdict(int)
    for _, s, t in rows:
        of[s] += size(t)
    names = sorted([s for s in of if s is not None], key=lambda s: s.encode()) + ([None] if None in of else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        words = sum(of.values()) - sum(epochs * of[s] for s in full)
        per = sum(w[s] for s in names if s not in full)
        more = {s for s in names if s not in full and w[s] * words > epochs * of[s] * per}
        if not more:
            break
        full |= more
    target = {s: float(epochs * of[s]) if s in full else w[s] * words / per for s in names}
    want = {s: epochs * of[s] if s in full else w[s] * words // per for s in names}
    before, out = defaultdict(int), []
    key = lambda r: (hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, size(r[2]))
    for doc, s, t in sorted(rows, key=key):
        n, b = size(t), before[s]
        before[s] += n
        taken = sum(max(0, min(n, want[s] - e * of[s] - b)) for e in range(epochs))
        out.append((doc, n, of[s], target[s], taken))
    return sorted(out, key=str)


MIXED = ("doc_id", "size", "source_size", "target", "taken")


def test_mix(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["a", "b", "b", "b", "b", "é", "z"]), "w " * r.randrange(9)) for i in range(400)]
    rows += [(7, "b", "same words here")] * 2500  # one text in most rows of a source
    rows += [(None, "z", "x y"), (None, None, "p\tq\x0br"), (None, None, None), (1, None, ""), (2, "e", " \n")]
    rows += [(3, "long", "word " * 30_000), (4, "\U0001f600", "a b"), (4, "\U0001f600", "c")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id bigint, source string, text string, size int")
    mixed = mixing.mix(df)
    got = mixed.select(*MIXED, "copies", "schedule").collect()
    assert sorted([tuple(g)[:5] for g in got], key=str) == brute_mix(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).select(*MIXED, "copies", "schedule").collect()))
    for g in got:
        assert [c.position for c in g.copies] == sorted(c.position for c in g.copies)
        assert all(0 <= c.position <= 1 and c.words > 0 for c in g.copies)
    assert mixing.mix(df.limit(0)).isEmpty()


def test_deeper_cells(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 1)
    monkeypatch.setattr(mixing, "FAN_DIGITS", 1)
    rows = [(i, "ab"[i % 2], "w " * (i % 7)) for i in range(300)]
    assert mixing._levels(300) == 3
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = mixing.mix(df).select(*MIXED).collect()
    assert sorted([tuple(g) for g in got], key=str) == brute_mix(rows)


def test_schedules(spark):
    s = mixing.Schedule(((0, 0), (0.25, 4), (0.5, 0), (0.75, 0), (1, 2)))
    assert s.weight == 1.25
    shares = [i / 100 for i in range(101)]
    rows = spark.createDataFrame([(x,) for x in shares], "share double").select("share", s.time(F.col("share")).alias("t"))
    grid = np.linspace(0, 1, 100_001)
    line = np.interp(grid, *zip(*s.knots))
    area = np.concatenate([[0], np.cumsum((line[1:] + line[:-1]) / 2 * np.diff(grid))]) / 1.25
    for share, t in rows.collect():
        assert abs(np.interp(t, grid, area) - share) < 1e-6, (share, t)
    for bad in (((0, 1),), ((0, 1), (1, -1)), ((0.1, 1), (1, 1)), ((0, 0), (1, 0))):
        with pytest.raises(ValueError):
            mixing.Schedule(bad)


def test_training_set(spark):
    """Copies come in the order of training time; fading sources come early, growing ones late."""
    rows = [(i, "abc"[i % 3], f"t{i} " * (1 + i % 5), "keep") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, position string")
    out = mixing.training_set(df).collect()
    assert out[0].asDict().keys() == {"doc_id", "source", "text", "position", "position_", "words"}
    at = [r.position_ for r in out]
    assert at == sorted(at) and {r.position for r in out} == {"keep"}
    taken = defaultdict(int)
    for r in out:
        taken[r.doc_id] += r.words
    want = {r.doc_id: r.taken for r in mixing.mix(df).collect() if r.taken}
    assert taken == want
    mean = lambda s: np.mean([r.position_ for r in out if r.source == s])
    assert mean("a") < mean("b") < mean("c")
    named = mixing.mix(df, named={"a": 2, "b": 2, "c": 0}).groupBy("source").agg(F.max("target")).collect()
    assert {s: round(t) for s, t in named} == {"a": 386, "b": 386, "c": 129}


def test_sources_without_words(spark):
    df = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id bigint, source string, text string")
    assert [(r.taken, r.target) for r in mixing.mix(df).collect()] == [(0, 0.0), (0, 0.0)]
