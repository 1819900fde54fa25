"""Raw values inside any output text, against plain search."""

import random

import pytest
from pyspark.sql import functions as F

from veladura.operators import leaks


def plain(values, texts):
    out = []
    for place, text in texts:
        for column, value in {v for v in values if v[1] is not None and v[1].strip()}:
            starts = [i + 1 for i in range(len(text or "")) if text.startswith(value, i)]
            if starts:
                out.append((place, column, value, starts[0], len(starts)))
    return sorted(out)


def found(spark, values, texts):
    v = spark.createDataFrame(values, "column string, value string")
    t = spark.createDataFrame(texts, "place bigint, text string")
    got = leaks.leaks_anywhere(v, t)
    return got, sorted((r[0], r.column, r.value, r.start, r.n) for r in got.collect())


@pytest.mark.parametrize("piece", [512, 9])
def test_like_plain_search(spark, monkeypatch, piece):
    """Short and long values, overlapping places, borders of pieces, characters outside the basic plane."""
    monkeypatch.setattr(leaks, "PIECE", piece)
    r = random.Random(piece)
    word = lambda n: "".join(r.choices("ab😀é1", k=n))
    values = [(r.choice("cd"), word(r.choice([1, 2, 5, 7, 8, 9, 12, 30]))) for _ in range(60)]
    values += [("c", None), ("c", ""), ("d", "  "), ("c", "aaaaaaaaaa"), ("d", "aaaaaaaaaa"), ("c", "a\nb")] + values[:3]
    texts = [(i, "".join(r.choice([word(r.randrange(1, 40)), r.choice(values)[1] or "\n"]) for _ in range(r.randrange(8)))) for i in range(80)]
    texts += [(100, None), (101, ""), (102, "a" * 40), (103, "x" * 600 + values[0][1]), (104, "a\nb")]
    assert found(spark, values, texts)[1] == plain(values, texts)


def test_no_pairs_of_all(spark):
    """Values that share their beginning, and texts that hold it, meet only where the rare part is."""
    values = [("c", f"customer-number-{i:06d}") for i in range(3000)]
    texts = [(i, f"see customer-number-{i:06d} or customer-number-x") for i in range(2000, 4000)]
    got, rows = found(spark, values, texts)
    assert [r[2] for r in rows] == [f"customer-number-{i:06d}" for i in range(2000, 3000)]
    assert "Cartesian" not in got._jdf.queryExecution().toString()
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    anchors = leaks._anchors(spark.createDataFrame(values, "column string, value string"))
    assert anchors.groupBy("gram").count().agg(F.max("count")).first()[0] <= 30


def test_long_text_and_empty_tables(spark):
    long = "lorem ipsum " * 200_000
    values = [("c", "needle-in-it"), ("c", "not there at all")]
    assert found(spark, values, [(1, long + "needle-in-it" + long)])[1] == [(1, "c", "needle-in-it", len(long) + 1, 1)]
    assert found(spark, [], [(1, "x")])[1] == [] and found(spark, values, [])[1] == []


def test_report(spark):
    df = spark.createDataFrame([(1, "11122233344", "x"), (2, "55566677788", "re 11122233344!")], "id int, cpf string, note string")
    hits = leaks.leaks_anywhere(leaks.raw_values(df, ["cpf"]), leaks.output_texts(df, "id", ["note"], "t"))
    assert [tuple(r) for r in leaks.tables_with_leaks(hits).collect()] == [("t", "note", "cpf", 1, 1)]


def test_long_values_are_verified_whole(spark, monkeypatch):
    """Values longer than a window, complete, broken off, and cut by a border of pieces."""
    monkeypatch.setattr(leaks, "PIECE", 64)
    monkeypatch.setattr(leaks, "REACH", 16)
    r = random.Random(3)
    long = ["".join(r.choices("abcdefé😀", k=n)) for n in (16, 17, 40, 90, 300)]
    texts = [(i, "".join(r.choice([v, v[:-1], v[1:], "#" * r.randrange(9)]) for v in r.choices(long, k=6))) for i in range(60)]
    values = [("c", v) for v in long] + [("d", "abc")]
    assert found(spark, values, texts)[1] == plain(values, texts)


def test_shuffled_places_grow_with_findings(spark):
    """Only places that a value's gram leads to leave the pass over the texts; the bitmap stays bounded."""
    values = spark.createDataFrame([("c", f"customer-number-{i:06d}") for i in range(2000)], "column string, value string")
    r = random.Random(5)
    texts = [(i, "".join(r.choices("abcdefgh -0123", k=3000)) + "customer-number-000007") for i in range(40)]
    given = spark.createDataFrame(texts, "place bigint, text string")
    met = leaks._met(leaks._pieces(given, 22), [8], 22, *leaks._bitmap(leaks._anchors(values)))
    assert 40 <= met.count() < 40 + 0.01 * 40 * 3000
