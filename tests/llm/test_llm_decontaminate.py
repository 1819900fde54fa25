"""Decontamination against plain edit distances."""

import random

from veladura.llm import decontaminate as dc
from veladura.llm.queries import QUERIES


def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(text, n, chance):
    for _ in range(n):
        i = chance.randrange(len(text))
        text = text[:i] + chance.choice(["", "q", "qz"[:1] + text[i]]) + text[i + 1 :]
    return text


def test_bit_parallel_distance():
    chance = random.Random(3)
    for _ in range(500):
        p = "".join(chance.choices("abc ", k=chance.randint(1, 80)))
        t = "".join(chance.choices("abc ", k=chance.randint(0, 120)))
        assert dc.best_distance(dc.letter_masks(p), len(p), t)[0] == slow_distance(p, t)


def test_every_item_within_budget_is_found():
    chance = random.Random(4)
    words = ["ba", "do", "mi", "kelu", "ran", "tesso", "vi"]
    items = [(i, " ".join(chance.choices(words, k=chance.randint(3, 25)))) for i in range(30)]
    matcher = dc.ItemMatcher(items, dc.ERRORS)
    for _ in range(300):
        number, item = chance.choice(items)
        text = " ".join(chance.choices(words, k=30))
        text = f"{text} {edited(item, chance.randint(0, len(item) // 9), chance)} {text}"
        clean = dc.normal(text)
        want = {
            i: d
            for i, x in items
            if (d := slow_distance(x, clean)) <= int(len(x) * dc.ERRORS)
            and (len(x) * dc.ERRORS >= 1 or f" {x} " in f" {clean} ")
        }
        assert {i: d for i, d, _, _ in matcher.search(text)} == want


def test_short_items_are_words_of_their_own():
    matcher = dc.ItemMatcher([(1, "art"), (2, "a"), (3, "Yes, 42"), (4, "the art of war")], dc.ERRORS)
    held = lambda text: [i for i, _, _, _ in matcher.search(text)]
    assert held("we went to the party") == [] and held("start") == [] and held("arts") == []
    assert held("yes 421") == [] and held("yesyes 42") == []
    assert held("Art.") == [1] and held("the party: art, a") == [1, 2] and held("he said: yes! 42") == [3]
    assert held("party art") == [1] and held("the art af war") == [1, 4]


def test_case_punctuation_and_odd_rows(spark):
    item = "Whoever reads this line, has seen the test before it was given."
    docs = spark.createDataFrame(
        [
            (1, "x\n" + item.upper().replace(" ", "\n  ") + " y", "a"),
            (1, "x\n" + item.upper().replace(" ", "\n  ") + " y", "a"),
            (2, None, "b"),
            (3, "", "c"),
            (None, item.replace("seen", "sen"), "d"),
            (5, "w " * 50_000 + item, "e"),
            (6, "Whoever reads that", "f"),
        ],
        "doc_id bigint, text string, item_id string",
    )
    bench = spark.createDataFrame(
        [(1, item), (2, item), (3, None), (4, ""), (5, "?!")], "item_id bigint, text string"
    )
    rows = dc.contaminated(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id, r.distance) for r in rows) == sorted(
        (d, i, e) for d, e in (("1", 0), ("1", 0), ("5", 0), ("None", 1)) for i in (1, 2)
    )
    for block in (dc.BLOCK_CHARS, 10):
        left = dc.drop_contaminated(docs, bench, block_chars=block)
        assert left.columns == docs.columns
        assert sorted(r.item_id for r in left.collect()) == ["b", "c", "f"]
    few = dc.contaminated(docs, bench, block_chars=10).collect()  # several blocks, the same rows
    assert sorted(map(str, few)) == sorted(map(str, rows))
    blocks = list(dc.item_blocks(bench.unionByName(bench), 10))
    assert sum(len(items) for _, items in blocks) == 2 and all(several for several, _ in blocks)
    none = bench.limit(0)
    assert dc.contaminated(docs, none).isEmpty() and dc.drop_contaminated(docs, none).count() == 7
    assert dc.contaminated(docs.limit(0), bench).isEmpty()


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    held = {
        (d.doc_id, i.item_id) for d in docs for i in items if dc.normal(i.text) in dc.normal(d.text)
    }
    rows = QUERIES["op3_decontaminate"](spark, sf_dir).collect()
    assert held <= {(r.doc_id, r.item_id) for r in rows}
    texts, asked = {d.doc_id: d.text for d in docs}, {i.item_id: i.text for i in items}
    for r in rows:
        assert slow_distance(dc.normal(asked[r.item_id]), dc.normal(texts[r.doc_id])) == r.distance
