"""Removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from veladura.llm import suffix_dedup as sd
from veladura.llm.queries import QUERIES


def slow(texts, length=sd.LENGTH):
    datas = [(t or "").encode() for t in texts]
    held = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        covered = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if held[d[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(d, covered) if not c)
        n_spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out.append((len(d), sum(covered), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return [
        (
            r.doc_id,
            (
                r.n_bytes,
                sum(s.end - s.start for s in r.spans),
                len(r.spans),
                hashlib.sha256(bytes(r.kept)).hexdigest(),
            ),
        )
        for r in df.collect()
    ]


def made_texts(seed):
    chance = random.Random(seed)

    def prose(n):
        return "".join(chance.choices("abcdefgh éü😀\n", k=n))

    shared = [prose(n) for n in (380, 399, 400, 401, 700, 1500)]
    texts = [None, "", "short", "x" * 399, "y" * 401, "ab" * 700, prose(398) + "é" * 3]
    for _ in range(40):
        parts = [prose(chance.randint(0, 600))]
        for _ in range(chance.randint(0, 3)):
            piece = chance.choice(shared)
            if chance.random() < 0.3:
                at = chance.randrange(len(piece))
                piece = piece[:at] + "#" + piece[at + 1 :]
            if chance.random() < 0.3:
                piece = piece[chance.randint(0, 200) :]
            parts += [piece, prose(chance.randint(0, 300))]
        texts.append("".join(parts))
    return texts + texts[-4:] + [texts[-1]] * 5


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = made_texts(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert dict(rows_of(sd.remove_repeats(df))) == dict(enumerate(slow(texts)))


def test_blocks_agree_with_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK", 256)
    texts = made_texts(3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert dict(rows_of(sd.remove_repeats(df))) == dict(enumerate(slow(texts)))


def test_repeated_rows_null_ids_and_other_columns(spark):
    chance = random.Random(5)
    a, b = ("".join(chance.choices("abcdefgh ", k=900)) for _ in range(2))
    given = [(1, a, "x"), (1, a, "x"), (None, b, "y"), (None, b[:450], "y"), (2, b[100:300], "z")]
    df = spark.createDataFrame(given, "doc_id bigint, text string, k1 string")
    got = rows_of(sd.remove_repeats(df))
    assert Counter(got) == Counter(zip([g[0] for g in given], slow([g[1] for g in given])))
    assert sd.remove_repeats(df.limit(0)).isEmpty()


def test_query_against_brute_force(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in given], slow([r.text for r in given])))
    got = {
        r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
        for r in QUERIES["op1_suffix_dedup"](spark, sf_dir).collect()
    }
    assert got == want and sum(r[1] for r in want.values()) > 0
