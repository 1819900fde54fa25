"""BPE against the tokenizers library, and exact round trips."""

import hashlib
import os
import random

import numpy as np
import pytest

from veladura.llm import bpe
from veladura.llm.queries import QUERIES, vocabulary

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def rows_of(df):
    return [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()]


def expected(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    shown = library.decode(ids, skip_special_tokens=False)
    return doc_id, len(ids), digest(ids), hashlib.sha256(shown.encode()).hexdigest()


def shared_texts(seed):
    chance = random.Random(seed)
    words = ["word", "it's", "été", "naïve", "12", "3,5", "😀", "we'll", "\n\n", "  ", "\t", "...", "<|endo", "ftext|>", "中文字"]
    passages = [" ".join(chance.choices(words, k=chance.randint(300, 1500))) for _ in range(5)]
    passages += ["中文" * 900, "x" * 3000, " " * 2500, "\u3000a\u0085 " * 500, "'s" * 1500]
    texts = [None, "", " ", "a", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b"]
    for _ in range(60):
        parts = chance.choices(passages, k=chance.randint(1, 3))
        parts.insert(chance.randint(0, len(parts)), " ".join(chance.choices(words, k=chance.randint(0, 60))))
        texts.append(chance.choice(["", " ", "\n", "'"]).join(parts))
    texts.append(texts[-1] + "<|endoftext|>")
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_documents_match_the_library(spark, library, seed):
    given = list(enumerate(shared_texts(seed))) + [(None, "null id"), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(*g, "x") for g in given], "doc_id bigint, text string, n_tokens string")
    out = bpe.encode_documents(df.repartition(3), vocabulary())
    key = lambda r: tuple(map(str, r))
    assert sorted(rows_of(out), key=key) == sorted((expected(library, *g) for g in given), key=key)
    assert out.agg({"n_reused": "sum"}).first()[0] > 50
    plain = bpe.encode_documents(df, vocabulary(), most=0)
    assert sorted(rows_of(plain), key=key) == sorted(rows_of(out), key=key)


def test_ids_and_other_columns(spark, library):
    df = spark.createDataFrame([(1, "en", "Some text"), (2, None, None)], "doc_id bigint, lang string, text string")
    rows = {r.doc_id: r for r in bpe.encode_documents(df, vocabulary(), with_ids=True).collect()}
    assert rows[1].input_ids == library.encode("Some text", add_special_tokens=False).ids
    assert (rows[1].lang, rows[2].lang, rows[2].input_ids) == ("en", None, [])
    assert bpe.encode_documents(df.limit(0), vocabulary()).isEmpty()


def test_cuts_depend_on_content():
    chance = random.Random(3)
    passage = "".join(chance.choices("abcdefgh é", k=20_000)).encode()
    a, b = (set(bpe.cuts(x + passage)) for x in (b"", b"other words before it " * 9))
    moved = {x + 22 * 9 for x in a}
    assert len(moved & b) > 0.7 * len(moved)
    for data in (b"", b"x", passage, b"\x00" * 5000):
        borders = bpe.cuts(data)
        assert borders[0] == 0 and borders[-1] == len(data) and borders == sorted(borders)


def test_query_matches_the_library(spark, library, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {expected(library, r.doc_id, r.text) for r in given}
    assert set(rows_of(QUERIES["op4_bpe"](spark, sf_dir))) == want
