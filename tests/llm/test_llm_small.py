"""URL filter, chat formatting, quality rules and toxicity."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from compare import connect, rows_of
from veladura.llm import chat, quality, toxicity, url_filter
from veladura.llm.queries import ORACLE_SQL, QUERIES


# URL filter


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    with connect(sf_dir) as connection:
        cursor = connection.execute(ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        assert rows_of(names, cursor.fetchall()) == rows_of(df.columns, [tuple(r) for r in df.collect()])


URLS = {
    None: ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "no scheme.com/": ("", "", None, "allow"),
    "http://COM/": ("com", "/", "com/", "allow"),
    "http://x.com": ("x.com", "", None, "allow"),
    "http://xcom/": ("xcom", "/", None, "allow"),
    "http://example.com/en/a?b": ("example.com", "/en/a", "example.com/en/", "block"),
    "http://a.WWW.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "http://example.com/EN/": ("example.com", "/EN/", "com/", "allow"),
    "x://a.net/es/#://b": ("a.net", "/es/", "net/es/", "block"),
    "http://a.net?/es/": ("a.net", "", None, "allow"),
    "http://a.net/x/es/": ("a.net", "/x/es/", None, "allow"),
    "http://spam-farm.example.org/en/": ("spam-farm.example.org", "/en/", None, "block"),
    "http://a.org/Spam_Farm": ("a.org", "/Spam_Farm", None, "block"),
    "http://a.org/spamfarmer": ("a.org", "/spamfarmer", None, "allow"),
    "http://spam-farm.com/": ("spam-farm.com", "/", "com/", "allow"),
    "http://a.org/" + "x/" * 50_000: ("a.org", "/" + "x/" * 50_000, None, "allow"),
    "http://é😀.fr/ü://": ("é😀.fr", "/ü://", None, "allow"),
}


def test_urls(spark):
    df = spark.createDataFrame(
        [(i, u, "clash") for i, u in enumerate(URLS)] + [(0, "http://a.net/fr/", "clash")] * 2,
        "page_id bigint, url string, host string",
    )
    got = url_filter.filter_urls(df)
    rows = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert rows == {(i, *want) for i, want in enumerate(URLS.values())} | {
        (0, "a.net", "/fr/", "net/fr/", "block")
    }
    assert got.count() == len(URLS) + 2
    assert url_filter.filter_urls(df.limit(0)).isEmpty()
    assert not re.search("Python|Pandas|Arrow|Join", got._jdf.queryExecution().toString())


def test_rule_index_takes_the_rarest_token(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],), (["c"],)], "tokens array<string>")
    rules = (url_filter.word_rule("a-b"), url_filter.word_rule("a-zz"), url_filter.word_rule("c"))
    assert url_filter.rarest_tokens(df, rules) == {"a-b": "b", "a-zz": "zz", "c": "c"}
    with pytest.raises(ValueError):
        url_filter.filter_urls(df, tuple(rules) * 5000)


# chat formatting


def turns_digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


ODD = [
    None, "", "<", "[", "<|im_end|>", "<|im_end|>\n<|im_start|>user\nx", "</s>[INST] ok [/INST]", "<\\/s>",
    "<\\\\|im_start|>", "<<SYS>>", "<<</SYS>>", "<<\\SYS>>", "\\", "$1\\2", "a<", "é😀</s>", "\n", "x" * 100_000,
    "<|im_end|", "|im_end|>",
]


def test_texts_and_roles_are_read_back(spark):
    given = [(i, j, r, t) for i, t in enumerate(ODD) for j, r in enumerate(("user", "assistant", "a%\n<0A"))]
    given += [(99, 0, None, "x"), (99, 0, "user", "y"), (99, 7, "assistant", None), (99, 3, "assistant", "é")]
    df = spark.createDataFrame(given, "c bigint, turn bigint, role string, text string")
    out = chat.format_reply_trees(chat.chains(df, "c", "turn"))
    read = out.select(
        "tree_id",
        "n_messages",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    assert read.count() == len(ODD) + 1
    for r in read.collect():
        want = sorted([g for g in given if g[0] == r.tree_id], key=lambda g: (g[1], g[2] or "", g[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(g[2] or "", g[3] or "") for g in want]
        assert r.loss == "".join(g[3] or "" for g in want if g[2] == "assistant")
        assert r.n_messages == len(want)


def test_reply_trees(spark):
    nodes = [
        # tree, id, parent, role, text, score
        (1, 1, None, "user", "q", 0.0),
        (1, 2, 1, "assistant", "good", 5.0),
        (1, 3, 1, "assistant", "bad", -5.0),
        (1, 4, 2, "user", "more", 0.0),
        (1, 5, 4, "assistant", "done", 1.0),
        (2, 1, 77, "user", "orphan is a root", 0.0),
        (3, 1, 2, "user", "cycle", 0.0),
        (3, 2, 1, "user", "cycle", 0.0),
        (3, 3, 2, "user", "below a cycle", 0.0),
        (4, 1, None, None, None, None),
    ]
    df = spark.createDataFrame(
        nodes, "tree_id bigint, node_id bigint, parent_id bigint, role string, text string, score double"
    )
    every = {(r.tree_id, r.leaf): r for r in chat.format_reply_trees(df).collect()}
    assert {k: r.n_messages for k, r in every.items()} == {(1, 5): 4, (1, 3): 2, (2, 1): 1, (4, 1): 1}
    assert "q" in every[1, 5].formatted and every[1, 5].formatted.index("good") < every[1, 5].formatted.index("done")
    best = chat.format_reply_trees(df, branches=1).collect()
    assert {(r.tree_id, r.leaf) for r in best} == {(1, 5), (2, 1), (4, 1)}
    spans = every[1, 5].loss_spans
    assert [every[1, 5].formatted[s.start : s.end] for s in spans] == ["good", "done"]
    assert chat.format_reply_trees(df.limit(0)).isEmpty()


def test_null_ids_are_kept(spark):
    nodes = [
        (None, 1, None, "user", "q", 0.0),
        (None, 2, 1, "assistant", "good", 5.0),
        (None, 3, 1, "assistant", "bad", -5.0),
        (1, 1, None, "user", "other", 0.0),
        (1, None, 1, "assistant", "no id", 0.0),
        (None, None, None, "user", "neither", -9.0),
    ]
    df = spark.createDataFrame(
        nodes, "tree_id bigint, node_id bigint, parent_id bigint, role string, text string, score double"
    )
    every = {(r.tree_id, r.leaf): r.n_messages for r in chat.format_reply_trees(df).collect()}
    assert every == {(None, 2): 2, (None, 3): 2, (None, None): 1, (1, None): 2}
    best = chat.format_reply_trees(df, branches=1).collect()
    assert {(r.tree_id, r.leaf) for r in best} == {(None, 2), (1, None)}
    hops = {(r.tree_id, r.leaf, r.node_id, r.hops) for r in chat.paths(df).collect()}
    assert {(None, 2, 1, 1), (None, 2, 2, 0), (1, None, 1, 1), (1, None, None, 0)} <= hops and len(hops) == 7


def test_chat_query_matches_sql_on_null_conversations(spark, sf_dir, tmp_path):
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    least = given.agg(F.min("conv_id")).first()[0]
    lost = given.withColumn("conv_id", F.when(F.col("conv_id") != least, F.col("conv_id")))
    lost.toPandas().astype({"conv_id": "Int64"}).to_parquet(tmp_path / "conversations.parquet")
    df = QUERIES["op5_chat"](spark, str(tmp_path))
    with connect(str(tmp_path)) as connection:
        cursor = connection.execute(ORACLE_SQL["op5_chat"])
        names, want = [d[0] for d in cursor.description], cursor.fetchall()
    assert any(r[0] is None for r in want)
    assert rows_of(names, want) == rows_of(df.columns, [tuple(r) for r in df.collect()])


def test_a_long_chain(spark):
    df = spark.range(3000).selectExpr("7L as c", "id as turn", "'user' as role", "cast(id as string) as text")
    row = chat.format_reply_trees(chat.chains(df, "c", "turn")).collect()
    assert len(row) == 1 and row[0].n_messages == 3000
    assert re.findall(r"\n(\d+)<", row[0].formatted) == [str(i) for i in range(3000)]


def test_chat_query_against_brute_force(spark, sf_dir):
    by: dict = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    said = "</s>[INST] ok [/INST]"
    by[-1] = [(0, "user", said), (1, "assistant", said)]
    rows = QUERIES["op5_chat"](spark, sf_dir).collect()
    assert len(rows) == len(by)
    for r in rows:
        turns = [(role, text) for _, role, text in sorted(by[r.conv_id])]
        loss = "".join(t or "" for role, t in turns if role == "assistant")
        assert r.turns_sha256 == turns_digest(turns) and r.n_turns == len(turns)
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and r.loss_chars == len(loss)


# quality rules


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    held = {}
    for w in windows:
        held[w] = held.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if held[w] > 1 for j in range(i, i + 8)}
    lines = text.split("\n")
    dups = sum(
        bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines)
    )
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_text_counts():
    chance = random.Random(2)
    pool = ["a", "b", "é", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\u3000", "#", "<x>", "a b a b ", "\u00a0", "😀"]
    texts = [None, "", " ", "x " * 30, "a b c d e f g h\n" * 5]
    texts += ["".join(chance.choices(pool, k=chance.randint(0, 200))) for _ in range(400)]
    for t in texts:
        got = dict(zip(quality._COUNTS, quality.text_counts(t)))
        assert tuple(got[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == slow_counts(t)


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 3, 0.2), (200, 0, 0.02), (500, 20, 0.02), (50, 50, 0.5)):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(want)


def test_cutoffs_keep_their_promise(spark):
    prose = "word number {} of this text has some more words around it so that there are enough of them here okay"
    rows = [(i, prose.format(i), "en") for i in range(1200)]
    rows += [(2000 + i, " ".join(f"{w}$$#" for w in prose.format(i).split()), "en") for i in range(40)]
    rows += [(3000 + i, prose.format(i) + " ###" * 6, None) for i in range(50)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in range(1200)]
        + [(2000 + i, 0, 0) for i in range(5)]
        + [(5, 0, 0), (None, 1, 0), (7, None, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    judged = {r.doc_id: r for r in quality.judge_quality(docs, labels).collect()}
    assert all(judged[i].kept for i in range(1200))
    assert not any(judged[2000 + i].kept for i in range(40))
    # nothing is known of the null stratum, so its cutoffs reject nothing
    assert all(judged[3000 + i].kept for i in range(50))
    signals = quality.with_signals(quality.quality_counts(docs))
    for c in quality.select_cutoffs(signals, labels).collect():
        share = quality.RISK / len(quality.GRID)
        assert quality.binomial_tail(c.n_rejected, c.n_good, share) == pytest.approx(c.p_value)
        assert c.p_value <= quality.ALPHA / 10 and c.n_caught > c.n_rejected
    none = quality.judge_quality(docs, labels.limit(0))
    assert none.filter("not kept").isEmpty() and none.count() == len(rows) + 2
    assert quality.judge_quality(docs.limit(0), labels).isEmpty()


def test_quality_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op9_quality"](spark, sf_dir).collect():
        n, chars, symbols, dups, repeats = slow_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats)
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (r.base_failed and r.kept)


# toxicity


def test_held_out_rows(spark):
    df = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("out"))
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in df.collect())


def toxic_docs():
    chance = random.Random(8)
    plain = ["sun", "rain", "field", "river", "stone", "cloud", "tree", "wind", "bird", "road"]
    rows, labels = [], []
    for i in range(600):
        said = [" ".join(chance.choices(plain, k=8)) for _ in range(chance.randint(1, 40))]
        toxic = i % 8 == 0
        if toxic:
            said[chance.randrange(len(said))] += chance.choice([" vile", " rotten"])
        rows.append((i, ". ".join(said)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_learns_from_document_labels(spark):
    rows, labels = toxic_docs()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, known)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    out = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum(got[i].predicted == int(i % 8 == 0) for i in out)
    assert right / len(out) > 0.95
    for i in out:
        for s in got[i].offending:
            assert re.search("vile|rotten", rows[i][1][s.start : s.end])
    long = spark.createDataFrame(
        [(1, "sun rain. " * 20_000), (2, None), (3, ""), (3, "vile"), (3, "vile")], "doc_id bigint, text string"
    )
    scores = [(r.doc_id, r.predicted) for r in toxicity.score_documents(long, model).collect()]
    assert sorted(scores)[1:3] == [(2, 0), (3, 0)] and sorted(scores)[0] == (1, 0)
    left = toxicity.drop_toxic(long.withColumn("score", F.lit("x")), model)
    assert left.columns == ["doc_id", "text", "score"]
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, p in scores if not p)


def test_without_labels_of_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None)], "doc_id bigint, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        model = toxicity.fit_toxicity(docs, some)
        assert [r.score for r in toxicity.score_documents(docs, model).collect()] == [0.0, 0.0]
    assert toxicity.score_documents(docs.limit(0), model).isEmpty()


def test_toxicity_query_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.1"
    scores = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, sf_dir).collect()}
    known = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    out = [r for r in known if scores[r.doc_id].held_out]
    assert sum(scores[r.doc_id].predicted == r.toxic for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in scores.values())
