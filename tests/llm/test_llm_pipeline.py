"""The pipeline: every stage on odd rows, and the whole against its parts by brute force."""

import hashlib
import struct

import corpus_pipeline
from test_llm_pii import brute
from test_llm_simhash import slow_components, slow_fingerprint
from veladura.llm import decontaminate, pii, toxicity
from veladura.llm.common import cut, table
from veladura.llm.queries import vocabulary

ODD = [
    (1, None, "en", "a", 0),
    (2, "", None, "a", 0),
    (None, "a text without an id that is long enough", "en", None, None),
    (3, "mail me at a@b.cd please", "fr", "b", 24),
    (3, "mail me at a@b.cd please", "fr", "b", 24),
    (4, "w " * 60_000, "de", "c", 120_000),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, row string"


def test_stages_take_odd_rows_and_keep_columns(spark, sf_dir):
    docs = spark.createDataFrame([(*r, "x", "y") for r in ODD], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and 3 <= out.count() <= len(ODD), name
        assert stage(spark, docs.limit(0), sf_dir).isEmpty(), name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, sf_dir).count() == len(ODD)
    assert last(spark, docs.limit(0), sf_dir).isEmpty()


def test_run_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    score = toxicity.Scorer(model).score
    kept = {r.doc_id: r.text for r in docs.collect() if score(r.text)[0] < 0.5}
    prints = {i: slow_fingerprint(t) for i, t in kept.items()}
    roots = slow_components(set(prints.values()))
    least = {}
    for i, v in prints.items():
        least[roots[v]] = min(i, least.get(roots[v], i))
    kept = {i: t for i, t in kept.items() if least[roots[prints[i]]] == i}
    items = [decontaminate.normal(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    kept = {i: t for i, t in kept.items() if not any(x in decontaminate.normal(t) for x in items)}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(rows) == set(kept)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    library.no_truncation()
    library.no_padding()
    n_redacted = 0
    for i, text in kept.items():
        clean = redacted(text)
        n_redacted += clean != text
        ids = library.encode(clean, add_special_tokens=False).ids
        assert rows[i].input_ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        shown = library.decode(ids, skip_special_tokens=False)
        assert rows[i].decoded_sha256 == hashlib.sha256(shown.encode()).hexdigest()
    assert n_redacted > 3


def redacted(text):
    """The text with its base spans in brackets; the given tables teach no others."""
    out, at = [], 0
    for kind, start, end in brute(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_stages_on_planted_rows(spark, sf_dir, tmp_path):
    """One near item, one group of copies, one text with personal data, one clean text."""
    item = table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    plain = "a quiet afternoon by the river with nothing else to say about it at all " * 3
    texts = [f"before it {item[:40]}{item[41:]} and after", plain, plain, plain.upper(),
             "Another text of its own, which names x@y.org once, and then ends."]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = cut(stage(spark, docs, sf_dir), "planted")
    left = {r.doc_id: r.text for r in docs.collect()}
    assert left == {1: plain, 4: texts[4].replace("x@y.org", "[EMAIL]")}


def test_stage_names_are_the_given_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None
