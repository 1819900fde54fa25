"""Personal data: base spans against Python's patterns, learned spans, redaction."""

import hashlib
import random
import re

import pytest
import regex
from collections import defaultdict
from pyspark.sql import functions as F

from veladura.llm import pii
from veladura.llm.queries import QUERIES

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    found = [
        (m.start(), place, m.end(), kind)
        for place, (kind, pattern) in enumerate(BASE.items())
        for m in re.finditer(pattern, text or "")
        if holds(kind, m.group())
    ]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def base_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = pii.find_personal_data(df).orderBy("doc_id").collect()
    return [[(s.kind, s.start, s.end) for s in r.base] for r in rows]


PARTS = [
    "a@b.cd", "a@b", "_x@e.f", "@", ".", "..", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.08.9.255",
    "4785380592391139", "4785 3805 9239 1139", "4785-3805-92391139", "1234", "+1 (743) 555-3824", "+1", "+",
    "+49 30 1234567", " ", "\n", "é", "😀", "-", "(", "x", "%", "+12345678901234567", "00000000000000", "1" * 40,
]


def test_base_spans_match_python(spark):
    chance = random.Random(7)
    texts = ["".join(chance.choices(PARTS, k=chance.randint(0, 14))) for _ in range(1500)]
    texts += [None, "", "a@" + "b." * 20_000, "1 " * 60_000, "a" * 150_000, "+1" + "." * 100_000]
    assert base_of(spark, texts) == [brute(t) for t in texts]


def test_context_finds_unseen_identifiers(spark):
    seeds = [f"please reach me at user{i}@mail.example.org or call" for i in range(30)]
    texts = [*seeds, "please reach me at AB-778812345 or call", "a total of 778 99812345 bricks"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    assert [(s.kind, texts[30][s.start : s.end]) for s in spans[30]] == [("email", "AB-778812345")]
    assert spans[31] == []
    assert all(len(spans[i]) == 1 for i in range(30))


FORMS = [
    "DE89 3704 0044 0532 0130 00", "030 1234 5678", "1234 5678 9012 3456", "(555) 123-4567",
    "jo at mail dot org", "A1B2C3", "AB-778812345",
]


def test_context_finds_identifiers_of_any_form(spark):
    seeds = [f"please reach me at user{i}@mail.example.org or call" for i in range(120)]
    far = "x " * 700
    held = [f"please reach me at {v} or call" for v in FORMS]
    long = [f"{far}please reach me at {v} or call {far}" for v in FORMS]
    plain = ["a total of 030 1234 5678 bricks", "call jo at mail dot org", "", None]
    texts = [*seeds, *held, *long, *plain]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    for k, v in enumerate(FORMS * 2, len(seeds)):
        assert [(s.kind, texts[k][s.start : s.end]) for s in spans[k]] == [("email", v)], v
    assert all(spans[i] == [] for i in range(len(texts) - len(plain), len(texts)))
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert all(out[len(seeds) + k] == "please reach me at [EMAIL] or call" for k in range(len(FORMS)))


def test_a_pattern_that_holds_ordinary_words_is_not_trusted_with_them(spark):
    texts = [f"please reach me at user{i}@mail.example.org or call" for i in range(30)]
    texts += [f"please reach me at {w} or call" for w in "noon home work once lunch dusk dawn two ten six".split()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    assert all(len(spans[i]) == (i < 30) for i in range(len(texts)))


def test_redaction_keeps_rows_and_columns(spark):
    texts = ["mail a@b.cd now", None, "", "ip 1.2.3.4, 1.2.3.4", "mail a@b.cd now", "nothing"]
    df = spark.createDataFrame(
        [(1 if t == texts[0] else i, t, "k", len(t or "")) for i, t in enumerate(texts)],
        "doc_id bigint, text string, kind string, n_chars bigint",
    )
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted(("-" if r.text is None else r.text, r.kind) for r in out.collect()) == sorted(
        (t, "k") for t in ("mail [EMAIL] now", "-", "", "ip [IP], [IP]", "mail [EMAIL] now", "nothing")
    )
    assert out.filter("n_chars <> length(text)").isEmpty()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.find_personal_data(df).isEmpty() and pii.redact(df).isEmpty()


def test_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a@b.cd")], "doc_id bigint, text string")
    for made in (pii.find_personal_data(df), pii.redact(df)):
        plan = made._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_query_against_brute_force(spark, sf_dir):
    texts = {
        r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    }
    rows = QUERIES["op7_pii"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [
            sum(k == kind for k, _, _ in want) for kind in BASE
        ]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


# learned spans, by a plain version of the whole method


def score(edges, rounds=3):
    of, n_seeds = defaultdict(set), defaultdict(int)
    for pattern, value, kind in edges:
        of[pattern].add(value)
        n_seeds[pattern] += kind is not None
    links = [e for e in edges if n_seeds[e[0]] >= 3]
    trust, believed = {}, {}
    for _ in range(rounds):
        sums = defaultdict(float)
        for pattern, value, kind in links:
            if kind is not None:
                sums[pattern, kind] += 1
            elif re.search("[0-9]", value):
                for (v, k), b in believed.items():
                    if v == value:
                        sums[pattern, k] += b
        trust = {(p, k): s / (len(of[p]) + 1) for (p, k), s in sums.items()}
        doubt = defaultdict(lambda: 1.0)
        for pattern, value, kind in links:
            for (p, k), t in trust.items():
                if kind is None and p == pattern:
                    doubt[value, k] *= 1 - min(t, 0.999999)
        believed = {vk: 1 - d for vk, d in doubt.items()}
    best = {}
    for (v, k), b in believed.items():
        best[v] = max(best.get(v, (0, "")), (b, k))
    return {(v, k) for v, (b, k) in best.items() if b >= 0.9}, {pk for pk, t in trust.items() if t >= 0.8}


def contexts(text, start, end):
    left, right = text[max(0, start - 60) : start].lower(), text[end : end + 60].lower()
    two = regex.search(r"(\p{L}+)[^\p{L}]+(\p{L}+)[^\p{L}]*$", left)
    one = regex.search(r"(\p{L}+)[^\p{L}]*$", left)
    after = regex.search(r"^[^\p{L}]*(\p{L}+)", right)
    return ([f"before:{two[1]} {one[1]}"] if two else []) + ([f"around:{one[1]} {after[1]}"] if one and after else [])


def standing(text, patterns):
    words = list(regex.finditer(r"\p{L}+", text))
    edge = r"[\s,;:.!?\"']"
    for i, w in enumerate(words):
        seen = set()
        for k in range(1, 8):
            if i + k < len(words):
                pattern = f"around:{w[0].lower()} {words[i + k][0].lower()}"
                raw = text[w.end() : words[i + k].start()]
                value = re.sub(f"^{edge}+|{edge}+$", "", raw)
                if pattern in patterns - seen and regex.search(r"[\p{L}\p{N}]", value) and len(value) <= 60:
                    seen.add(pattern)
                    at = w.end() + len(re.match(f"{edge}*", raw)[0])
                    yield pattern, at, at + len(value), value
        if i and f"before:{words[i - 1][0].lower()} {w[0].lower()}" in patterns:
            m = regex.search(
                r"^[^\p{L}\p{N}(\[+]*((?:[(\[+]*[\p{L}\p{N}]\S*)(?:\s[(\[+]*[0-9]\S*)*)", text[w.end() : w.end() + 120]
            )
            if m:
                value = re.sub(f"^{edge}+|{edge}+$", "", m[1])
                at = w.end() + m.start(1)
                if len(value) <= 60:
                    yield f"before:{words[i - 1][0].lower()} {w[0].lower()}", at, at + len(value), value


def learned(texts):
    uses = set()
    for d, text in enumerate(texts):
        base = brute(text)
        tokens = [
            (m.start(), m.end())
            for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z]{0,8}[-:#/_]?[0-9][A-Za-z0-9./:_-]{3,}+", text)
            if len(re.sub("[^0-9]", "", m[0])) >= 5 and not any(s < m.end() and m.start() < e for _, s, e in base)
        ]
        for kind, s, e in base + [(None, *t) for t in tokens]:
            uses |= {(d, s, e, kind, text[s:e], p) for p in contexts(text, s, e)}
    edges = {(p, v, k) for _, _, _, k, v, p in uses}
    accepted, trusted = score(edges)
    take = lambda uses, accepted, trusted: {
        (d, s, e, k) for d, s, e, v, p in uses for v2, k in accepted if v2 == v and (p, k) in trusted
    }
    found = take({(d, s, e, v, p) for d, s, e, k, v, p in uses if k is None}, accepted, trusted)
    patterns = {p for p, _ in trusted}
    held = {}
    for d, text in enumerate(texts):
        for p, s, e, v in standing(text, patterns):
            if (d, p, e) not in held or s < held[d, p, e][0]:
                held[d, p, e] = (s, v)
        for (d2, p, e), (s, _) in list(held.items()):
            if d2 == d and any(a < e and s < b for _, a, b in brute(text)):
                del held[d2, p, e]
    edges = {x for x in edges if x[2] is not None and x[0] in patterns} | {(p, v, None) for (_, p, _), (_, v) in held.items()}
    found |= take({(d, s, e, v, p) for (d, p, e), (s, v) in held.items()}, *score(edges))
    return {
        x for x in found
        if not any(y[0] == x[0] and y[1] <= x[1] and x[2] <= y[2] and y[2] - y[1] > x[2] - x[1] for y in found)
    }


def test_learned_spans_against_a_plain_version(spark, monkeypatch):
    """Trusted, doubtful and unknown surroundings, several in a text, over part borders, in blocks of patterns."""
    chance = random.Random(11)
    number = lambda: " ".join(str(chance.randrange(10, 99)) for _ in range(4))
    value = {
        "mail": lambda: f"u{chance.randrange(999)}@m{chance.randrange(9)}.org", "pairs": number,
        "code": lambda: f"AB-{chance.randrange(10**8, 10**9)}", "word": lambda: chance.choice(["noon", "home", "two cats"]),
        "ip": lambda: ".".join(str(chance.randrange(256)) for _ in range(4)),
    }
    frames = [("please reach me at ", " or call", ["mail"] * 6 + ["pairs", "code"]), ("write to ", ", then wait", ["mail", "word"]),
              ("the host (", ") is up", ["ip"] * 5 + ["pairs"]), ("It costs ", " only", ["pairs", "code", "word"])]

    def sentence():
        a, b, kinds = chance.choice(frames)
        return a + value[chance.choice(kinds)]() + b

    texts = [". ".join(sentence() for _ in range(chance.randrange(1, 5))) for _ in range(150)]
    texts += [("x " * chance.randrange(420, 560)) + sentence() + " y" * 600 for _ in range(60)]
    texts += texts[:20]
    want = learned(texts)
    assert len(want) > 20 and any(re.fullmatch(r"\d\d( \d\d){3}", texts[d][s:e]) for d, s, e, _ in want)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for at_once in (20_000, 1):
        monkeypatch.setattr(pii, "PATTERNS_AT_ONCE", at_once)
        rows = pii.find_personal_data(df).select(
            "doc_id", F.explode(F.filter("spans", lambda s: ~F.array_contains("base", s))).alias("s")
        )
        assert {(r.doc_id, r.s.start, r.s.end, r.s.kind) for r in rows.collect()} == want


def test_long_texts_under_a_trusted_pattern(spark):
    """A text of a million words that holds its words everywhere costs no more than its length."""
    texts = [f"please reach me at user{i}@mail.example.org or call" for i in range(30)]
    texts += ["at noon or once " * 60_000 + "please reach me at 11 22 33 44 or call"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert pii.find_personal_data(df).count() == len(texts)
