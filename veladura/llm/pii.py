"""Personal data by bootstrapped contextual extraction.

Base patterns (e-mail, IP address, card, phone) find seeds.  The words around the seeds
are lexical patterns; the same patterns also surround other identifiers, tokens with
several digits that no base pattern takes.  Patterns and identifiers form a graph, which
Spark scores in rounds: a pattern is as trustworthy as the share of its instances that
are known or believed, an identifier as the noisy-or of its patterns.  Identifiers that
reach ``ACCEPT`` in patterns that reach ``TRUST`` are added, with the kind of their
patterns; the base spans stay as they are.

Those tokens only decide which patterns to trust.  Where a pattern is trusted, the texts
are read again and whatever stands in it is a candidate, digits or not: between the two
words of a pattern with both sides (``WITHIN`` words and ``_CONTEXT`` characters at most,
the nearest right word), or after a pattern's two words, a token and the groups of digits
that follow it.  With these the patterns and candidates are scored in rounds as before,
so a pattern that holds ordinary words as well loses its trust.  Of spans found one inside the
other the outer one stays.  Without a trusted pattern the texts are not read again.  The
second reading is one projection: ``PATTERNS_AT_ONCE`` patterns travel in it as a set, more of
them take one reading each, and only parts of texts that hold a left word are looked at.

Everything is DataFrame functions.  One projection over the texts finds matches with
their places (places follow from the lengths of what stands between matches) and keeps
small arrays; the graph has one edge per distinct pattern and identifier, however often
they occur.  Base patterns are written with possessive repeats, which match the same
and neither go back nor recurse, so long texts cost linear time and no stack.

Edge cases: null and empty texts hold nothing; repeated rows give the same spans each
and count once in the graph; documents are told apart by id and text, so null and
repeated ids do no harm; without seeds nothing is learned; an empty table gives an
empty result; other columns are ignored, and kept by ``redact``, which leaves null
texts null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veladura.llm.common import cut

KINDS = ("email", "ip", "card", "phone")

_PATTERNS = {
    # \G: after a match the next may begin inside a run of characters, else only at its start
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth trying.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_TOKEN = r"(?<![A-Za-z0-9])[A-Za-z]{0,8}[-:#/_]?[0-9][A-Za-z0-9./:_-]{3,}+"
_TOKEN_DIGITS = 5

ROUNDS, SEEDS, SMOOTH, TRUST, ACCEPT = 3, 3, 1.0, 0.8, 0.9
_CONTEXT, WITHIN = 60, 6
_STEP = 4000  # texts are read again in parts that overlap
_EDGE = r"[\s,;:.!?\"']"
_AFTER = r"^[^\p{L}\p{N}(\[+]*((?:[(\[+]*[\p{L}\p{N}]\S*)(?:\s[(\[+]*[0-9]\S*)*)"


def _matches(text: Column, pattern: str, needs: str) -> Column:
    """``array<struct<start,end,value>>`` of all leftmost matches; code points, end exclusive."""
    zipped = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), 0),
        F.split(text, pattern, -1),
        lambda value, before: F.struct(value.alias("value"), F.length(before).alias("before")),
    )
    places = F.aggregate(
        F.filter(zipped, lambda m: m["value"].isNotNull()),
        F.struct(
            F.lit(0).alias("at"),
            F.array().cast("array<struct<start:int,end:int,value:string>>").alias("found"),
        ),
        lambda a, m: F.struct(
            (a["at"] + m["before"] + F.length(m["value"])).alias("at"),
            F.concat(
                a["found"],
                F.array(
                    F.struct(
                        (a["at"] + m["before"]).alias("start"),
                        (a["at"] + m["before"] + F.length(m["value"])).alias("end"),
                        m["value"].alias("value"),
                    )
                ),
            ).alias("found"),
        ),
        lambda a: a["found"],
    )
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(needs), places).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    size = F.length(digits)

    def worth(place: Column) -> Column:
        d = digits.substr(size - place, F.lit(1)).cast("int")
        return F.when(place % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), lambda a, i: a + worth(i))
    return F.when(size.between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _kind_spans(text: Column, place: int, kind: str) -> Column:
    matches = _matches(text, _PATTERNS[kind], _NEEDS[kind])
    return F.transform(
        F.filter(matches, lambda m: _valid(kind, m["value"])),
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(place).alias("place"),
            m["end"].alias("end"),
            F.lit(kind).alias("kind"),
            m["value"].alias("value"),
        ),
    )


def base_spans(text: Column) -> Column:
    """``array<struct<start,place,end,kind,value>>`` of the base patterns, by start and kind."""
    of_kind = [_kind_spans(text, i, k) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*of_kind))


def _other_tokens(text: Column, base: Column) -> Column:
    """Identifier-like tokens that no base span touches."""
    tokens = F.filter(
        _matches(text, _TOKEN, "[0-9][A-Za-z0-9./:_-]{3}"),
        lambda m: F.length(_digits(m["value"])) >= _TOKEN_DIGITS,
    )
    return F.filter(
        tokens,
        lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])),
    )


def _contexts(text: Column, start: Column, end: Column) -> Column:
    """The lexical patterns around a span: two words before it; one before and one after."""
    left = F.lower(text.substr(F.greatest(start - _CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(_CONTEXT))))
    right = F.lower(text.substr(end + 1, F.lit(_CONTEXT)))
    two = F.regexp_extract(left, r"(\p{L}+)[^\p{L}]+(\p{L}+)[^\p{L}]*$", 1)
    one = F.regexp_extract(left, r"(\p{L}+)[^\p{L}]*$", 1)
    after = F.regexp_extract(right, r"^[^\p{L}]*(\p{L}+)", 1)
    return F.array(
        F.when((two != "") & (one != ""), F.concat(F.lit("before:"), two, F.lit(" "), one)),
        F.when((one != "") & (after != ""), F.concat(F.lit("around:"), one, F.lit(" "), after)),
    )


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, base, others``, one row per document, in the shared folder."""
    text = F.coalesce("text", F.lit(""))
    first = docs.select("doc_id", text.alias("text"), F.xxhash64("text").alias("text_hash"))
    based = first.withColumn("base", base_spans(F.col("text")))
    with_others = based.withColumn("others", _other_tokens(F.col("text"), F.col("base")))

    def told(kind: bool):
        return lambda m: F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            (m["kind"] if kind else F.lit(None).cast("string")).alias("kind"),
            m["value"].alias("value"),
            _contexts(F.col("text"), m["start"], m["end"]).alias("contexts"),
        )

    return cut(
        with_others.select(
            "doc_id",
            "text_hash",
            F.transform("base", told(True)).alias("base"),
            F.transform("others", told(False)).alias("others"),
        ),
        "pii-spans",
        docs.count(),
        gather=True,
    )


def learn(spans: DataFrame, rounds: int = ROUNDS, docs: DataFrame | None = None) -> DataFrame:
    """``doc_id, text_hash, start, end, kind`` of identifiers found by their context.

    Without ``docs`` these are tokens with several digits only.
    """
    where = spans.select("doc_id", "text_hash", F.explode(F.concat("base", "others")).alias("s"))
    uses = where.select(
        "doc_id", "text_hash", "s.start", "s.end", "s.kind", "s.value",
        F.explode(F.array_compact("s.contexts")).alias("pattern"),
    )
    n_uses = spans.agg(F.sum(2 * (F.size("base") + F.size("others")))).first()[0] or 0
    edges = cut(uses.select("pattern", "value", "kind").distinct(), "pii-edges", n_uses)
    accepted, trusted = _score(edges, rounds, edges.count())
    first = _accepted_uses(uses.filter("kind is null").drop("kind"), accepted, trusted)
    if docs is None or trusted.isEmpty():
        return first
    patterns = trusted.select("pattern").distinct()
    held = _held_by(docs, spans, patterns)
    known = edges.filter("kind is not null").join(patterns, "pattern", "left_semi")
    more = held.select("pattern", "value", F.lit(None).cast("string").alias("kind")).distinct()
    edges = known.select("pattern", "value", "kind").unionByName(more)
    edges = cut(edges, "pii-edges", edges.count())
    found = _accepted_uses(held, *_score(edges, rounds, edges.count()))
    return _outermost(first.unionByName(found))


def _accepted_uses(uses: DataFrame, accepted: DataFrame, trusted: DataFrame) -> DataFrame:
    return (
        uses.join(trusted, "pattern")
        .join(accepted, ["value", "kind"])
        .select("doc_id", "text_hash", "start", "end", "kind")
        .distinct()
    )


def _outermost(found: DataFrame) -> DataFrame:
    """Without the spans that lie within a wider one of the same text, in one pass by start."""
    places = found.groupBy("doc_id", "text_hash", "start", "end").agg(F.collect_set("kind").alias("kinds"))
    earlier = Window.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("end"))
    reach = F.max("end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    outer = places.withColumn("reach", reach).filter("reach is null or reach < end")
    return outer.select("doc_id", "text_hash", "start", "end", F.explode("kinds").alias("kind"))


#: So many trusted patterns are looked for in one reading of the texts.
PATTERNS_AT_ONCE = 20_000


def _held_by(docs: DataFrame, spans: DataFrame, patterns: DataFrame) -> DataFrame:
    """``doc_id, text_hash, pattern, value, start, end``: what stands in trusted patterns and is no base span."""
    patterns = cut(patterns, "pii-trusted")
    blocks = patterns.count() // PATTERNS_AT_ONCE + 1
    block = F.pmod(F.xxhash64("pattern"), F.lit(blocks))
    found = None
    for b in range(blocks):
        some = [r[0] for r in patterns.filter(block == b).collect()]
        if some:
            got = cut(_standing_in(docs, some), "pii-standing")
            found = got if found is None else found.unionByName(got)
    # repeated rows and, of several left words, the farthest
    far = found.groupBy("doc_id", "text_hash", "pattern", "end").agg(
        F.min_by(F.struct("start", "end", "value"), "start").alias("s")
    )
    base = spans.filter(F.size("base") > 0).select(
        F.col("doc_id").alias("of"), F.col("text_hash").alias("of_text"),
        F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))).alias("base"),
    ).dropDuplicates(["of", "of_text"])
    same = F.col("doc_id").eqNullSafe(F.col("of")) & F.col("text_hash").eqNullSafe(F.col("of_text"))
    touched = F.exists("base", lambda b: (b["start"] < F.col("s.end")) & (F.col("s.start") < b["end"]))
    free = far.join(base, same, "left").filter(~F.coalesce(touched, F.lit(False)))
    return cut(free.select("doc_id", "text_hash", "pattern", "s.value", "s.start", "s.end"), "pii-held")


def _any_of(words: list[str]) -> str:
    """A pattern for any of these words of letters, tried letter by letter rather than word by word."""
    after: dict[str, list[str]] = {}
    for w in words:
        after.setdefault(w[:1], []).append(w[1:])
    ends = after.pop("", None)
    options = [c + _any_of(rest) for c, rest in sorted(after.items())]
    if not options:
        return ""
    # the longest first, as a word may begin like another one
    return f"(?:{'|'.join(options)}){'?' if ends else ''}" if ends or len(options) > 1 else options[0]


def _standing_in(docs: DataFrame, patterns: list[str]) -> DataFrame:
    """``doc_id, text_hash, pattern, start, end, value`` of what stands in these patterns.

    One projection over the texts, without exchange or join.  A part of a text goes on only
    if it holds a left word, and a left word only if a right word follows (or, for patterns
    of two words before, always); words are told apart only there.
    """
    pairs = {p: p.split(":", 1)[1].split(" ") for p in patterns}
    around = [p for p in patterns if p.startswith("around:")]
    before = [p for p in patterns if p.startswith("before:")]
    lefts = sorted({pairs[p][0] for p in around} | {pairs[p][1] for p in before})
    rights = sorted({pairs[p][1] for p in around}) or [""]
    letters, others = r"\p{L}", r"[^\p{L}]"
    right_word = f"(?iu:{_any_of(rights)})(?!{letters})"
    follows = f"(?=(?:{others}*+{letters}++){{0,{WITHIN}}}?{others}*+{right_word})"
    left_words = [
        f"(?iu:{_any_of(sorted({pairs[p][side] for p in some}))})(?!{letters}){then}"
        for some, side, then in ((around, 0, follows), (before, 1, ""))
        if some
    ]
    left_word = f"(?<!{letters})(?={'|'.join(left_words)})"  # where one begins
    reach = 4 * _CONTEXT

    text = F.coalesce("text", F.lit(""))
    cut_up = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_STEP}}}"), 0)
    chunks = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), cut_up.alias("cut"))
    chunks = chunks.select("doc_id", "text_hash", "cut", F.posexplode("cut").alias("number", "own"))
    following = F.left(F.coalesce(F.get("cut", F.col("number") + 1), F.lit("")), F.lit(2 * reach))
    parts = chunks.select(
        "doc_id",
        "text_hash",
        (F.col("number") * _STEP).alias("at"),
        # no word begins at the very start, so each piece but the first is cut off before a left word
        F.concat(F.lit("\n"), "own", following).alias("part"),
    )
    # Rows are left out by explode() of empty arrays and not by filter(): the optimizer copies
    # what a condition needs below, so that costly columns would be computed once more.
    ends = F.aggregate(  # where left words end
        F.split("part", left_word, -1),
        F.struct(
            F.lit(-1).alias("at"),
            F.array().cast("array<struct<word:string,left:int>>").alias("found"),
        ),
        lambda a, piece: F.struct(
            (a["at"] + F.length(piece)).alias("at"),
            F.concat(
                a["found"],
                F.array(
                    F.struct(
                        F.regexp_extract(piece, f"^{letters}+", 0).alias("word"),
                        (a["at"] + F.length(F.regexp_extract(piece, f"^{letters}+", 0))).alias("left"),
                    )
                ),
            ).alias("found"),
        ),
        lambda a: F.slice(a["found"], F.lit(2), F.size(a["found"])),
    )
    # a part's first and last words may be cut off: its neighbours hold them whole
    inner = F.filter(
        ends,
        lambda h: ((F.col("at") == 0) | (h["left"] > 2 * _CONTEXT)) & (h["left"] <= 2 * _CONTEXT + _STEP),
    )
    seen = F.transform(
        inner,
        lambda h: F.struct(
            F.lower(h["word"]).alias("word"),
            (F.col("at") + h["left"]).alias("left"),
            F.substr("part", h["left"] + 2, F.lit(reach)).alias("next"),
            F.substr(
                "part",
                F.greatest(h["left"] - F.length(h["word"]) - _CONTEXT, F.lit(0)) + 2,
                F.least(h["left"] - F.length(h["word"]), F.lit(_CONTEXT if before else 0)),
            ).alias("earlier"),
        ),
    )
    seen = F.filter(seen, lambda h: h["word"].isin(lefts))
    met = parts.select("doc_id", "text_hash", F.inline(seen))

    def stands(pattern: Column, k: Column, raw: Column, skip: Column) -> Column:
        lead = F.length(F.regexp_extract(raw, f"^{_EDGE}*", 0))
        return F.struct(
            pattern.alias("pattern"), k.alias("k"), (F.col("left") + skip + lead).alias("start"),
            F.regexp_replace(raw, f"^{_EDGE}+|{_EDGE}+$", "").alias("value"),
        )

    found = []
    if around:
        # the words that follow and what stands before each of them
        some = F.regexp_extract("next", f"^(?:{others}*+{letters}++){{1,{WITHIN + 1}}}", 0)
        told = F.zip_with(
            F.regexp_extract_all(some, F.lit(f"{letters}+"), 0),
            F.split(some, f"{letters}+", -1),
            lambda w, gap: F.struct(F.lower(w).alias("w"), F.length(w).alias("n"), F.length(gap).alias("gap")),
        )
        met = met.withColumn("told", F.filter(told, lambda x: x["w"].isNotNull()))

        def between(k: Column) -> Column:
            size = F.aggregate(
                F.slice("told", F.lit(1), k - 1), F.lit(0), lambda a, x: a + x["gap"] + x["n"]
            )
            return F.substr("next", F.lit(1), size + F.get("told", k - 1)["gap"])

        def pattern(k: Column) -> Column:
            return F.concat(F.lit("around:"), F.col("word"), F.lit(" "), F.get("told", k - 1)["w"])

        ks = F.filter(F.sequence(F.lit(1), F.lit(WITHIN + 1)), lambda k: k <= F.size("told"))
        ks = F.filter(ks, lambda k: pattern(k).isin(around))
        found.append(F.transform(ks, lambda k: stands(pattern(k), k, between(k), F.lit(0))))
    if before:
        first = F.lower(F.regexp_extract("earlier", f"({letters}+){others}*$", 1))
        two = F.concat(F.lit("before:"), first, F.lit(" "), F.col("word"))
        near = F.left("next", F.lit(2 * _CONTEXT))
        after = F.regexp_extract(near, _AFTER, 1)
        here = stands(two, F.lit(0), after, F.position(after, near) - 1)
        found.append(F.array_compact(F.array(F.when(two.isin(before), here))))
    valid = F.filter(
        F.concat(*found), lambda s: s["value"].rlike(r"[\p{L}\p{N}]") & (F.length(s["value"]) <= _CONTEXT)
    )
    # of several right words of a pattern the nearest
    nearest = F.filter(
        "valid", lambda s: ~F.exists("valid", lambda o: (o["pattern"] == s["pattern"]) & (o["k"] < s["k"]))
    )
    got = met.withColumn("valid", valid).select("doc_id", "text_hash", F.explode(nearest).alias("s"))
    return got.select(
        "doc_id", "text_hash", "s.pattern", "s.start", (F.col("s.start") + F.length("s.value")).alias("end"), "s.value"
    )


def _score(edges: DataFrame, rounds: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Accepted ``value, kind`` and trusted ``pattern, kind`` of a graph of ``pattern, value, kind``."""
    # patterns without enough seeds can never be trusted, nor can what only they hold
    held = edges.groupBy("pattern").agg(
        F.countDistinct("value").alias("n"), F.count("kind").alias("seeds")
    )
    held = cut(held.filter(F.col("seeds") >= SEEDS).select("pattern", "n"), "pii-patterns", rows)
    links = cut(edges.join(held, "pattern"), "pii-links", rows)
    seeds = links.filter("kind is not null").select("pattern", "n", "kind", F.lit(1.0).alias("score"))
    unknown = links.filter("kind is null").select("pattern", "n", "value")
    believed = None
    for _ in range(rounds):
        known = seeds
        if believed is not None:
            known = known.unionByName(
                # words without digits are judged, but make no pattern surer
                unknown.filter(F.col("value").rlike("[0-9]")).join(believed, "value").select("pattern", "n", "kind", "score")
            )
        # the share of a pattern's instances that are of a kind, smoothed towards none
        share = (F.sum("score") / (F.max("n") + SMOOTH)).alias("trust")
        trust = cut(known.groupBy("pattern", "kind").agg(share), "pii-trust", rows)
        doubt = F.sum(F.log1p(-F.least("trust", F.lit(0.999999))))
        believed = cut(
            unknown.join(trust, "pattern").groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score")),
            "pii-believed",
            rows,
        )
    accepted = (
        believed.groupBy("value")
        .agg(F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("best"))
        .select("value", "best.*")
        .filter(F.col("score") >= ACCEPT)
        .select("value", "kind")
    )
    trusted = trust.filter(F.col("trust") >= TRUST).select("pattern", "kind")
    return cut(accepted, "pii-accepted", rows), trusted


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, text_hash, base, spans``: arrays of ``start, place, end, kind``, in order."""
    spans = find_spans(docs)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    found = learn(spans, rounds, docs).select(
        F.col("doc_id").alias("of"),
        F.col("text_hash").alias("of_text"),
        F.struct("start", place.alias("place"), "end", "kind").alias("span"),
    )
    found = found.groupBy("of", "of_text").agg(F.collect_set("span").alias("found"))
    found = cut(found, "pii-found", spans.count())
    joined = spans.join(
        found,
        F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_text")),
        "left",
    )
    order = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform(
        "base",
        lambda b: F.struct(
            b["start"].alias("start"),
            (F.array_position(order, b["kind"]).cast("int") - 1).alias("place"),
            b["end"].alias("end"),
            b["kind"].alias("kind"),
        ),
    )
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    return joined.select("doc_id", "text_hash", base.alias("base"), F.coalesce("found", none).alias("found")).select(
        "doc_id", "text_hash", "base", F.array_sort(F.concat("base", "found")).alias("spans")
    )


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def redact(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The documents with ``[KIND]`` in place of what was found; ``n_chars``, if there, follows."""
    found = find_personal_data(docs, rounds).filter(F.size("spans") > 0)
    # equal rows are told apart by nothing, so their spans are needed once
    found = found.select(
        F.struct("doc_id", "text_hash").alias("key"), F.col("spans")
    ).dropDuplicates(["key"])
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn(
        "key", F.struct(F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("text_hash"))
    )
    text = F.col("row.text")
    parts = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= a["at"],
                F.concat(
                    a["out"],
                    F.array(
                        text.substr(a["at"] + 1, s["start"] - a["at"]),
                        F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
                    ),
                ),
            )
            .otherwise(a["out"])
            .alias("out"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), text.substr(a["at"] + 1, F.length(text))),
    )
    joined = rows.join(found, rows["key"].eqNullSafe(found["key"]), "left").withColumn(
        "text", F.when(F.col("spans").isNull(), text).otherwise(parts)
    )
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return joined.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
