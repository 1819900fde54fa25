"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veladura.llm import (
    bpe,
    centroids,
    chat,
    codes,
    decontaminate,
    license_scan,
    mixing,
    pii,
    quality,
    simhash,
    suffix_dedup,
    toxicity,
    url_filter,
)
from veladura.llm.common import table

#: Used where the tables' own queries need a vocabulary file; a parameter everywhere else.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate(
        "spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]
    )
    return left.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = license_scan.fit_licenses(license_scan.corpus_negatives(docs))
    return license_scan.scan_licenses(docs, model).select(
        "doc_id", "license", "n_found", F.array_join("families", ",").alias("families")
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary())


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(
        F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text")
    )
    rows = given.unionByName(more)
    formatted = chat.format_reply_trees(chat.chains(rows, "conv_id", "turn"))
    read = formatted.select(
        "tree_id",
        "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.filter_urls(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def _op6_sql() -> str:
    after = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    listed = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        for h, p in (
            ("www.example.com", "/en/"), ("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/"),
            ("com", "/"),
        )
    )
    spam = "|".join(r.name.replace("-", "[-_.]") for r in url_filter.WORD_RULES)
    return f"""
WITH u AS (SELECT page_id, coalesce({after}, '') AS rest FROM pages),
p AS (SELECT page_id,
  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE {listed} END AS rule FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9])(?i:{spam})([^A-Za-z0-9]|$)') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))

    def n(kind: str):
        of_kind = F.filter("base", lambda s: s["kind"] == kind)
        return F.size(of_kind).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[n(k) for k in pii.KINDS],
        F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
        pii.spans_text(F.col("spans")).alias("spans"),
    )


#: Words that no document holds, so that the lines alone teach and use the pattern.
_CONTEXT = ("the holder answers by contactway ", " otherwiseclosed today")


def pii_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned spans alone, over all documents and a line for each customer.

    Most lines hold an address, every fourth a number in pairs of digits that no base pattern
    takes and that only its surroundings give away.
    """
    key = F.col("c_custkey")
    pairs = F.trim(F.regexp_replace(F.lpad(key.cast("string"), 8, "0"), "(..)", "$1 "))
    address = F.concat(F.lit("user"), key.cast("string"), F.lit("@shop.example"))
    said = F.concat(F.lit(_CONTEXT[0]), F.when(key % 4 == 0, pairs).otherwise(address), F.lit(_CONTEXT[1]))
    lines = table(spark, sf_dir, "customer").select((-1 - key).alias("doc_id"), said.alias("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(lines)
    found = pii.find_personal_data(docs)
    learned = F.filter("spans", lambda s: ~F.array_contains("base", s))
    return found.select("doc_id", F.explode(learned).alias("s")).select("doc_id", "s.kind", "s.start", "s.end")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted",
        F.size("offending").cast("bigint").alias("n_offending"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(table(spark, sf_dir, "embeddings"))[0]


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))[0]


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.by_position(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.size("copies").cast("bigint").alias("n_copies"), "first_position",
    )


QUERIES = {
    q.__name__: q
    for q in (
        op1_suffix_dedup,
        op2_license_scan,
        op3_decontaminate,
        op4_bpe,
        op5_chat,
        op6_url_filter,
        op7_pii,
        op8_toxicity,
        op9_quality,
        op10_simhash,
        op11_codes,
        op12_clusters,
        op13_mix,
        pii_in_context,
    )
}
_OP1_SQL = f"""
WITH n AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS h,
  CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT r, i, hash(h[i + 1 : i + {suffix_dedup.LENGTH}]) AS k
  FROM (SELECT r, h, unnest(range(0, n - {suffix_dedup.LENGTH - 1})) AS i FROM n WHERE n >= {suffix_dedup.LENGTH})),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hits AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {suffix_dedup.LENGTH}
  THEN 0 ELSE 1 END AS fresh FROM w JOIN twice USING (k)),
spans AS (SELECT r, min(i) AS a, max(i) + {suffix_dedup.LENGTH} AS b FROM (SELECT r, i, sum(fresh) OVER
  (PARTITION BY r ORDER BY i) AS g FROM hits) GROUP BY r, g),
cuts AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS done FROM spans),
kept AS (SELECT r, string_agg(hex(h[done + 1 : a]), '' ORDER BY a) AS head, max(b) AS last,
  count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed FROM cuts JOIN n USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || hex(h[coalesce(last, 0) + 1 : n]))) AS kept_sha256
FROM n LEFT JOIN kept USING (r)"""

_OP5_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, length(text) + len(regexp_extract_all(text, '{chat.ESCAPE}')) AS body_chars,
  replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C') AS shown FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text))
    AS loss_sha256,
  CAST(sum(length(shown) + body_chars + {len(chat.OPEN) + len(chat.CLOSE) + 2}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

_WHOLE = """list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE)))"""
_FINITE = """embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"""
_APART = "list_inner_product({0}, {0}) + list_inner_product({1}, {1}) - 2 * list_inner_product({0}, {1})"


def _op11_sql() -> str:
    n, rounds = codes.PARTS, codes.ROUNDS
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
  {_WHOLE} AS v FROM embeddings WHERE {_FINITE}),
parts AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {n}) + 1 : (p + 1) * (len(v) // {n})] AS x
  FROM kept, range({n}) AS t(p)),
books0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS y FROM parts WHERE r <= {codes.ENTRIES})"""]  # fmt: skip
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x,
  min({{'d': CAST({_APART.format("x", "y")} AS BIGINT), 'e': e}}) AS best
  FROM parts JOIN books{i} USING (p) GROUP BY r, p)""")
        if i < rounds:
            steps.append(f"""books{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM books{i} b LEFT JOIN
  (SELECT p, e, list(f ORDER BY i) AS y FROM (SELECT p, e, i, floor(sum(c) / count(*)) AS f FROM
    (SELECT p, best.e AS e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM near{i}) GROUP BY p, e, i)
   GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)""")
    steps.append(f"""coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code,
  CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY r)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda c: CAST(c AS BIGINT)), ','), ',' ORDER BY p, e))
   FROM books{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (r)"""


def _op12_sql() -> str:
    rounds = centroids.ROUNDS
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id) NULLS LAST, embedding) AS r,
  vec_id, {_WHOLE} AS x FROM embeddings WHERE {_FINITE} AND len(embedding) = {centroids.DIM}),
c0 AS MATERIALIZED (SELECT r - 1 AS c, x AS y FROM kept WHERE r <= {centroids.CLUSTERS})"""]  # fmt: skip
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (SELECT r, any_value(x) AS x,
  min({{'d': CAST({_APART.format("x", "y")} AS BIGINT), 'c': c}}) AS best FROM kept, c{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT b.c, coalesce(m.y, b.y) AS y FROM c{i} b LEFT JOIN
  (SELECT c, list(f ORDER BY i) AS y FROM (SELECT c, i, floor(sum(v) / count(*)) AS f FROM
    (SELECT best.c AS c, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM near{i}) GROUP BY c, i)
   GROUP BY c) m USING (c))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, best.d AS distance,
  CAST(sum(best.d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(y, lambda v: CAST(v AS BIGINT)), ',')) AS centroid_sha256
FROM near{rounds} JOIN kept USING (r) JOIN c{rounds} ON c = best.c"""


def _op13_sql() -> str:
    when = " ".join(
        f"WHEN {k} THEN CASE WHEN {a} > 0 THEN 2 * ({a}) / ({v} + sqrt(greatest({v * v} + {2 * (w - v)} * ({a}), 0))) ELSE 0 END"
        for k, v, w, a in (
            (k, float(s.knots[0][1]), float(s.knots[1][1]), f"share * {float(s.weight)}")
            for k, s in enumerate(mixing.SCHEDULES)
        )
    )
    return rf"""
WITH d AS (SELECT doc_id, source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS HUGEINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, sum(n) OVER () AS all_n, sum(w) OVER () AS all_w,
  coalesce(sum(n) OVER up, 0) AS n_before, coalesce(sum(w) OVER up, 0) AS w_before FROM s
  WINDOW up AS (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, {mixing.EPOCHS} * n * (all_w - w_before) < w * (all_n - {mixing.EPOCHS} * n_before) AS is_full FROM o),
g AS (SELECT *, sum(n) OVER () - coalesce(sum({mixing.EPOCHS} * n) FILTER (is_full) OVER (), 0) AS left_n,
  sum(w) FILTER (NOT is_full) OVER () AS left_w FROM f),
t AS (SELECT source, n, w, CASE WHEN is_full THEN {mixing.EPOCHS} * n ELSE CAST(w * left_n AS HUGEINT) // CAST(left_w AS HUGEINT) END AS want,
  CASE WHEN is_full THEN CAST({mixing.EPOCHS} * n AS DOUBLE) ELSE CAST(w * left_n AS DOUBLE) / CAST(left_w AS DOUBLE) END AS target FROM g),
p AS (SELECT doc_id, size, n, w, want, target, coalesce(sum(size) OVER (PARTITION BY d.source
  ORDER BY md5('{mixing.SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CAST(b AS DOUBLE) / CAST(want AS DOUBLE) AS share FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target,
  CAST(CASE WHEN n > 0 THEN CAST(want AS HUGEINT) // CAST(n AS HUGEINT) * size
    + least(greatest(CAST(want AS HUGEINT) % CAST(n AS HUGEINT) - b, 0), size) ELSE 0 END AS BIGINT) AS taken,
  CAST(len(list_filter(range({mixing.EPOCHS}), lambda e: size > 0 AND e * n + b < want)) AS BIGINT) AS n_copies,
  CASE WHEN size > 0 AND b < want THEN least(CASE w - 1 {when} END, 1) END AS first_position
FROM q"""


ORACLE_SQL = {
    "op1_suffix_dedup": _OP1_SQL,
    "op5_chat": _OP5_SQL,
    "op6_url_filter": _op6_sql(),
    "op11_codes": _op11_sql(),
    "op12_clusters": _op12_sql(),
    "op13_mix": _op13_sql(),
    "pii_in_context": f"""SELECT -1 - c_custkey AS doc_id, 'email' AS kind, {len(_CONTEXT[0])} AS start,
  {len(_CONTEXT[0]) + 11} AS "end" FROM customer WHERE c_custkey % 4 = 0""",
}
