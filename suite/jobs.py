"""Whole jobs: protect, reveal, join, retrofit, verify, audit, stream."""

from __future__ import annotations

import os
from datetime import timedelta

from pyspark.sql import functions as F

from suite import expected as X
from suite.data import (
    DEMO_KEYS,
    DEMO_SECRET,
    TOKEN_FIELDS,
    people,
    purchases,
    retrofitted,
    rough_people,
    rough_table,
    stored,
    stored_staging,
    stored_token_map,
    table,
    to_store,
)
from suite.registry import query
from veladura import policy as P
from veladura.functions import templates, tokens
from veladura.functions.sql import register_protect_functions, register_text_functions
from veladura.operators import audit, leaks, verify
from veladura.operators.lookup import by_id
from veladura.operators.protect import (
    encode_values,
    protect,
    protect_column,
    protect_observed,
)
from veladura.operators.reveal import decode_values, reveal, reveal_customers
from veladura.operators.token_map import (
    build_token_map,
    detokenize,
    detokenize_by_address,
    new_entries,
    token_collisions,
)
from veladura.operators.validate import only_new
from veladura.operators.views import stored_names
from veladura.plans import retrofit
from veladura.plans.create import create_customers, take_in
from veladura.plans import csv_job
from veladura.plans.csv_job import protect_csv
from veladura.schemas import STORED_CUSTOMER
from veladura.session import fresh_path
from veladura.sources.csv_text import read_csv, write_csv
from veladura.sources.synthetic import customer_cpf, customers
from veladura.sources.versions import VersionedTable
from veladura.streaming.intake import first_per_key, protect_append, protect_stream, read_stream, state_on_disk
from veladura.streaming.joins import join_streams

# ---- protect ---------------------------------------------------------------

_ALL = X.columns(*P.CUSTOMER_FIELDS)


@query(
    "E1",
    f"WITH RECURSIVE {X.PEOPLE},\n{X.protected('people', _ALL, 'p', keep='s.saude, s.raca')}\n"
    f"SELECT id, saude, raca, {', '.join(_ALL)} FROM p",
)
def protect_customers(spark, sf_dir):
    raw = people(spark, sf_dir).select("id", "saude", "raca", *_ALL)
    return protect(raw, P.customer_policy, DEMO_KEYS, role="core-role")


_BATCH = X.columns("cpf", "pan", "telefone", "email", "dob", "endereco", "conta")


@query(
    "E2 G2",
    f"WITH RECURSIVE {X.PEOPLE},\n{X.ROUGH},\n{X.protected('rough', _BATCH, 'p', keep='s.cvv')}\n"
    f"SELECT id, cvv, {', '.join(_BATCH)} FROM p",
)
def protect_detected_columns(spark, sf_dir):
    """Columns found by name; values that do not fit become the error text."""
    raw = rough_table(spark, sf_dir).select("id", "cvv", *_BATCH)
    return protect_observed(raw, P.batch_policy, DEMO_KEYS)[0]


@query(
    "G2",
    f"WITH RECURSIVE {X.PEOPLE},\n{X.ROUGH},\n"
    f"{X.protected('rough', X.columns('cpf', 'email'), 'p', otherwise='NULL')}\n"
    "SELECT id, cpf, email FROM p",
)
def errors_as_null(spark, sf_dir):
    raw = rough_people(spark, sf_dir).select("id", "cpf", "email")
    return protect(raw, P.customer_policy, DEMO_KEYS, on_error="null")


_CODE_LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CODE = templates.Template("^([0-9A-Z]{3})-([0-9A-Z]{4})/?([0-9A-Z]{3})$", _CODE_LETTERS)
_CODES = (
    "codes AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN lower(c) ELSE c END AS code FROM "
    "(SELECT c_custkey, upper(left(c_mktsegment, 3)) || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || "
    "CASE WHEN c_custkey % 2 = 0 THEN '/' ELSE '' END || upper(substr(c_mktsegment, 4, 3)) AS c FROM customer)),\n"
    "v AS (SELECT id, 'codes' AS name, replace(replace(code, '-', ''), '/', '') AS x, 10 AS n FROM codes "
    "WHERE id % 11 <> 0),\n"
)


@query(
    "M1 M2 C12 H21",
    f"WITH RECURSIVE {_CODES}{X.ff3_ctes(DEMO_KEYS, ['codes'], 'v', 'e', _CODE_LETTERS)}\n"
    "SELECT c.id, code, left(y, 3) || '-' || substr(y, 4, 4) || CASE WHEN c.id % 2 = 0 THEN '/' ELSE '' END || "
    "substr(y, 8) AS coded, CASE WHEN y IS NOT NULL THEN code END AS back FROM codes c LEFT JOIN e ON e.id = c.id",
)
def encode_by_own_template(spark, sf_dir):
    """Customer codes of letters and digits, in an alphabet and a template of their own."""
    key = F.col("c_custkey")
    code = F.concat(
        F.upper(F.left("c_mktsegment", F.lit(3))), F.lit("-"), F.lpad((key % 10000).cast("string"), 4, "0"),
        F.when(key % 2 == 0, "/").otherwise(""), F.upper(F.substring("c_mktsegment", 4, 3)),
    )
    rows = table(spark, sf_dir, "customer").select(
        key.alias("id"), F.when(key % 11 == 0, F.lower(code)).otherwise(code).alias("code")
    )
    coded = rows.withColumn("coded", templates.code_by_template(F.col("code"), _CODE, "codes", DEMO_KEYS))
    back = templates.code_by_template(F.col("coded"), _CODE, "codes", DEMO_KEYS, decode=True)
    return coded.withColumn("back", back)


@query(
    "H20 C12",
    "SELECT c_custkey AS id, '********#' || '*****' || right(c_name, 4) AS masked FROM customer",
)
def mask_by_own_template(spark, sf_dir):
    """Names like Customer#000000012: only the separator and the last four digits are shown."""
    shown = templates.Template("(.{8})#([0-9]{5})[0-9]{4}")
    masked = templates.mask_by_template(F.col("c_name"), shown)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), masked.alias("masked"))


_CSV = X.columns("cpf", "email", "telefone", "pan", "dob", "endereco")


@query(
    "E3 A1 A3",
    f"WITH RECURSIVE {X.PEOPLE},\n{X.ROUGH},\n{X.protected('rough', _CSV, 'p')}\n"
    "SELECT CAST(id AS VARCHAR) AS id, cpf, email, telefone, pan, dob, "
    "nullif(endereco, '') AS endereco FROM p",
)
def protect_csv_file(spark, sf_dir):
    source, target = fresh_path(spark, "csv-in"), fresh_path(spark, "csv-out")
    write_csv(rough_table(spark, sf_dir).select("id", *_CSV), source)
    protect_csv(spark, source, target, DEMO_KEYS)
    return read_csv(spark, target, ["id", *_CSV])


@query(
    "A1 E3 U2",
    f"WITH RECURSIVE {X.PEOPLE},\n{X.ROUGH},\n{X.protected('rough', _CSV, 'p')}\n"
    "SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 3 = 2 THEN NULL ELSE 'line ' || id || chr(10) || 'two' END AS obs, "
    "cpf, email, telefone, CASE WHEN id % 3 = 2 THEN NULL ELSE pan END AS pan, dob, "
    "nullif(endereco, '') AS endereco FROM p",
)
def protect_csv_files_of_any_order(spark, sf_dir):
    """One folder, three headers: two orders, other letter case, columns that only some files have."""
    source, target = fresh_path(spark, "csv-in"), fresh_path(spark, "csv-out")
    obs = F.concat(F.lit("line "), F.col("id"), F.lit("\n"), F.lit("two")).alias("obs")
    rough = rough_table(spark, sf_dir).select("id", obs, *_CSV)
    write_csv(rough.filter("id % 3 = 0"), source)
    write_csv(rough.filter("id % 3 = 1").select(*reversed(rough.columns)), source, "append")
    others = [F.col(c).alias(c.upper()) for c in ("cpf", "dob", "id", "endereco", "telefone", "email")]
    write_csv(rough.filter("id % 3 = 2").select(*others), source, "append")
    protect_csv(spark, source, target, DEMO_KEYS)
    done = read_csv(spark, target)
    return done.select(*[F.col(c).alias(c) for c in ("id", "obs", *_CSV)])


_CSV_NAMED = {"nome": "mask-nome"} | _CSV


@query(
    "E3 U2 G2",
    f"WITH RECURSIVE {X.PEOPLE},\n{X.ROUGH},\n{X.protected('rough', _CSV, 'p', keep='s.nome')}\n"
    "SELECT CAST(p.id AS VARCHAR) AS id, CASE WHEN trim(p.nome) <> '' THEN 'ERROR' ELSE p.nome END "
    "AS nome, cpf, email, telefone, pan, dob, nullif(endereco, '') AS endereco, n_errors FROM p, "
    "(SELECT CAST(sum(CASE WHEN trim(nome) <> '' THEN 1 ELSE 0 END) + "
    + " + ".join(
        f"count(*) FILTER (WHERE {X.has_value(c)} AND NOT {X.fits(c, n)})" for c, n in _CSV.items()
    )
    + " AS BIGINT) AS n_errors FROM rough)",
)
def csv_job_with_defaults(spark, sf_dir):
    """The job as it is called: its role may not mask names, so they become errors."""
    source, target = fresh_path(spark, "csv-in"), fresh_path(spark, "csv-out")
    write_csv(rough_table(spark, sf_dir).select("id", *_CSV_NAMED), source)
    before = os.environ.get("VELADURA_MASTER_KEY")
    os.environ["VELADURA_MASTER_KEY"] = DEMO_SECRET.hex()
    try:
        summary = csv_job.main(["--input", source, "--output", target])
    finally:
        if before is None:
            del os.environ["VELADURA_MASTER_KEY"]
        else:
            os.environ["VELADURA_MASTER_KEY"] = before
    done = read_csv(spark, target, ["id", *_CSV_NAMED])
    return done.withColumn("n_errors", F.lit(summary["errors"]).cast("bigint"))


@query(
    "E4 U3",
    f"WITH RECURSIVE {X.PEOPLE},\n{X.protected('people', _BATCH, 'p', keep='s.nome')}\n"
    f"SELECT id, nome, {', '.join(_BATCH)} FROM p",
)
def protect_by_field_map(spark, sf_dir):
    raw = people(spark, sf_dir).select("id", "nome", *_BATCH)
    return protect(raw, P.ProtectionPolicy(_BATCH), DEMO_KEYS, role="pipeline-role")


_ORDER_VALUES = (
    f"buyers AS (SELECT DISTINCT o_custkey AS id, {X.cpf_of('o_custkey')} AS cpf FROM orders),\n"
    "v AS (SELECT id, 'ff-cpf' AS name, CAST(cpf AS BIGINT) AS x, 11 AS n FROM buyers)"
)
_ORDER_CPFS = f"{_ORDER_VALUES},\n{X.ff3_ctes(DEMO_KEYS, ['ff-cpf'], 'v', 'e')}"


@query(
    "E9",
    f"WITH RECURSIVE {_ORDER_CPFS}\n"
    "SELECT o_orderkey, e.y AS encoded, b.cpf AS decoded FROM orders "
    "JOIN e ON e.id = o_custkey JOIN buyers b ON b.id = o_custkey",
)
def encode_and_decode_column(spark, sf_dir):
    """A whole column at once: equal values give equal codes, in their own rows."""
    raw = purchases(spark, sf_dir).select("o_orderkey", F.col("cpf").alias("encoded"))
    field = {"encoded": "ff-cpf"}
    coded = protect(raw, P.ProtectionPolicy(field), DEMO_KEYS)
    return reveal(
        coded.withColumn("decoded", F.col("encoded")), {"decoded": "ff-cpf"}, DEMO_KEYS
    )


_MIX = X.columns("cpf", "cnpj", "email", "conta", "raca")


def _mixed_values(df):
    entries = [
        F.struct(F.lit(n).alias("transformation"), F.col(c).alias("value")) for c, n in _MIX.items()
    ]
    return df.select("id", F.inline(F.array(*entries)))


def _cnpj_like(c: str) -> str:
    return (
        f"(substr({c}, 1, 2) || '.' || substr({c}, 3, 3) || '.' || substr({c}, 6, 3) || '/' "
        f"|| substr({c}, 9, 4) || '-' || substr({c}, 13, 2))"
    )


_MIX_SQL = " UNION ALL ".join(
    f"SELECT s.id, '{n}' AS transformation, s.{c} AS value, "
    f"{_cnpj_like(f'p.{c}') if c == 'cnpj' else f'p.{c}'} AS encoded_value "
    "FROM people s JOIN p ON p.id = s.id"
    for c, n in _MIX.items()
)


@query(
    "E10",
    f"WITH RECURSIVE {X.PEOPLE},\n{X.protected('people', _MIX, 'p')}\n"
    "SELECT id, transformation, value, CAST(length(value) AS INTEGER) AS original_length, "
    f"encoded_value, transformation NOT LIKE 'mask-%' AS reversible FROM ({_MIX_SQL})",
)
def encode_mixed_values(spark, sf_dir):
    return encode_values(_mixed_values(people(spark, sf_dir)), DEMO_KEYS)


@query(
    "E10",
    f"WITH {X.PEOPLE}\nSELECT id, transformation, decoded_value FROM ("
    + " UNION ALL ".join(
        f"SELECT id, '{n}' AS transformation, {c} AS decoded_value FROM people"
        for c, n in _MIX.items()
        if c != "email"
    )
    + ")",
)
def decode_mixed_values(spark, sf_dir):
    coded = encode_values(_mixed_values(people(spark, sf_dir)), DEMO_KEYS)
    chosen = coded.filter("reversible").select(
        "id", "transformation", F.col("encoded_value").alias("value")
    )
    decoded = decode_values(chosen, DEMO_KEYS, stored_token_map(spark, sf_dir))
    return decoded.drop("value")


@query(
    "U1",
    f"WITH RECURSIVE {X.PEOPLE},\n{X.protected('people', X.columns('cpf', 'raca'), 'p')}\n"
    "SELECT p.id, p.cpf AS by_column, p.cpf AS by_sql, p.raca, s.cpf AS back, "
    f"{X.CPF_FORMATTED.format(c='p.cpf')} AS shown FROM p JOIN people s ON s.id = p.id",
)
def functions_in_sql(spark, sf_dir):
    register_text_functions(spark)
    register_protect_functions(spark, DEMO_KEYS, "core-role", ["ff-cpf", "tok-raca"])
    raw = people(spark, sf_dir)
    raw.createOrReplaceTempView("veladura_people")
    by_column = protect_column(F.col("cpf"), "ff-cpf", DEMO_KEYS).alias("by_column")
    in_sql = spark.sql(
        "SELECT id, encode_ff_cpf(cpf) AS by_sql, encode_tok_raca(raca) AS raca, "
        "decode_ff_cpf(encode_ff_cpf(cpf)) AS back, format_cpf(encode_ff_cpf(cpf)) AS shown "
        "FROM veladura_people"
    )
    return raw.select("id", by_column).join(in_sql, "id")


# ---- joins and the token map -----------------------------------------------


@query(
    "D1 F5",
    f"WITH {X.PEOPLE},\n"
    "spent AS (SELECT o_custkey, count(*) AS n_orders, "
    "CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents "
    "FROM orders GROUP BY o_custkey)\n"
    f"SELECT n_name, {X.token('raca', 'tok-raca')} AS raca, count(*) AS n_customers, "
    "CAST(sum(n_orders) AS BIGINT) AS n_orders, CAST(sum(cents) AS BIGINT) AS cents "
    "FROM people JOIN spent ON o_custkey = id JOIN customer ON c_custkey = id "
    "JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name, raca",
)
def join_on_protected_key(spark, sf_dir):
    """Two protected datasets joined without raw data, totals per nation and category.

    Each department protects its own copy.  Purchases are summed per encrypted CPF
    before the join, so both sides have one row per key.
    """
    cards = customers(
        table(spark, sf_dir, "customer"), "c_custkey", keep=("c_nationkey",)
    ).select("cpf", "raca", "c_nationkey")
    policy = P.ProtectionPolicy.of("cpf", "raca")
    safe_cards = protect(cards, policy, DEMO_KEYS, pin=True)
    sales = purchases(spark, sf_dir).select("cpf", "cents")
    safe_sales = protect(sales, policy, DEMO_KEYS, pin=True)
    spent = safe_sales.groupBy("cpf").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum("cents").alias("cents")
    )
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        safe_cards.join(spent, "cpf")
        .groupBy("c_nationkey", "raca")
        .agg(
            F.count(F.lit(1)).alias("n_customers"),
            F.sum("n_orders").alias("n_orders"),
            F.sum("cents").alias("cents"),
        )
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("n_name", "raca", "n_customers", "n_orders", "cents")
    )


@query(
    "D1",
    f"WITH {X.PEOPLE}\n"
    f"SELECT {X.token('a.endereco', 'tok-endereco')} AS endereco, a.n AS n_customers, b.n AS n_buyers "
    "FROM (SELECT endereco, count(*) AS n FROM people WHERE trim(endereco) <> '' GROUP BY endereco) a "
    "JOIN (SELECT endereco, count(*) AS n FROM people WHERE trim(endereco) <> '' AND id IN "
    "(SELECT o_custkey FROM orders) GROUP BY endereco) b ON a.endereco = b.endereco",
)
def join_on_token(spark, sf_dir):
    """Addresses that two datasets share, matched by token.  Counted before the join."""
    policy = P.ProtectionPolicy.of("endereco")
    buyers = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    everyone = people(spark, sf_dir).select("id", "endereco")
    living = protect(everyone.filter("trim(endereco) <> ''"), policy, DEMO_KEYS)
    bought = protect(
        customers(buyers, "o_custkey").select("id", "endereco").filter("trim(endereco) <> ''"),
        policy,
        DEMO_KEYS,
    )
    here = living.groupBy("endereco").agg(F.count(F.lit(1)).alias("n_customers"))
    there = bought.groupBy("endereco").agg(F.count(F.lit(1)).alias("n_buyers"))
    return here.join(there, "endereco")


@query(
    "M4",
    f"WITH {X.PEOPLE}\n"
    + " UNION ALL ".join(
        f"SELECT DISTINCT '{n}' AS transformation, {X.token(c, n)} AS token, {c} AS opened "
        f"FROM people WHERE {X.has_value(c)}"
        for c, n in TOKEN_FIELDS.items()
    ),
)
def token_map(spark, sf_dir):
    built = build_token_map(people(spark, sf_dir), TOKEN_FIELDS, DEMO_KEYS)
    opened = F.lit(None).cast("string")
    for name in TOKEN_FIELDS.values():
        mine = F.col("transformation") == name
        opened = F.when(mine, tokens.unseal(F.col("value_enc"), name, DEMO_KEYS)).otherwise(opened)
    return built.select("transformation", "token", opened.alias("opened"))


@query(
    "M4",
    f"WITH {X.PEOPLE}\n"
    "SELECT CAST((SELECT count(DISTINCT endereco) FROM people WHERE trim(endereco) <> '') "
    "- (SELECT count(DISTINCT endereco) FROM people WHERE trim(endereco) <> '' "
    "AND religiao = 'Zoroastrista') "
    "AS BIGINT) AS n_new, CAST(0 AS BIGINT) AS n_collisions",
)
def token_map_growth(spark, sf_dir):
    """Entries to append to a map built from the customers of one category."""
    everyone, field = people(spark, sf_dir), {"endereco": "tok-endereco"}
    known = build_token_map(everyone.filter("religiao = 'Zoroastrista'"), field, DEMO_KEYS)
    fresh = new_entries(build_token_map(everyone, field, DEMO_KEYS), known)
    twice = token_collisions(everyone, field, DEMO_KEYS).agg(F.count(F.lit(1))).scalar()
    return fresh.agg(F.count(F.lit(1)).alias("n_new")).withColumn("n_collisions", twice)


@query("D2 M5", X.people("SELECT id, endereco, conta, saude, raca, religiao FROM people"))
def detokenize_columns(spark, sf_dir):
    raw = people(spark, sf_dir).select("id", *TOKEN_FIELDS)
    safe = protect(raw, P.ProtectionPolicy(TOKEN_FIELDS), DEMO_KEYS)
    return detokenize(safe, TOKEN_FIELDS, stored_token_map(spark, sf_dir), DEMO_KEYS)


@query("D2 M5", X.people("SELECT id, endereco, conta, saude, raca, religiao FROM people"))
def detokenize_large_map(spark, sf_dir):
    """All token columns against a map that is shuffled, as one too large to broadcast is."""
    raw = people(spark, sf_dir).select("id", *TOKEN_FIELDS)
    safe = protect(raw, P.ProtectionPolicy(TOKEN_FIELDS), DEMO_KEYS)
    return detokenize(
        safe, TOKEN_FIELDS, stored_token_map(spark, sf_dir), DEMO_KEYS, hint="merge"
    )


@query("D2 M5", X.people("SELECT id, endereco, conta, saude, raca, religiao FROM people"))
def detokenize_columns_by_address(spark, sf_dir):
    """All token columns in one join with a shuffled map, the wide rows shuffled once."""
    raw = people(spark, sf_dir).select("id", *TOKEN_FIELDS)
    safe = protect(raw, P.ProtectionPolicy(TOKEN_FIELDS), DEMO_KEYS)
    return detokenize_by_address(
        safe, TOKEN_FIELDS, stored_token_map(spark, sf_dir), DEMO_KEYS, hint="merge"
    )


@query(
    "D4",
    f"WITH {X.PEOPLE}\nSELECT id, CASE WHEN nome = 'Olívia dos Reis Tavares' THEN upper(nome) ELSE nome END "
    "AS nome, "
    f"{X.mask_email('email')} AS email_masked FROM people",
)
def update_by_key(spark, sf_dir):
    before = stored(spark, sf_dir)
    changes = before.filter("nome = 'Olívia dos Reis Tavares'").withColumn("nome", F.upper("nome"))
    # changes for customers that are not stored: an update adds nobody
    unknown = before.filter("nome <> 'Olívia dos Reis Tavares'").withColumn("id", -1 - F.col("id"))
    changes = changes.unionByName(unknown)
    return retrofit.apply_updates(before, changes).select("id", "nome", "email_masked")


@query(
    "D4 F13",
    f"WITH {X.PEOPLE},\nh AS (SELECT id, nome, {X.mask_email('email')} AS email_masked FROM people)\n"
    "SELECT id, CASE WHEN id % 97 = 5 THEN upper(nome) ELSE nome END AS nome, email_masked, "
    "id % 97 = 5 AS updated FROM h",
)
def update_files_by_key(spark, sf_dir):
    """The same by file: a table in key order, of which few files hold a changed customer."""
    before = stored(spark, sf_dir).withColumn("updated_at", F.lit(None).cast("timestamp"))
    customers_table = VersionedTable(spark, fresh_path(spark, "versioned"))
    customers_table.create(before.repartitionByRange(20, "id"))
    changes = before.filter("id % 97 = 5").withColumn("nome", F.upper("nome"))
    unknown = before.filter("id % 97 = 6").withColumn("id", -1 - F.col("id"))
    customers_table.update(changes.unionByName(unknown))
    updated = F.col("updated_at").isNotNull().alias("updated")
    return customers_table.read().select("id", "nome", "email_masked", updated)


# ---- reveal ----------------------------------------------------------------


@query("E5", X.people("SELECT id, cpf, telefone, pan FROM people"))
def reveal_encrypted_columns(spark, sf_dir):
    shown = stored(spark, sf_dir).select(
        "id",
        F.col("cpf_protected").alias("cpf"),
        F.col("telefone_protected").alias("telefone"),
        F.col("pan_protected").alias("pan"),
    )
    return reveal(shown, X.columns("cpf", "telefone", "pan"), DEMO_KEYS)


@query(
    "E6 B10",
    X.people(
        f"SELECT id, nome, {X.CPF_FORMATTED.format(c='cpf')} AS cpf, {X.mask_email('email')} AS email, "
        "telefone, pan, endereco, conta FROM people"
    ),
)
def reveal_stored_customers(spark, sf_dir):
    return reveal_customers(stored(spark, sf_dir), DEMO_KEYS, stored_token_map(spark, sf_dir))


@query(
    "E6",
    X.people(
        f"SELECT id, nome, {X.CPF_FORMATTED.format(c='cpf')} AS cpf, {X.mask_email('email')} AS email, "
        "telefone, pan, endereco, conta FROM people WHERE id = 42"
    ),
)
def reveal_one_customer(spark, sf_dir):
    """Filtered first: one row is decoded, and its tokens filter the scan of the map."""
    return reveal_customers(
        by_id(stored(spark, sf_dir), 42), DEMO_KEYS, stored_token_map(spark, sf_dir), few=True
    )


_TRAIL = (
    "(SELECT id, unnest(['cpf', 'telefone', 'pan', 'endereco', 'conta']) AS f, "
    "unnest([cpf, telefone, pan, endereco, conta]) AS v FROM people) WHERE v IS NOT NULL"
)


@query(
    "G7",
    X.people(
        "SELECT 'dpo' AS actor, 'core-role' AS role, 'decode' AS operation, f AS \"column\", "
        f"id AS key FROM {_TRAIL}"
    ),
)
def reveal_audit_trail(spark, sf_dir):
    """The reveal itself leaves the trail."""
    path = fresh_path(spark, "trail")
    audit.reveal_logged(
        stored(spark, sf_dir), DEMO_KEYS, stored_token_map(spark, sf_dir), "dpo", path
    )
    return spark.read.parquet(path).drop("at")


@query(
    "G7",
    X.people(
        "SELECT 'dpo' AS actor, 'core-role' AS role, 'decode' AS operation, f AS \"column\", "
        f"count(*) AS n_values, count(DISTINCT id) AS n_rows FROM {_TRAIL} GROUP BY f"
    ),
)
def reveal_audit_summary(spark, sf_dir):
    path = fresh_path(spark, "trail")
    audit.reveal_logged(
        stored(spark, sf_dir), DEMO_KEYS, stored_token_map(spark, sf_dir), "dpo", path
    )
    return audit.trail_summary(spark.read.parquet(path))


# ---- intake ----------------------------------------------------------------

_GOOD = (
    "nome IS NOT NULL AND email IS NOT NULL AND regexp_matches(translate(cpf, '.-', ''), "
    "'^[0-9]{11}$') AND (pan IS NULL OR regexp_matches(translate(pan, ' -', ''), '^[0-9]{13,16}$'))"
)
_INTAKE = X.columns("cpf", "email", "telefone", "pan", "cvv", "dob", "endereco", "conta")
_ACCEPTED = f"""{X.PEOPLE},
{X.ROUGH},
good AS (SELECT * FROM rough WHERE {_GOOD}),
{X.protected('good', _INTAKE, 'p', otherwise='NULL', keep='s.nome')}"""
_ACCEPTED_ROWS = (
    "SELECT id, nome, cpf AS cpf_protected, email AS email_masked, telefone AS telefone_protected, "
    "pan AS pan_protected, cvv AS cvv_masked, dob AS dob_masked, endereco AS endereco_token, "
    "conta AS conta_token FROM p"
)


@query("E7", f"WITH RECURSIVE {_ACCEPTED}\n{_ACCEPTED_ROWS}")
def accept_customers(spark, sf_dir):
    raw = rough_table(spark, sf_dir).select("id", "nome", *_INTAKE)
    return take_in(raw, DEMO_KEYS, on_error="null").accepted


@query(
    "E7",
    f"WITH RECURSIVE {_ACCEPTED}\n"
    "SELECT nome, '***.***.' || substr(cpf, 7, 3) || '-' || right(cpf, 2) AS cpf_display, "
    "email AS email_masked, dob AS dob_masked, endereco AS endereco_token FROM p",
)
def create_and_display(spark, sf_dir):
    """Validate, protect, store under new ids, show; a second run adds nothing."""
    path = fresh_path(spark, "created")
    spark.createDataFrame([], STORED_CUSTOMER).write.parquet(path)
    raw = rough_table(spark, sf_dir).select("id", "nome", *_INTAKE)
    create_customers(raw, path, DEMO_KEYS, on_error="null")
    shown = create_customers(raw, path, DEMO_KEYS, on_error="null")
    return shown.select("nome", "cpf_display", "email_masked", "dob_masked", "endereco_token")


@query(
    "I1",
    f"WITH RECURSIVE {_ACCEPTED}\n{_ACCEPTED_ROWS}",
)
def protect_stream_accepted(spark, sf_dir):
    accepted, _ = _run_stream(spark, sf_dir)
    return accepted


@query(
    "I1",
    f"WITH {X.PEOPLE},\n{X.ROUGH}\nSELECT id, CASE WHEN nome IS NULL THEN 'missing nome' "
    "WHEN email IS NULL THEN 'missing email' WHEN NOT regexp_matches(translate(cpf, '.-', ''), "
    "'^[0-9]{11}$') THEN 'invalid cpf' ELSE 'invalid pan' END AS reason FROM rough "
    f"WHERE NOT ({_GOOD})",
)
def protect_stream_rejected(spark, sf_dir):
    _, rejected = _run_stream(spark, sf_dir)
    return rejected


def _run_stream(spark, sf_dir):
    root = fresh_path(spark, "stream")
    source = f"{root}/in"
    raw = rough_table(spark, sf_dir).select("id", "nome", *_INTAKE)
    raw.repartition(3, "id").write.parquet(source)
    stream = read_stream(spark, source, raw.schema, maxFilesPerTrigger=1)
    run = protect_stream(
        stream, f"{root}/accepted", f"{root}/rejected", f"{root}/state", DEMO_KEYS
    )
    run.awaitTermination()
    accepted = spark.read.parquet(f"{root}/accepted").drop("run", "batch")
    return accepted, spark.read.parquet(f"{root}/rejected").drop("run", "batch")


@query(
    "I1",
    f"WITH RECURSIVE {_ACCEPTED}\n{_ACCEPTED_ROWS}",
)
def stream_under_two_checkpoints(spark, sf_dir):
    """Two streams, each with a checkpoint of its own, add to one table; one is started again."""
    root = fresh_path(spark, "stream-two")
    raw = rough_table(spark, sf_dir).select("id", "nome", *_INTAKE)
    for part in (0, 1, 0):
        source = f"{root}/in{part}"
        raw.filter(F.col("id") % 2 == part).write.mode("ignore").parquet(source)
        stream = read_stream(spark, source, raw.schema, maxFilesPerTrigger=1)
        protect_stream(
            stream, f"{root}/accepted", f"{root}/rejected", f"{root}/state{part}", DEMO_KEYS
        ).awaitTermination()
    return spark.read.parquet(f"{root}/accepted").drop("run", "batch")


_ROWS_PER_ARRIVING_FILE = 100_000


def _files_per_arrival(raw):
    """One file of a small table; of a large one so many that a batch is read by many tasks."""
    return raw.count() // _ROWS_PER_ARRIVING_FILE + 1


def _arrive(rows, path, files):
    rows.repartition(files).write.mode("append").parquet(path)


@query(
    "I2",
    f"WITH RECURSIVE {_ACCEPTED}\n"
    "SELECT DISTINCT cpf AS cpf_protected, nome FROM p",
)
def stream_with_unique_keys(spark, sf_dir):
    """Every customer arrives three times: twice in one stream, then in one with a new checkpoint."""
    root = fresh_path(spark, "stream-keys")
    raw = rough_table(spark, sf_dir).select("id", "nome", *_INTAKE)
    files = _files_per_arrival(raw)
    for part in range(3):
        _arrive(raw.filter(F.col("id") % 3 == part), f"{root}/in", files)
    _arrive(raw, f"{root}/in", files)
    for state in ("state", "state-again"):
        stream = read_stream(spark, f"{root}/in", raw.schema, maxFilesPerTrigger=files)
        protect_stream(
            stream, f"{root}/accepted", f"{root}/rejected", f"{root}/{state}", DEMO_KEYS, unique=True
        ).awaitTermination()
    return spark.read.parquet(f"{root}/accepted").select("cpf_protected", "nome")


@query(
    "I2",
    f"WITH RECURSIVE {_ACCEPTED}\n"
    "SELECT DISTINCT cpf AS cpf_protected, nome FROM p",
)
def stream_unique_across_restarts(spark, sf_dir):
    """One checkpoint, started three times; what came before comes again, late, with what is new."""
    root = fresh_path(spark, "stream-restarts")
    raw = rough_table(spark, sf_dir).select("id", "nome", *_INTAKE)
    files = _files_per_arrival(raw)
    for arriving in ("id % 4 = 0", "id % 4 < 2", "id >= 0"):
        _arrive(raw.filter(arriving), f"{root}/in", files)
        stream = read_stream(spark, f"{root}/in", raw.schema, maxFilesPerTrigger=files)
        protect_stream(
            stream, f"{root}/accepted", f"{root}/rejected", f"{root}/state", DEMO_KEYS, unique=True
        ).awaitTermination()
    return spark.read.parquet(f"{root}/accepted").select("cpf_protected", "nome")


_EVENT_CPFS = (
    f"users AS (SELECT DISTINCT user_id AS id, {X.cpf_of('user_id')} AS cpf FROM events),\n"
    "v AS (SELECT id, 'ff-cpf' AS name, CAST(cpf AS BIGINT) AS x, 11 AS n FROM users),\n"
    f"{X.ff3_ctes(DEMO_KEYS, ['ff-cpf'], 'v', 'e')}"
)


@query(
    "I2",
    f"WITH RECURSIVE {_EVENT_CPFS}\nSELECT y AS cpf_protected FROM e",
)
def stream_unique_within_watermark(spark, sf_dir):
    """One event per encrypted CPF, over the whole event table read as a stream."""
    root = fresh_path(spark, "stream-unique")
    schema = table(spark, sf_dir, "events").schema
    events = read_stream(spark, sf_dir, schema, pathGlobFilter="events.parquet")
    keyed = events.select(F.col("ts").cast("timestamp").alias("ts"), customer_cpf("user_id").alias("cpf"))
    safe = stored_names(protect(keyed, P.ProtectionPolicy.of("cpf"), DEMO_KEYS))
    run = (
        first_per_key(safe, "ts", "35 days")
        .select("cpf_protected")
        .writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query(
    "I1",
    f"WITH RECURSIVE {_EVENT_CPFS}\nSELECT event_id, y AS cpf_protected, event_type FROM events "
    "JOIN e ON e.id = user_id",
)
def protect_event_stream(spark, sf_dir):
    """A stream protected straight into a Parquet sink, no state kept."""
    root = fresh_path(spark, "stream-events")
    schema = table(spark, sf_dir, "events").schema
    events = read_stream(spark, sf_dir, schema, pathGlobFilter="events.parquet")
    keyed = events.select("event_id", customer_cpf("user_id").alias("cpf"), "event_type")
    run = protect_append(
        keyed, f"{root}/out", f"{root}/state", DEMO_KEYS, P.ProtectionPolicy.of("cpf")
    )
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out")


_WITHIN = timedelta(hours=6)


def _event_pairs_sql() -> str:
    met = "abs(date_diff('microsecond', v.ts, p.ts)) <= 6 * 3600 * 1000000::BIGINT"
    return (
        f"WITH u AS (SELECT *, {X.cpf_of('user_id')} AS cpf FROM events),\n"
        f"w AS (SELECT *, {X.token('cpf', 'tok-conta')} AS token FROM u)\n"
        "SELECT v.token AS token, v.event_id AS view_id, p.event_id AS purchase_id FROM "
        f"(SELECT * FROM w WHERE event_type = 'view') v JOIN "
        f"(SELECT * FROM w WHERE event_type = 'purchase') p ON v.token = p.token AND {met}"
    )


@query("D1 I1", _event_pairs_sql())
def join_event_streams(spark, sf_dir):
    """Views and purchases of the same customer at most six hours apart, as two streams of files."""
    root = fresh_path(spark, "stream-pairs")
    sides = {}
    for kind, key, time in (("view", "view_id", "viewed"), ("purchase", "purchase_id", "bought")):
        rows = table(spark, sf_dir, "events").filter(F.col("event_type") == kind).select(
            F.col("event_id").alias(key), F.col("ts").cast("timestamp").alias(time), customer_cpf("user_id").alias("conta")
        )
        # files of ten days each, oldest first, as they would arrive
        for part in range(3):
            day = F.dayofmonth(time)
            arriving = rows.filter((day > 10 * part) & ((day <= 10 * part + 10) | F.lit(part == 2)))
            arriving.coalesce(1).write.mode("append").parquet(f"{root}/{kind}")
        arrived = read_stream(spark, f"{root}/{kind}", rows.schema, maxFilesPerTrigger=1)
        safe = protect(arrived, P.ProtectionPolicy.of("conta"), DEMO_KEYS)
        sides[kind] = safe.withColumnRenamed("conta", "token")
    pairs = join_streams(
        sides["view"], sides["purchase"], "token", "viewed", "bought", _WITHIN, timedelta(days=11)
    )
    run = (
        pairs.select("token", "view_id", "purchase_id")
        .writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
    )
    with state_on_disk(spark):
        run = run.start()
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query(
    "I2",
    f"WITH RECURSIVE {_EVENT_CPFS}\n"
    "SELECT min(event_id) AS id, y AS cpf_protected FROM events JOIN e ON e.id = user_id "
    "WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' "
    "AND o_orderstatus = 'F') GROUP BY y",
)
def keys_not_stored_yet(spark, sf_dir):
    """Against a stored table: the first event of every user who has no urgent, filled order."""
    policy = P.ProtectionPolicy.of("cpf")
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), customer_cpf("user_id").alias("cpf")
    )
    urgent = table(spark, sf_dir, "orders").filter(
        "o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"
    )
    known = urgent.select(customer_cpf("o_custkey").alias("cpf"))
    return only_new(
        stored_names(protect(events, policy, DEMO_KEYS)),
        stored_names(protect(known, policy, DEMO_KEYS)),
    )


@query(
    "F7",
    f"WITH RECURSIVE {X.PEOPLE},\n{X.ROUGH},\n"
    f"{X.protected('rough', X.columns('cpf'), 'p', otherwise='NULL')}\n"
    "SELECT id, cpf AS cpf_protected FROM p",
)
def rows_without_key_stay(spark, sf_dir):
    """Every customer twice: of those with a CPF one stays, without a usable one all do, once each here."""
    raw = rough_table(spark, sf_dir).select("id", "cpf")
    safe = stored_names(protect(raw, P.customer_policy, DEMO_KEYS, on_error="null"))
    again = safe.filter("cpf_protected is not null").withColumn("id", F.col("id") + 1_000_000)
    none = spark.createDataFrame([(None,)], "cpf_protected string")
    return only_new(safe.unionByName(again), none)


# ---- retrofit --------------------------------------------------------------

_STAGED = ["id", "nome", *retrofit.RAW_TO_PROTECTED.values(), "protected"]


@query("E8", X.retrofitted(f"SELECT {', '.join(_STAGED)} FROM retrofitted"))
def retrofit_table(spark, sf_dir):
    version = fresh_path(spark, "version")
    return retrofit.retrofit(stored_staging(spark, sf_dir), version, DEMO_KEYS).select(*_STAGED)


@query("E8", X.retrofitted(f"SELECT {', '.join(_STAGED)} FROM retrofitted"))
def retrofit_by_file(spark, sf_dir):
    """A stored table whose files are protected in part; only files with unprotected rows are written."""
    staged = stored_staging(spark, sf_dir)
    done = retrofit.protect_in_place(staged, DEMO_KEYS)
    early = (F.col("id") % 3 == 0).alias("early")
    mixed = done.filter(early).unionByName(staged.filter(~early))
    customers_table = VersionedTable(spark, fresh_path(spark, "versioned"))
    customers_table.create(mixed)
    retrofit.retrofit_files(customers_table, DEMO_KEYS)
    return customers_table.read().select(*_STAGED)


@query(
    "E8",
    "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_changed FROM customer",
)
def retrofit_twice(spark, sf_dir):
    once = retrofitted(spark, sf_dir)
    twice = retrofit.protect_in_place(once, DEMO_KEYS)
    key = F.xxhash64(*once.columns)
    before = once.select("id", key.alias("before"))
    after = twice.select("id", key.alias("after"))
    return before.join(after, "id", "full").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("n_changed"),
    )


@query(
    "E11",
    X.retrofitted(
        "SELECT id, nome, cpf_protected, email_masked, saude_token, protected FROM retrofitted"
    ),
)
def drop_raw_columns(spark, sf_dir):
    table_ = retrofitted(spark, sf_dir)
    safe = retrofit.drop_raw(table_, DEMO_KEYS, stored_token_map(spark, sf_dir))
    assert not [c for c in safe.columns if c.endswith("_raw")]
    return safe.select("id", "nome", "cpf_protected", "email_masked", "saude_token", "protected")


# ---- verification ----------------------------------------------------------

_REVERSIBLE = {
    f: p for f, p in retrofit.PAIRS.items() if P.transformation(p[1]).reversible
}


def _per_column(names, *measures: str) -> str:
    """One row per raw column; {c} stands for the raw column."""
    return " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", " + ", ".join(m.format(c=n) for m in measures) + " FROM retrofitted"
        for n in names
    )


_VALUES = "count(*) FILTER (WHERE coalesce(trim({c}) <> '', FALSE)) AS n_values"


@query(
    "G3",
    X.retrofitted(_per_column(_REVERSIBLE, _VALUES, "CAST(0 AS BIGINT) AS n_mismatch")),
)
def round_trip(spark, sf_dir):
    return verify.round_trip_report(
        retrofitted(spark, sf_dir), _REVERSIBLE, DEMO_KEYS, stored_token_map(spark, sf_dir)
    )


def _convergence_sql() -> str:
    rows = []
    for raw, protected in retrofit.RAW_TO_PROTECTED.items():
        rows.append(
            f"SELECT '{raw}' AS \"column\", count(*) AS n_pairs, count(DISTINCT r) AS n_raw, "
            f"count(DISTINCT p) AS n_protected, count(*) = count(DISTINCT r) AS deterministic, "
            f"count(*) = count(DISTINCT p) AS injective FROM (SELECT DISTINCT {raw} AS r, "
            f"{protected} AS p FROM retrofitted WHERE coalesce(trim({raw}) <> '', FALSE))"
        )
    return X.retrofitted(" UNION ALL ".join(rows))


@query("G4", _convergence_sql())
def convergence(spark, sf_dir):
    return verify.convergence_report(retrofitted(spark, sf_dir), retrofit.RAW_TO_PROTECTED)


_OUTPUTS = list(retrofit.RAW_TO_PROTECTED.values())


@query(
    "G5",
    X.retrofitted(
        _per_column(
            retrofit.RAW_TO_PROTECTED,
            _VALUES,
            "count(*) FILTER (WHERE coalesce(trim({c}) <> '', FALSE) AND ("
            + " OR ".join(f"coalesce(contains({o}, {{c}}), FALSE)" for o in _OUTPUTS)
            + ")) AS n_leaks",
        )
    ),
)
def leaks_in_rows(spark, sf_dir):
    return verify.leak_report(
        retrofitted(spark, sf_dir), list(retrofit.RAW_TO_PROTECTED), _OUTPUTS
    )


@query(
    "G5",
    X.retrofitted(
        "SELECT DISTINCT c AS \"column\", v AS value FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS c, {c} AS v FROM retrofitted" for c in retrofit.RAW_TO_PROTECTED
        )
        + ") WHERE coalesce(trim(v) <> '', FALSE) AND v IN ("
        + " UNION ALL ".join(
            f"SELECT {o} FROM retrofitted WHERE {o} IS NOT NULL" for o in (*_OUTPUTS, "raca_raw")
        )
        + ")"
    ),
)
def leaks_across_rows(spark, sf_dir):
    """Raw values found anywhere in the outputs; one raw column is let through on purpose."""
    return verify.leaked_values(
        retrofitted(spark, sf_dir), list(retrofit.RAW_TO_PROTECTED), [*_OUTPUTS, "raca_raw"]
    )


_NOTES_SQL = (
    "notes AS (SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 THEN left(text, 700) || coalesce(p.cpf, '') || "
    "substr(text, 701) WHEN d.doc_id % 5 = 1 THEN text || '<' || coalesce(p.email, '') || '>' "
    "ELSE text END AS text FROM documents d LEFT JOIN people p ON p.id = d.doc_id)"
)


@query(
    "G5",
    f"WITH RECURSIVE {X.PEOPLE}, {_NOTES_SQL}, "
    "v AS (SELECT DISTINCT c AS \"column\", v AS value FROM (SELECT 'cpf' AS c, cpf AS v FROM people UNION ALL "
    "SELECT 'email', email FROM people) WHERE coalesce(trim(v) <> '', FALSE)), "
    "t AS (SELECT 'documents' AS \"table\", CAST(doc_id AS VARCHAR) AS key, 'text' AS shown_in, text FROM notes "
    "UNION ALL SELECT 'customers', CAST(id AS VARCHAR), 'endereco', endereco FROM people "
    "UNION ALL SELECT 'customers', CAST(id AS VARCHAR), 'nome', 'x' || email || cpf FROM people WHERE id % 50 = 0) "
    "SELECT \"table\", key, shown_in, \"column\", value, CAST(strpos(text, value) AS INTEGER) AS start, "
    "CAST((length(text) - length(replace(text, value, ''))) // length(value) AS BIGINT) AS n "
    "FROM t JOIN v ON contains(text, value)",
)
def leaks_inside_other_texts(spark, sf_dir):
    """Values of any row inside longer texts: notes that hold a CPF or an address, names with both."""
    raw = people(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").join(raw.select(F.col("id").alias("doc_id"), "cpf", "email"), "doc_id", "left")
    cpf, email = (F.coalesce(c, F.lit("")) for c in ("cpf", "email"))
    notes = docs.withColumn(
        "text",
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.left("text", F.lit(700)), cpf, F.substr("text", F.lit(701))))
        .when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit("<"), email, F.lit(">")))
        .otherwise(F.col("text")),
    )
    named_badly = raw.filter("id % 50 = 0").withColumn("nome", F.concat(F.lit("x"), "email", "cpf"))
    texts = leaks.all_outputs(
        leaks.output_texts(notes, "doc_id", ["text"], "documents"),
        leaks.output_texts(raw, "id", ["endereco"], "customers"),
        leaks.output_texts(named_badly, "id", ["nome"], "customers"),
    )
    return leaks.leaks_anywhere(leaks.raw_values(raw, ["cpf", "email"]), texts)


@query(
    "G6",
    X.retrofitted(
        _per_column(retrofit.RAW_TO_PROTECTED, _VALUES, "CAST(0 AS BIGINT) AS n_bad_format")
    ),
)
def formats(spark, sf_dir):
    return verify.format_report(retrofitted(spark, sf_dir), retrofit.PAIRS)


def _before_after_sql() -> str:
    rows = []
    for raw, p in retrofit.RAW_TO_PROTECTED.items():
        rows.append(
            f"SELECT '{raw}' AS \"column\", count(*) FILTER (WHERE {raw} <> {p}) AS n_changed, "
            f"count(*) FILTER (WHERE {raw} = {p}) AS n_unchanged, "
            f"count(*) FILTER (WHERE {raw} IS NULL AND {p} IS NULL) AS n_null, "
            "CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_added "
            "FROM retrofitted"
        )
    return X.retrofitted(" UNION ALL ".join(rows))


# the retrofitted table with damage that the checks must count
_DAMAGE = {
    "cpf_protected": ("id % 50 = 3", "'00000000000'"),
    "saude_token": ("id % 60 = 7", "CAST(NULL AS STRING)"),
    "email_masked": ("id % 70 = 5", "'plain'"),
}
_LOST_ROWS = "id % 90 = 11"


def _damaged(spark, sf_dir):
    whole = retrofitted(spark, sf_dir).filter(f"NOT {_LOST_ROWS}")
    return whole.withColumns(
        {
            c: F.expr(f"CASE WHEN {where} THEN {wrong} ELSE {c} END")
            for c, (where, wrong) in _DAMAGE.items()
        }
    )


def _damage_sql(names, hit: dict[str, str], measure: str) -> str:
    """Per raw column: values that are left, and those of them that ``hit`` names as wrong."""
    rows = [
        f"SELECT '{c}' AS \"column\", {_VALUES.format(c=c)}, count(*) FILTER (WHERE "
        f"{X.has_value(c)} AND {hit.get(c, 'FALSE')}) AS {measure} FROM retrofitted WHERE NOT {_LOST_ROWS}"
        for c in names
    ]
    return X.retrofitted(" UNION ALL ".join(rows))


_CPF_HIT, _SAUDE_HIT, _EMAIL_HIT = (where for where, _ in _DAMAGE.values())


@query("G3", _damage_sql(_REVERSIBLE, {"cpf_raw": _CPF_HIT, "saude_raw": _SAUDE_HIT}, "n_mismatch"))
def round_trip_of_damaged_table(spark, sf_dir):
    return verify.round_trip_report(
        _damaged(spark, sf_dir), _REVERSIBLE, DEMO_KEYS, stored_token_map(spark, sf_dir)
    )


@query(
    "G6",
    _damage_sql(
        retrofit.RAW_TO_PROTECTED, {"email_raw": _EMAIL_HIT, "saude_raw": _SAUDE_HIT}, "n_bad_format"
    ),
)
def formats_of_damaged_table(spark, sf_dir):
    return verify.format_report(_damaged(spark, sf_dir), retrofit.PAIRS)


@query(
    "G8",
    X.retrofitted(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE here AND {c} IS NOT NULL AND "
            f"{X.has_value(c)} AND NOT ({_SAUDE_HIT if c == 'saude_raw' else 'FALSE'})) AS n_changed, "
            f"count(*) FILTER (WHERE here AND {c} IS NOT NULL AND NOT {X.has_value(c)}) AS n_unchanged, "
            f"count(*) FILTER (WHERE here AND {c} IS NULL) AS n_null, count(*) FILTER (WHERE here AND "
            f"{c} IS NOT NULL AND {_SAUDE_HIT if c == 'saude_raw' else 'FALSE'}) AS n_lost, "
            "count(*) FILTER (WHERE NOT here) AS n_missing, CAST(0 AS BIGINT) AS n_added "
            f"FROM (SELECT *, NOT {_LOST_ROWS} AS here FROM retrofitted)"
            for c in retrofit.RAW_TO_PROTECTED
        )
    ),
)
def before_and_after_damage(spark, sf_dir):
    return verify.before_after_report(
        stored_staging(spark, sf_dir), _damaged(spark, sf_dir), retrofit.RAW_TO_PROTECTED
    )


@query(
    "E8",
    f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE {_CPF_HIT.replace('id', 'c_custkey')}) "
    "AS n_changed, CAST(0 AS BIGINT) AS n_wrong FROM customer",
)
def retrofit_mends_unprotected_rows(spark, sf_dir):
    """Rows that were damaged and marked as not protected are made again, and only these."""
    whole = retrofitted(spark, sf_dir)
    hit = F.expr(_CPF_HIT)
    broken = whole.withColumns(
        {
            "cpf_protected": F.when(hit, F.lit("0" * 11)).otherwise(F.col("cpf_protected")),
            "protected": F.col("protected") & ~hit,
        }
    )
    mended = retrofit.protect_in_place(broken, DEMO_KEYS)
    key = F.xxhash64("cpf_protected", "email_masked", "saude_token", "protected")
    was, is_, due = (
        df.select("id", key.alias(name))
        for df, name in ((broken, "was"), (mended, "is"), (whole, "due"))
    )
    return was.join(is_, "id", "full").join(due, "id", "full").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("was").eqNullSafe(F.col("is"))).alias("n_changed"),
        F.count_if(~F.col("is").eqNullSafe(F.col("due"))).alias("n_wrong"),
    )


@query("G8", _before_after_sql())
def before_and_after(spark, sf_dir):
    return verify.before_after_report(
        stored_staging(spark, sf_dir), retrofitted(spark, sf_dir), retrofit.RAW_TO_PROTECTED
    )


# ---- grants and legal coverage ---------------------------------------------


def _policy_values() -> str:
    return ", ".join(
        f"('{f}', '{t}', '{P.transformation(t).kind}', {P.transformation(t).reversible}, "
        + (f"'{P.LEGAL_ARTICLES[f]}'" if f in P.LEGAL_ARTICLES else "CAST(NULL AS VARCHAR)")
        + ")"
        for f, t in P.FIELD_TRANSFORMATIONS.items()
    )


_HELD = " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER (WHERE {X.has_value(f)}) AS n_values FROM rough"
    for f in P.FIELD_TRANSFORMATIONS
)
_COVERAGE = (
    f"WITH {X.PEOPLE},\n{X.ROUGH},\nheld AS ({_HELD}),\n"
    "policy(field, transformation, kind, reversible, legal_article) AS "
    f"(VALUES {_policy_values()})"
)


@query(
    "G9",
    f"{_COVERAGE}\nSELECT field, transformation, kind, reversible, legal_article, n_values "
    "FROM policy JOIN held USING (field)",
)
def legal_coverage(spark, sf_dir):
    return audit.legal_coverage(rough_people(spark, sf_dir))


def _grant_case(role: str) -> str:
    names = ", ".join(f"'{n}'" for n in P.ENCODE_GRANTS[role]) or "NULL"
    decode = "reversible" if role == "core-role" else "FALSE"
    return (
        f"CASE WHEN transformation IN ({names}) AND {decode} THEN 'encode+decode' "
        f"WHEN transformation IN ({names}) THEN 'encode' ELSE '-' END AS \"{role}\""
    )


@query(
    "G1",
    f"{_COVERAGE}\nSELECT field, transformation, n_values, "
    f"{', '.join(_grant_case(r) for r in P.ENCODE_GRANTS)} FROM policy JOIN held USING (field)",
)
def grant_matrix(spark, sf_dir):
    return audit.grant_matrix(rough_people(spark, sf_dir))
