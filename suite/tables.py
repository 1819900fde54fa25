"""Sources, sinks, projections, lookups, aggregates and constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import expected as X
from suite.data import (
    DEMO_KEYS,
    created_at,
    people,
    purchases,
    retrofitted,
    rough_people,
    rough_table,
    stored,
    stored_for_lookups,
    stored_staging,
    table,
    to_store,
)
from suite.registry import query
from veladura import policy as P
from veladura import schemas
from veladura.operators import audit, lookup, validate, views
from veladura.operators.protect import (
    protect,
    protect_observed,
    protectable,
    protection_report,
    summarize,
)
from veladura.operators.reveal import reveal
from veladura.plans.create import stored_projection
from veladura.plans.retrofit import apply_updates
from veladura.session import fresh_path
from veladura.sources import tables as sources
from veladura.sources.csv_text import read_csv, write_csv
from veladura.sources.synthetic import customer_cpf, customers

_EPOCH = "CAST(epoch(created_at) AS BIGINT) AS created_at"


def _epoch(df, *names):
    return df.withColumns({n: F.unix_timestamp(n) for n in names or ("created_at",)})


# ---- sources and sinks -----------------------------------------------------

_CSV_FIELDS = ("nome", "cpf", "email", "telefone", "pan", "dob", "endereco", "conta")


@query(
    "A1",
    X.people(
        "SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 9 = 0 THEN NULL ELSE nome END AS nome, "
        "cpf, email, pan, nullif(endereco, '') AS endereco FROM people"
    ),
)
def csv_scan(spark, sf_dir):
    path = fresh_path(spark, "csv")
    raw = people(spark, sf_dir).select("id", "nome", "cpf", "email", "pan", "endereco")
    raw = raw.withColumn("nome", F.when(F.col("id") % 9 == 0, F.lit("N/A")).otherwise(F.col("nome")))
    write_csv(raw, path)
    return read_csv(spark, path, raw.columns)


@query(
    "A3",
    X.people(
        "SELECT CAST(id AS VARCHAR) AS id, nome || ', \"' || raca || '\"' || chr(10) || cpf AS nome, "
        "CASE WHEN endereco = '' THEN NULL ELSE endereco END AS endereco FROM people"
    ),
)
def csv_sink(spark, sf_dir):
    """Separators, quotes and line breaks inside values."""
    path = fresh_path(spark, "csv-quoted")
    quoted = F.concat("nome", F.lit(', "'), "raca", F.lit('"\n'), "cpf").alias("nome")
    write_csv(people(spark, sf_dir).select("id", quoted, "endereco"), path)
    return read_csv(spark, path, na_values=(), multi_line=True)


_MASKED = X.columns("email", "dob", "conta")


@query(
    "A4",
    f"WITH {X.PEOPLE},\n{X.protected('people', _MASKED, 'p')}\nSELECT id, email, dob, conta FROM p",
)
def parquet_sink(spark, sf_dir):
    path = fresh_path(spark, "parquet")
    safe = protect(
        people(spark, sf_dir).select("id", *_MASKED), P.ProtectionPolicy(_MASKED), DEMO_KEYS
    )
    sources.write_parquet(safe, path)
    return spark.read.parquet(path)


@query(
    "A6",
    X.stored(
        "SELECT id, nome, cpf_protected, email_masked, telefone_protected, pan_protected, "
        f"cvv_masked, dob_masked, endereco_token, conta_token, {_EPOCH}, "
        "CAST(epoch(updated_at) AS BIGINT) AS updated_at FROM stored"
    ),
)
def stored_table_scan(spark, sf_dir):
    return _epoch(stored(spark, sf_dir), "created_at", "updated_at")


_BOTH = "(SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier)"


@query(
    "A7",
    "SELECT count(*) AS n_rows, count(*) AS n_ids, (SELECT min(c_custkey) FROM customer) AS first_id, "
    "CAST((SELECT max(c_custkey) FROM customer) + (SELECT count(*) FROM supplier) AS BIGINT) "
    f"AS last_id, count(*) AS n_cpfs, CAST(0 AS BIGINT) AS n_without_time FROM {_BOTH}",
)
def append_with_new_ids(spark, sf_dir):
    """All suppliers become customers too: under new ids that follow the stored ones."""
    path = fresh_path(spark, "append")
    sources.write_parquet(to_store(people(spark, sf_dir)), path)
    already = sources.read_table(spark, path)
    # keys far from those of customers, so that nobody shares a CPF
    others = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 500_000_000).alias("k"))
    incoming = to_store(customers(others, "k")).drop("id", "created_at", "updated_at")
    sources.append_rows(sources.prepare_append(already, incoming), path)
    return sources.read_table(spark, path).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("id").alias("n_ids"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.countDistinct("cpf_protected").alias("n_cpfs"),
        F.count_if(F.col("created_at").isNull() | F.col("updated_at").isNull()).alias(
            "n_without_time"
        ),
    )


@query(
    "A8 A9",
    X.people(
        "SELECT id, nome, cpf AS cpf_raw, email AS email_raw, saude AS saude_raw, "
        "CAST(NULL AS VARCHAR) AS cpf_protected, FALSE AS protected FROM people"
    ),
)
def staging_bulk_load(spark, sf_dir):
    path = fresh_path(spark, "staging-load")
    sources.create_staging(spark, path)
    sources.append_rows(sources.staging_rows(people(spark, sf_dir)), path)
    return spark.read.parquet(path).select(
        "id", "nome", "cpf_raw", "email_raw", "saude_raw", "cpf_protected", "protected"
    )


@query("A10", X.people("SELECT id, nome, cpf, email, telefone, pan, dob, endereco FROM people"))
def synthetic_customers(spark, sf_dir):
    return people(spark, sf_dir).select(
        "id", "nome", "cpf", "email", "telefone", "pan", "dob", "endereco"
    )


@query("A11", X.people("SELECT * FROM people"))
def synthetic_customers_in_full(spark, sf_dir):
    return people(spark, sf_dir)


@query(
    "A12 F6",
    X.rough(
        "SELECT count(*) AS attempted, count(*) FILTER (WHERE ok) AS inserted FROM (SELECT "
        + " AND ".join(
            f"coalesce({X.fits(c, n)} OR ({c} IS NOT NULL AND trim({c}) = ''), TRUE)"
            for c, n in X.columns("cpf", "email", "telefone", "pan", "dob").items()
        )
        + " AND nome IS NOT NULL AND cpf IS NOT NULL AND email IS NOT NULL AS ok FROM rough)"
    ),
)
def seed_customers(spark, sf_dir):
    """Protect and insert; a row with any value that cannot be protected is not inserted."""
    raw = rough_table(spark, sf_dir).select(
        "id", "nome", "cpf", "email", "telefone", "pan", "dob", "endereco"
    )
    clean = protectable(P.customer_policy.resolve(raw.columns))
    for c in schemas.REQUIRED_FIELDS:
        clean = clean & F.col(c).isNotNull()
    safe = protect(raw.filter(clean), P.customer_policy, DEMO_KEYS)
    path = fresh_path(spark, "seeded")
    stamped = sources.with_stamps(views.stored_names(safe))
    sources.append_rows(stored_projection(stamped), path)
    inserted = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).scalar()
    return raw.agg(F.count(F.lit(1)).alias("attempted")).withColumn("inserted", inserted)


# ---- projections -----------------------------------------------------------

_B1 = X.columns("email", "dob", "conta")


@query(
    "B1",
    f"WITH {X.PEOPLE},\n{X.protected('people', _B1, 'p')}\n"
    'SELECT id, email AS "EMAIL", dob AS "Dob", conta AS "Conta" FROM p',
)
def detect_columns_by_name(spark, sf_dir):
    raw = people(spark, sf_dir).select(
        "id", F.col("email").alias("EMAIL"), F.col("dob").alias("Dob"), F.col("conta").alias("Conta")
    )
    return protect(raw, P.batch_policy, DEMO_KEYS)


_B2 = {"cpf": "ff-cpf", "email": "mask-email", "pan": "ff-pan", "endereco": "tok-endereco"}


@query(
    "B2",
    f"WITH RECURSIVE {X.PEOPLE},\n{X.protected('people', _B2, 'p', keep='s.nome')}\n"
    "SELECT id, nome, cpf, email, pan, endereco FROM p",
)
def explicit_field_map(spark, sf_dir):
    policy = P.ProtectionPolicy.parse("cpf:ff-cpf, email:mask-email, pan:ff-pan, endereco:tok-endereco")
    raw = people(spark, sf_dir).select("id", "nome", *_B2)
    return protect(raw, policy, DEMO_KEYS, role="pipeline-role")


@query("B3", X.people(f"SELECT id, {X.mask_email('email')} AS email, raca FROM people"))
def absent_columns_skipped(spark, sf_dir):
    raw = people(spark, sf_dir).select("id", "email", "raca")
    return protect(raw, P.customer_policy, DEMO_KEYS, role="core-role")


@query(
    "B4",
    "SELECT c_custkey, c_acctbal, c_name AS comment, "
    f"{X.mask_name('c_name')} AS nome, c_nationkey, c_mktsegment FROM customer",
)
def other_columns_pass(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_acctbal",
        F.col("c_name").alias("comment"),
        F.col("c_name").alias("nome"),
        "c_nationkey",
        "c_mktsegment",
    )
    return protect(raw, P.customer_policy, DEMO_KEYS)


@query(
    "B5",
    X.stored(
        "SELECT id, nome, cpf_protected, email_masked, telefone_protected, pan_protected, "
        "cvv_masked, dob_masked, endereco_token, conta_token FROM stored"
    ),
)
def rename_to_stored(spark, sf_dir):
    raw = people(spark, sf_dir).select(
        "id", "nome", "cpf", "email", "telefone", "pan", "cvv", "dob", "endereco", "conta"
    )
    return views.stored_names(protect(raw, P.keep_name_policy, DEMO_KEYS))


@query(
    "B6",
    f"WITH RECURSIVE {X.PEOPLE},\n{X.protected('people', X.columns('pan'), 'p')}\n"
    "SELECT id, pan FROM p",
)
def optional_fields_stay_null(spark, sf_dir):
    return protect(people(spark, sf_dir).select("id", "pan"), P.customer_policy, DEMO_KEYS)


@query(
    "B8",
    X.stored(
        "SELECT id, 'sim' AS tem_cpf, CASE WHEN pan_protected IS NULL THEN 'não' ELSE 'sim' END "
        "AS tem_pan, CASE WHEN endereco_token IS NULL THEN 'não' ELSE 'sim' END AS tem_endereco, "
        f"'sim' AS tem_conta, {_EPOCH}, CAST(epoch(updated_at) AS BIGINT) AS updated_at FROM stored"
    ),
)
def audit_view(spark, sf_dir):
    return _epoch(views.audit_view(stored(spark, sf_dir)), "created_at", "updated_at")


_DISPLAY = (
    "id, nome, '***.***.' || substr(cpf_protected, 7, 3) || '-' || right(cpf_protected, 2) "
    "AS cpf_display, email_masked, '(' || left(telefone_protected, 2) || ') *****-' "
    "|| right(telefone_protected, 4) AS telefone_display, "
    "'**** **** **** ' || right(pan_protected, 4) AS pan_display, dob_masked, endereco_token, "
    + _EPOCH
)


@query("B9", X.stored(f"SELECT {_DISPLAY} FROM stored"))
def display_record(spark, sf_dir):
    return _epoch(views.display(stored(spark, sf_dir)))


@query(
    "B11 F10",
    X.people(
        f"SELECT id, nome, {X.CPF_FORMATTED.format(c='cpf')} AS cpf, email, telefone, "
        "substr(pan, 1, 4) || ' ' || substr(pan, 5, 4) || ' ' || substr(pan, 9, 4) || ' ' || "
        "substr(pan, 13, 4) AS pan, dob, saude, raca, religiao FROM people ORDER BY id LIMIT 50"
    ),
)
def before_view(spark, sf_dir):
    return views.before_view(stored_staging(spark, sf_dir), 50)


@query(
    "B12",
    X.retrofitted(
        f"SELECT id, nome, {X.CPF_FORMATTED.format(c='cpf_protected')} AS cpf, email_masked AS email, "
        "substr(pan_protected, 1, 4) || ' ' || substr(pan_protected, 5, 4) || ' ' || "
        "substr(pan_protected, 9, 4) || ' ' || substr(pan_protected, 13, 4) AS pan, "
        "left(saude_token, 24) AS saude, left(raca_token, 20) AS raca, "
        "left(religiao_token, 20) AS religiao FROM retrofitted ORDER BY id LIMIT 50"
    ),
)
def after_view(spark, sf_dir):
    return views.after_view(retrofitted(spark, sf_dir), 50)


@query(
    "B13",
    X.stored(
        "SELECT nome, cpf_protected, email_masked, pan_protected FROM stored ORDER BY id LIMIT 10"
    ),
)
def column_listing(spark, sf_dir):
    return views.columns_of(
        stored(spark, sf_dir), "nome", "cpf_protected", "email_masked", "pan_protected", limit=10
    )


# ---- lookups ---------------------------------------------------------------


@query("C4", X.stored(f"SELECT {_DISPLAY} FROM stored WHERE id = 42"))
def get_by_id(spark, sf_dir):
    return _epoch(views.display(lookup.by_id(stored(spark, sf_dir), 42)))


@query(
    "C5",
    X.stored(f"SELECT {_DISPLAY} FROM stored WHERE id = 1"),
)
def find_by_cpf(spark, sf_dir):
    found = lookup.find_by_cpf(stored(spark, sf_dir), "123.464.708-72", DEMO_KEYS)
    return _epoch(views.display(found))


@query(
    "C4 C5 F8",
    X.stored(
        f"(SELECT 'id' AS found_by, {_DISPLAY} FROM stored WHERE id = 42) UNION ALL "
        f"(SELECT 'cpf', {_DISPLAY} FROM stored WHERE id = 1) UNION ALL "
        f"(SELECT 'time', {_DISPLAY} FROM stored s ORDER BY s.created_at DESC, id LIMIT 20)"
    ),
)
def lookups_on_one_layout(spark, sf_dir):
    """By id, by encrypted key and by time, each reading few row groups of the same table."""
    held = stored_for_lookups(spark, sf_dir)
    found = {
        "id": lookup.by_id(held, 42),
        "cpf": lookup.find_by_cpf(held, "123.464.708-72", DEMO_KEYS),
        "time": lookup.newest(held),
    }
    parts = [views.display(df).select(F.lit(by).alias("found_by"), "*") for by, df in found.items()]
    return _epoch(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(
    "C6",
    X.stored(
        "SELECT id, nome, cpf_protected FROM stored s WHERE EXISTS "
        "(SELECT 1 FROM orders WHERE o_custkey = s.id AND o_orderpriority = '1-URGENT')"
    ),
)
def find_many_by_cpf(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    wanted = purchases_of(urgent).select("cpf").distinct()
    found = lookup.find_many(stored(spark, sf_dir), wanted, DEMO_KEYS)
    return found.select("id", "nome", "cpf_protected")


def purchases_of(orders):
    return orders.select("o_orderkey", customer_cpf("o_custkey").alias("cpf"))


@query("C7", X.people("SELECT id, cpf AS cpf_raw FROM people WHERE raca <> 'grupo três'"))
def not_yet_protected(spark, sf_dir):
    return lookup.unprotected(stored_staging(spark, sf_dir)).select("id", "cpf_raw")


@query(
    "C8",
    X.retrofitted("SELECT id, cpf_protected, saude_token FROM retrofitted WHERE raca_raw = 'grupo três'"),
)
def only_protected(spark, sf_dir):
    done = lookup.already_protected(stored_staging(spark, sf_dir))
    return done.select("id", "cpf_protected", "saude_token")


@query(
    "C13",
    X.rough(
        "SELECT id, CASE WHEN nome IS NULL THEN 'missing nome' WHEN cpf IS NULL THEN 'missing cpf' "
        "WHEN email IS NULL THEN 'missing email' WHEN telefone IS NULL THEN 'missing telefone' "
        "WHEN NOT regexp_matches(translate(cpf, '.-', ''), '^[0-9]{11}$') THEN 'invalid cpf' "
        "WHEN pan IS NOT NULL AND NOT regexp_matches(translate(pan, ' -', ''), '^[0-9]{13,16}$') "
        "THEN 'invalid pan' END AS rejected FROM rough"
    ),
)
def rejection_reason(spark, sf_dir):
    return validate.with_rejection(rough_people(spark, sf_dir)).select("id", "rejected")


_FITTED = X.columns("cpf", "pan", "telefone", "email", "dob", "cvv")


@query(
    "C12",
    X.rough(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", '{n}' AS transformation, count(*) FILTER (WHERE "
            f"{X.has_value(c)} AND {X.fits(c, n)}) AS n_fit, count(*) FILTER (WHERE "
            f"{X.has_value(c)} AND NOT {X.fits(c, n)}) AS n_misfit FROM rough"
            for c, n in _FITTED.items()
        )
    ),
)
def template_counts(spark, sf_dir):
    return validate.template_report(rough_people(spark, sf_dir), _FITTED)


@query(
    "C13",
    X.rough(
        "SELECT f AS \"column\", count(*) FILTER (WHERE v IS NULL) AS n_missing FROM (SELECT "
        "unnest(['nome', 'cpf', 'email', 'telefone']) AS f, unnest([nome, cpf, email, telefone]) "
        "AS v FROM rough) GROUP BY f"
    ),
)
def missing_required(spark, sf_dir):
    return validate.missing_report(rough_people(spark, sf_dir))


# ---- aggregates, listings, constraints -------------------------------------


@query("F1", "SELECT count(*) AS n_rows FROM customer")
def row_count(spark, sf_dir):
    return stored(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"))


def _counts(fields: dict[str, str], source: str = "rough") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS c, '{n}' AS t, '{P.transformation(n).kind}' AS kind, "
        f"count(*) AS records, count(*) FILTER (WHERE {X.has_value(c)}) AS n_values, "
        f"count(*) FILTER (WHERE {X.has_value(c)} AND NOT {X.fits(c, n)}) AS n_errors FROM {source}"
        for c, n in fields.items()
    )


_COUNTED = X.columns("cpf", "pan", "telefone", "email", "dob", "endereco", "conta")


@query(
    "F2 E2",
    X.rough(
        "SELECT max(records) AS records, CAST(count(*) AS BIGINT) AS fields_protected, "
        "CAST(sum(n_values) AS BIGINT) AS values, CAST(sum(n_errors) AS BIGINT) "
        f"AS errors FROM ({_counts(_COUNTED)})"
    ),
)
def run_counters(spark, sf_dir):
    """Counted by the job that protects and writes, not by another pass."""
    raw = rough_people(spark, sf_dir).select("id", *_COUNTED)
    safe, counts = protect_observed(raw, P.batch_policy, DEMO_KEYS)
    sources.write_parquet(safe, fresh_path(spark, "observed"))
    summary = summarize(counts.get)
    return spark.createDataFrame(
        [tuple(summary.values())], ", ".join(f"{name} bigint" for name in summary)
    )


@query(
    "F3",
    X.rough(
        'SELECT records, c AS "column", t AS transformation, kind, n_values, n_errors '
        f"FROM ({_counts(_COUNTED)})"
    ),
)
def column_counts(spark, sf_dir):
    return protection_report(rough_people(spark, sf_dir).select("id", *_COUNTED), P.batch_policy)


@query(
    "F4",
    X.rough(
        "SELECT t AS transformation, kind, CAST(sum(n_values) AS BIGINT) AS n_values, "
        f"CAST(sum(n_errors) AS BIGINT) AS n_errors FROM ({_counts(_COUNTED)}) GROUP BY t, kind"
    ),
)
def transformation_report(spark, sf_dir):
    raw = rough_people(spark, sf_dir).select("id", *_COUNTED)
    return audit.transformation_report(raw, P.batch_policy).drop("total_seconds")


_RACE_TOKENS = f"""SELECT {X.token('raca', 'tok-raca')} AS raca, count(*) AS n_rows
  FROM people GROUP BY raca"""


@query("F5", X.people(_RACE_TOKENS))
def category_counts(spark, sf_dir):
    raw = people(spark, sf_dir).select("raca")
    safe = protect(raw, P.ProtectionPolicy.of("raca"), DEMO_KEYS)
    return audit.category_counts(safe, "raca")


_BUYERS = (
    "v AS (SELECT id, 'ff-cpf' AS name, CAST(cpf AS BIGINT) AS x, 11 AS n FROM people)"
)


@query(
    "F7",
    f"WITH RECURSIVE {X.PEOPLE},\n{_BUYERS},\n{X.ff3_ctes(DEMO_KEYS, ['ff-cpf'], 'v', 'e')}\n"
    "SELECT e.y AS cpf_protected, count(*) AS n FROM orders JOIN e ON e.id = o_custkey "
    "GROUP BY e.y HAVING count(*) > 1",
)
def repeated_keys(spark, sf_dir):
    """Buyers that occur more than once among the orders, by encrypted CPF."""
    safe = protect(purchases(spark, sf_dir).select("cpf"), P.customer_policy, DEMO_KEYS)
    return validate.duplicate_keys(views.stored_names(safe))


@query(
    "F7",
    f"WITH RECURSIVE {X.PEOPLE},\n{_BUYERS},\n{X.ff3_ctes(DEMO_KEYS, ['ff-cpf'], 'v', 'e')}\n"
    "SELECT min(o_orderkey) AS o_orderkey, e.y AS cpf_protected FROM orders "
    "JOIN people p ON p.id = o_custkey JOIN e ON e.id = o_custkey "
    "WHERE p.nome <> 'Olívia dos Reis Tavares' GROUP BY e.y",
)
def upsert_new_keys(spark, sf_dir):
    """First purchase of each buyer who is not among the stored ones (those of one name)."""
    known = stored(spark, sf_dir).filter("nome = 'Olívia dos Reis Tavares'")
    raw = purchases(spark, sf_dir).select("o_orderkey", "cpf")
    safe = views.stored_names(protect(raw, P.customer_policy, DEMO_KEYS))
    return validate.only_new(safe, known)


@query(
    "F8",
    X.stored(f"SELECT {_DISPLAY} FROM stored s ORDER BY s.created_at DESC, id LIMIT 20"),
)
def newest_customers(spark, sf_dir):
    return _epoch(views.display(lookup.newest(stored(spark, sf_dir))))


@query(
    "F9",
    X.stored(f"SELECT {_DISPLAY} FROM stored s ORDER BY s.created_at DESC, id LIMIT 20"),
)
def newest_in_support_view(spark, sf_dir):
    return _epoch(lookup.newest(views.support_view(stored(spark, sf_dir))))


@query("F11", X.retrofitted("SELECT id, cpf_raw, cpf_protected FROM retrofitted ORDER BY id LIMIT 1"))
def any_protected_row(spark, sf_dir):
    done = lookup.already_protected(retrofitted(spark, sf_dir))
    return lookup.first_by_id(done).select("id", "cpf_raw", "cpf_protected")


@query(
    "F12",
    X.stored(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", {n} AS max_length, CAST(max(length({c})) AS INTEGER) "
            f"AS longest, count(*) FILTER (WHERE length({c}) > {n}) AS n_too_long FROM stored"
            for c, n in schemas.STORED_LENGTHS.items()
        )
    ),
)
def length_constraints(spark, sf_dir):
    return validate.length_report(stored(spark, sf_dir), schemas.STORED_LENGTHS)


@query(
    "F12",
    X.rough(
        " UNION ALL ".join(
            f"SELECT '{c}_raw' AS \"column\", 14 AS max_length, CAST(max(length({c})) AS INTEGER) "
            f"AS longest, count(*) FILTER (WHERE length({c}) > 14) AS n_too_long FROM rough"
            for c in ("cpf", "telefone", "pan")
        )
    ),
)
def too_long_values(spark, sf_dir):
    rows = sources.staging_rows(rough_people(spark, sf_dir))
    return validate.length_report(rows, {"cpf_raw": 14, "telefone_raw": 14, "pan_raw": 14})


@query(
    "F13",
    X.people(
        "SELECT count(*) AS n_rows, count(*) FILTER (WHERE nome = 'Olívia dos Reis Tavares') AS n_renewed, "
        "count(*) FILTER (WHERE nome <> 'Olívia dos Reis Tavares') AS n_untouched FROM people"
    ),
)
def update_times(spark, sf_dir):
    before = stored(spark, sf_dir)
    changes = before.filter("nome = 'Olívia dos Reis Tavares'").withColumn("nome", F.upper("nome"))
    after = apply_updates(before, changes)
    renewed = F.col("updated_at") > created_at(F.col("id"))
    return after.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(renewed & (F.col("nome") == F.upper("nome"))).alias("n_renewed"),
        F.count_if(~renewed & (F.col("nome") != F.upper("nome"))).alias("n_untouched"),
    )


@query("D3", X.rough("SELECT id, " + ", ".join(f"{X.normalized(c, n)} AS {c}" for c, n in X.columns("rg", "cnh", "cnpj").items()) + " FROM rough"))
def values_stay_in_their_row(spark, sf_dir):
    """Protected and decoded again in one pass: every value is back in its own row."""
    fields = X.columns("rg", "cnh", "cnpj")
    raw = rough_people(spark, sf_dir).select("id", *fields)
    safe = protect(raw, P.customer_policy, DEMO_KEYS, role="core-role")
    return reveal(safe, fields, DEMO_KEYS)


