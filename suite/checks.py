"""Checks that grow with what is new or damaged: versions, sealed trails."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import expected as X
from suite.data import DEMO_KEYS, retrofitted, stored, stored_token_map
from suite.registry import query
from veladura.operators import audit, sketches, verify
from veladura.operators.difference import Ranges, differences, differing_nodes, leaf_hashes, tree
from veladura.operators.sealed_trail import SealedTrail
from veladura.plans import retrofit
from veladura.session import fresh_path, kept

# ---- two versions of a table -------------------------------------------------

_RENAMED, _DROPPED, _TWICE, _NEW = "id % 97 = 5", "id % 89 = 3", "id % 101 = 7", "id % 83 = 2"
_VERSIONED = ("id", "nome", "cpf_protected", "email_masked", "created_at")
_FAR = 10_000_000_000


def _two_versions(spark, sf_dir):
    """The stored table, and a copy in which a few rows were changed, lost, doubled and added."""
    before = stored(spark, sf_dir).select(*_VERSIONED)
    left = before.filter(f"NOT ({_DROPPED})").withColumns(
        {
            "nome": F.when(F.expr(_RENAMED), None).otherwise(F.col("nome")),
            "email_masked": F.when(F.expr(f"{_RENAMED} AND id % 2 = 0"), "").otherwise(F.col("email_masked")),
        }
    )
    added = before.filter(_NEW).withColumn("id", F.col("id") + _FAR)
    return before, kept(left.unionByName(left.filter(_TWICE)).unionByName(added), "damaged")


@query(
    "G3 G8",
    "WITH c AS (SELECT c_custkey AS id FROM customer)\n"
    f"SELECT id, 'removed' AS change, 1::BIGINT AS n_before, 0::BIGINT AS n_after, NULL AS columns FROM c WHERE {_DROPPED}\n"
    "UNION ALL SELECT id, 'changed', 1, CASE WHEN id % 101 = 7 THEN 2 ELSE 1 END, CASE WHEN id % 101 = 7 THEN NULL "
    f"WHEN id % 2 = 0 THEN 'email_masked,nome' ELSE 'nome' END FROM c WHERE {_RENAMED} AND NOT ({_DROPPED})\n"
    f"UNION ALL SELECT id, 'added', 0, 1, NULL FROM c WHERE {_TWICE} AND NOT ({_DROPPED}) AND NOT ({_RENAMED})\n"
    f"UNION ALL SELECT id + {_FAR}, 'added', 0, 1, NULL FROM c WHERE {_NEW}",
)
def differences_between_versions(spark, sf_dir):
    """Only ranges of ids whose hashes differ are joined; the old version's hashes were stored."""
    before, after = _two_versions(spark, sf_dir)
    ranges = Ranges.of(before, "id", 4096)
    hashes = kept(leaf_hashes(before, ranges), "leaves")
    found = differences(before, after, "id", ranges, hashes)
    return found.withColumn("columns", F.array_join("columns", ","))


_LEAVES, _WIDTH = 256, 10


def _nodes_sql() -> str:
    node = f"least({_LEAVES - 1}, id // {_WIDTH})"
    levels = [
        f"SELECT {level}::INTEGER AS level, CAST({node} // {16**level} AS INTEGER) AS node, "
        "CAST(sum(b) AS BIGINT) AS n_before, CAST(sum(a) AS BIGINT) AS n_after FROM r GROUP BY ALL HAVING bool_or(odd)"
        for level in range(3)
    ]
    return (
        "WITH c AS (SELECT c_custkey AS id FROM customer),\n"
        f"r AS (SELECT id, 1 AS b, CASE WHEN {_DROPPED} THEN 0 WHEN {_TWICE} THEN 2 ELSE 1 END AS a, "
        f"{_DROPPED} OR {_TWICE} OR {_RENAMED} AS odd FROM c\n"
        f"UNION ALL SELECT id + {_FAR}, 0, 1, TRUE FROM c WHERE {_NEW})\n" + "\nUNION ALL ".join(levels)
    )


@query("G3 G8", _nodes_sql())
def ranges_that_differ(spark, sf_dir):
    """Two stored trees, compared level by level."""
    before, after = _two_versions(spark, sf_dir)
    ranges = Ranges("id", 0, _WIDTH, _LEAVES)
    trees = [kept(tree(leaf_hashes(df, ranges), ranges), "tree") for df in (before, after)]
    return differing_nodes(*trees)


# ---- sealed trails -----------------------------------------------------------

_ENTRIES = (
    "entries AS (SELECT id AS key, unnest(['cpf', 'telefone', 'pan', 'endereco', 'conta']) AS \"column\", "
    "unnest([cpf, telefone, pan, endereco, conta]) AS v FROM people)"
)
_ROLE_CHANGED = "key % 50 = 3 AND \"column\" = 'cpf'"
_ENTRY_GONE = "key % 60 = 7 AND \"column\" = 'pan'"


def _sealed(spark, sf_dir, root: str) -> SealedTrail:
    """Two reveals, each of which seals a block."""
    trail = SealedTrail(spark, root, DEMO_KEYS, rows_per_part=1000)
    held, opened = stored(spark, sf_dir), stored_token_map(spark, sf_dir)
    audit.reveal_logged(held, DEMO_KEYS, opened, "dpo", trail)
    audit.reveal_logged(held.filter("id % 2 = 0"), DEMO_KEYS, opened, "auditor", trail)
    return trail


@query(
    "G7",
    f"WITH {X.PEOPLE},\n{_ENTRIES}\n"
    "SELECT 'dpo' AS actor, \"column\", key, 0::BIGINT AS block, 0::BIGINT AS n_findings FROM entries WHERE v IS NOT NULL\n"
    "UNION ALL SELECT 'auditor', \"column\", key, 1, 0 FROM entries WHERE v IS NOT NULL AND key % 2 = 0",
)
def sealed_reveal_trail(spark, sf_dir):
    """A whole trail: its entries, and nothing found wrong."""
    trail = _sealed(spark, sf_dir, fresh_path(spark, "sealed"))
    n = trail.verify(trail.last_seal()).agg(F.count(F.lit(1))).scalar()
    return trail.read().select("actor", "column", "key", "block", n.alias("n_findings"))


@query(
    "G7",
    f"WITH {X.PEOPLE},\n{_ENTRIES}\n"
    "SELECT 0::BIGINT AS block, 'changed' AS finding, key, 1::BIGINT AS n FROM entries "
    f"WHERE v IS NOT NULL AND {_ROLE_CHANGED}\n"
    f"UNION ALL SELECT 0, 'missing', NULL, count(*) FROM entries WHERE v IS NOT NULL AND {_ENTRY_GONE}",
)
def tampered_trail(spark, sf_dir):
    """A copy of the trail in which roles were changed and entries removed: which, and how many."""
    trail = _sealed(spark, sf_dir, fresh_path(spark, "sealed"))
    end, copy = trail.last_seal(), SealedTrail(spark, fresh_path(spark, "tampered"), DEMO_KEYS)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    for part in ("blocks", "heads"):
        hadoop.FileUtil.copy(trail._system(), trail._path(part), copy._system(), copy._path(part), False, conf)
    folder, whole = (trail._block(n)["folder"] for n in (0, 1))
    spark.read.parquet(f"{trail.root}/entries/{whole}").write.parquet(f"{copy.root}/entries/{whole}")
    entries = spark.read.parquet(f"{trail.root}/entries/{folder}")
    role = F.when(F.expr(_ROLE_CHANGED.replace('"', "`")), "api-role").otherwise(F.col("role"))
    kept_entries = entries.withColumn("role", role).filter(f"NOT ({_ENTRY_GONE.replace(chr(34), '`')})")
    kept_entries.write.parquet(f"{copy.root}/entries/{folder}")
    found, place = kept(copy.verify(end), "findings"), ["block", "part", "pos"]
    named_by = copy.read().select(*place, "key")
    changed = found.filter("finding = 'changed'").join(named_by, place).select("block", "finding", "key", "n")
    other = found.filter("finding <> 'changed'").groupBy("block", "finding").agg(F.sum("n").alias("n"))
    return changed.unionByName(other.withColumn("key", F.lit(None).cast("bigint")))


# ---- sketches ----------------------------------------------------------------


def _sketched_sql() -> str:
    rows = [
        f"SELECT '{raw}' AS \"column\", count(DISTINCT id % 7) AS n_parts, count(*) AS n_values, "
        f"count(DISTINCT {raw}) AS n_raw, count(DISTINCT {p}) AS n_protected, "
        f"count(DISTINCT ({raw}, {p})) AS n_pairs, TRUE AS within_bounds, "
        f"count(DISTINCT ({raw}, {p})) = count(DISTINCT {raw}) AS deterministic "
        f"FROM retrofitted WHERE {X.has_value(raw)}"
        for raw, p in retrofit.RAW_TO_PROTECTED.items()
    ]
    return X.retrofitted(" UNION ALL ".join(rows))


@query("G4 F7", _sketched_sql())
def convergence_by_sketches(spark, sf_dir):
    """Seven parts arrive one by one and are sketched; bounds from the sketches against exact counts."""
    rows, path = retrofitted(spark, sf_dir).withColumn("part", F.col("id") % 7), fresh_path(spark, "sketches")
    for part in range(7):
        sketches.add_parts(rows.filter(F.col("part") == part), retrofit.RAW_TO_PROTECTED, "part", path)
    bounds = sketches.convergence_bounds(spark.read.parquet(path))
    exact = verify.convergence_report(rows, retrofit.RAW_TO_PROTECTED)
    kinds = ("n_raw", "n_protected", "n_pairs")
    near = [
        F.abs(F.col(f"s.{k}") - F.col(f"e.{k}")) <= sketches.bound(F.col(f"s.{k}").cast("double")) for k in kinds
    ]
    return bounds.alias("s").join(exact.alias("e"), "column").select(
        "column",
        "n_parts",
        "n_values",
        *[F.col(f"e.{k}").alias(k) for k in kinds],
        (near[0] & near[1] & near[2]).alias("within_bounds"),
        F.col("s.deterministic").alias("deterministic"),
    )
