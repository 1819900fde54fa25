"""Times the headline queries and prints one JSON line.

Each query runs to the end into a sink that discards its rows.  The first run warms
the JVM and the Python workers; the reported time is the better of the next two.
Inputs that a query expects to find stored are written before its clock starts.
"""

from __future__ import annotations

import json
import os
import time

from suite import QUERIES
from suite import data as D
from veladura import policy as P
from veladura.operators.protect import protect
from veladura.session import delete_scratch, fresh_path, local_session
from veladura.sources.synthetic import customer_cpf, customer_pan

HEADLINE = (
    "protect_customers",
    "protect_detected_columns",
    "protect_csv_file",
    "protect_by_field_map",
    "encode_and_decode_column",
    "token_encode",
    "masks_with_guard",
    "join_on_protected_key",
    "token_map",
    "detokenize_columns",
    "detokenize_large_map",
    "reveal_stored_customers",
    "find_by_cpf",
    "find_many_by_cpf",
    "newest_customers",
    "support_view",
    "upsert_new_keys",
    "retrofit_table",
    "round_trip",
    "convergence",
    "leaks_across_rows",
    "protect_event_stream",
)


def discard(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def best(run, times: int = 2) -> float:
    seconds = []
    for _ in range(times + 1):
        started = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - started)
    return min(seconds[1:])


def rates(spark, sf_dir: str) -> dict[str, int]:
    """Values per second of each kind of transformation, one per line item."""
    from pyspark.sql import functions as F

    path = fresh_path(spark, "bench-items")  # in as many files as there are cores
    D.table(spark, sf_dir, "lineitem").repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
    items = spark.read.parquet(path).select(
        customer_cpf("l_orderkey").alias("cpf"),
        customer_pan("l_partkey").alias("pan"),
        F.concat(F.lit("Rua "), F.col("l_suppkey").cast("string")).alias("endereco"),
        F.concat(F.lit("cliente."), "l_orderkey", F.lit("@empresa.com.br")).alias("email"),
    )
    n = items.count()
    plain = {c: best(lambda c=c: discard(items.select(c))) for c in items.columns}
    out = {}
    for c in items.columns:
        one = protect(items.select(c), P.customer_policy, D.DEMO_KEYS)
        out[P.FIELD_TRANSFORMATIONS[c]] = round(n / best(lambda one=one: discard(one)))
        out[f"read_{c}"] = round(n / plain[c])
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, partitions=int(cores), memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    for table in (D.rough_table, D.stored, D.stored_token_map, D.stored_staging, D.retrofitted):
        table(spark, sf_dir)
    times = {
        name: round(best(lambda name=name: discard(QUERIES[name].run(spark, sf_dir))), 3)
        for name in HEADLINE
    }
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "values_per_second": rates(spark, sf_dir),
    }
    print(json.dumps(result))
    delete_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
