"""File-to-file job: read a CSV, protect its personal columns, write a CSV.

    spark-submit --py-files veladura.zip veladura/plans/csv_job.py \
        --input raw/ --output protected/ [--role api-role] \
        [--fields cpf:ff-cpf,email:mask-email] [--generate 200] [--multi-line]

Columns are told by the names in each file's own header, whatever their order.  Values that cannot be protected, and those of columns that the role may not protect,
become ``ERROR`` and are counted; nothing is passed on in clear.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from veladura import policy as P
from veladura.keys import Keyring
from veladura.operators.protect import SENTINEL, protect_observed, summarize
from veladura.sources.csv_text import read_csv, write_csv
from veladura.sources.synthetic import sample_customers

SAMPLE_COLUMNS = ("id", "nome", "cpf", "email", "telefone", "pan", "dob", "endereco")


def protect_csv(
    spark: SparkSession,
    source: str,
    target: str,
    keyring: Keyring,
    policy: P.ProtectionPolicy = P.batch_policy,
    role: str = "pipeline-role",
    on_error: str = SENTINEL,
    mode: str = "errorifexists",
    multi_line: bool | None = None,
) -> dict[str, float]:
    """Protect a CSV; the summary is counted in the job that writes it."""
    raw = read_csv(spark, source, multi_line=multi_line)
    df, counts = protect_observed(raw, policy, keyring, role, on_error, refused_as_errors=True)
    started = time.perf_counter()
    write_csv(df, target, mode)
    seconds = time.perf_counter() - started
    summary = summarize(counts.get)
    return {**summary, "seconds": seconds, "records_per_second": summary["records"] / seconds}


def generate_sample(spark: SparkSession, path: str, n: int = 200) -> None:
    write_csv(sample_customers(spark, n).select(*SAMPLE_COLUMNS), path, "overwrite")


def main(arguments: list[str] | None = None) -> dict[str, float]:
    parser = argparse.ArgumentParser(description="Protect the personal data of a CSV file")
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--role", default="pipeline-role")
    parser.add_argument("--fields", help="column:transformation,… instead of the usual columns")
    parser.add_argument(
        "--multi-line", action=argparse.BooleanOptionalAction, help="line breaks inside quotes, in large files too"
    )
    parser.add_argument("--on-error", choices=["raise", "null", "sentinel"], default=SENTINEL)
    parser.add_argument("--overwrite", action="store_true")
    parser.add_argument("--generate", type=int, metavar="N", help="first write N sample rows")
    given = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("protect-csv").getOrCreate()
    if given.generate:
        generate_sample(spark, given.input, given.generate)
    summary = protect_csv(
        spark,
        given.input,
        given.output,
        Keyring.from_env(),
        P.ProtectionPolicy.parse(given.fields) if given.fields else P.batch_policy,
        given.role,
        given.on_error,
        "overwrite" if given.overwrite else "errorifexists",
        given.multi_line,
    )
    for measure, value in summary.items():
        print(f"{measure}: {value:,.2f}" if isinstance(value, float) else f"{measure}: {value:,}")
    return summary


if __name__ == "__main__":
    main()
