"""Tables of protected customers: Parquet, catalog tables and JDBC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veladura.functions.tokens import PREFIX
from veladura.operators.protect import named
from veladura.schemas import STAGING, STORED_CUSTOMER
from veladura.session import TIMES_WITH_STATISTICS, fresh_path, settings

ROWS_PER_BUCKET, MOST_BUCKETS = 1_000_000, 10_000
ROWS_PER_FILE = 2_000_000


def read_table(spark: SparkSession, where: str) -> DataFrame:
    """A catalog table by name, or Parquet by path."""
    return spark.read.parquet(where) if "/" in where else spark.table(where)


def read_jdbc(
    spark: SparkSession, url: str, table: str, low: int, high: int, parts: int, **options: str
) -> DataFrame:
    """A database table, read in id ranges by as many tasks; filters are pushed down."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn="id",
            lowerBound=low,
            upperBound=high,
            numPartitions=parts,
            **options,
        )
        .load()
    )


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    with settings(df.sparkSession, TIMES_WITH_STATISTICS):
        df.write.mode(mode).parquet(path)


def _write_ranges(
    df: DataFrame, path: str, key: str, lead: Column, leads: int, files: int
) -> None:
    """Write equal ranges of an evenly spread ``lead`` (0 to ``leads``) to files of their own."""
    place = F.call_function("div", lead * files, F.lit(leads)).cast("int")
    # rows without a usable key are found by no search: they go anywhere, evenly
    anywhere = F.pmod(F.xxhash64(*[named(c) for c in df.columns]), F.lit(files)).cast("int")
    place = F.coalesce(place, anywhere)
    sought = [c for c in (key, "id") if c in df.columns]
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in sought}
    placed = df.repartitionById(files, place).sortWithinPartitions(named(key))
    with settings(df.sparkSession, TIMES_WITH_STATISTICS):
        placed.write.mode("overwrite").options(**blooms).parquet(path)


def write_clustered(
    df: DataFrame, path: str, key: str = "cpf_protected", files: int | None = None
) -> None:
    """Store a table so that equality searches on an encrypted ``key`` skip nearly all of it.

    Encrypted digits are spread evenly, so equal ranges of them are equal shares of
    the rows and need no sampling pass.  A search is led to one file by the file's
    smallest and largest key, and inside it by row-group statistics and a bloom filter.
    Ids are scattered over the files; a search by id has bloom filters only.
    Without ``files``, the rows are counted, which needs none of the columns.
    """
    files = files or df.count() // ROWS_PER_FILE + 1
    lead = F.rpad(F.left(named(key), F.lit(9)), 9, "0").try_cast("bigint")
    _write_ranges(df, path, key, lead, 10**9, files)


def write_token_map(token_map: DataFrame, path: str, files: int | None = None) -> None:
    """Store a token map in the same way, by the leading digits of its tokens.

    Without ``files``, as many as a shuffle has partitions: counting the entries
    would mean building the map twice.
    """
    files = files or int(token_map.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lead = F.conv(F.substring("token", len(PREFIX) + 1, 7), 16, 10).cast("bigint")
    _write_ranges(token_map, path, "token", lead, 16**7, files)


def with_stamps(df: DataFrame) -> DataFrame:
    return df.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})


def with_new_ids(
    df: DataFrame, key: str, after: Column, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Consecutive ids that follow ``after``, in an order fixed by ``key``.

    Keys must be unique (of rows without one any order will do).  Rows are numbered
    inside hash buckets, as many as the row count asks for but ``MOST_BUCKETS`` at most,
    and each bucket starts where the ones before it end.  So no task sees much more
    than a bucket, what is broadcast is bounded, and a task that is run again gives the
    same ids.  The rows are stored first: their cipher runs once, however often they
    are read here.
    """
    path = fresh_path(df.sparkSession, "numbered")
    df.write.parquet(path)
    df = df.sparkSession.read.schema(df.schema).parquet(path)
    buckets = min(df.count() // rows_per_bucket + 1, MOST_BUCKETS)
    whole = F.xxhash64(*[named(c) for c in df.columns])
    spread = F.when(named(key).isNull(), whole).otherwise(F.xxhash64(named(key)))
    bucketed = df.withColumn("_bucket", F.pmod(spread, F.lit(buckets)))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(  # one row per bucket
        "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_bucket").orderBy(named(key))
    numbered = bucketed.join(F.broadcast(starts), "_bucket").withColumn(
        "id", after + F.col("_start") + F.row_number().over(inside)
    )
    return numbered.select("id", *[named(c) for c in df.columns if c != "id"])


def last_id(stored: DataFrame) -> Column:
    return stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).scalar()


def prepare_append(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming protected rows as they will be stored: new ids, times, column order."""
    numbered = with_new_ids(incoming, "cpf_protected", last_id(stored))
    stamped = with_stamps(numbered)
    return stamped.select(
        *[
            (named(f.name) if f.name in stamped.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in STORED_CUSTOMER
        ]
    )


def append_rows(rows: DataFrame, path: str) -> None:
    write_parquet(rows, path, "append")


def create_staging(spark: SparkSession, path: str) -> None:
    """An empty staging table in place of whatever was there."""
    spark.createDataFrame([], STAGING).write.mode("overwrite").parquet(path)


def staging_rows(raw: DataFrame) -> DataFrame:
    """Raw customers in the shape of the staging table, not protected yet."""
    named_raw = {f.name.removesuffix("_raw") for f in STAGING if f.name.endswith("_raw")}
    columns = []
    for f in STAGING:
        field = f.name.removesuffix("_raw")
        if f.name.endswith("_raw") and field in named_raw and field in raw.columns:
            value = named(field)
        elif f.name in ("id", "nome"):
            value = named(f.name)
        elif f.name == "protected":
            value = F.lit(False)
        elif f.name == "created_at":
            value = F.current_timestamp()
        else:
            value = F.lit(None)
        columns.append(value.cast(f.dataType).alias(f.name))
    return raw.select(*columns)
