"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veladura.session import fresh_path


def ship(module: str) -> None:
    """Let the functions of a module travel inside the job: executors need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task writes where their number is known before.
ROWS_PER_FILE = 200_000


def cut(df: DataFrame, label: str, rows: int | None = None, gather: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a lost executor costs no recomputing.

    ``rows`` says about how many narrow rows there are; then there are as many files as
    they are worth, rather than one for each partition of the shuffle before.  ``gather``
    sends them there by a shuffle, for rows that are costly to compute: as many tasks as
    before compute them.
    """
    path = fresh_path(df.sparkSession, label)
    if rows is not None:
        files = rows // ROWS_PER_FILE + 1
        df = df.repartition(files) if gather else df.coalesce(files)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(
    df: DataFrame,
    schema: str,
    prepare: Callable[[], Callable[[dict[str, list]], dict[str, list]]],
    rows: int = 256,
) -> DataFrame:
    """Apply a function of columns (as lists) to slices of at most ``rows`` rows.

    ``prepare`` runs once per task and returns that function; what it returns may
    have another number of rows than its input.  Small slices bound memory where
    texts are long.
    """
    target = StructType.fromDDL(schema)
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = None
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                if function is None:
                    function = prepare()
                out = function(batch.slice(start, rows).to_pydict())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, target)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def with_text_value(
    df: DataFrame, name: str, kind: str, prepare: Callable[[], Callable[[str | None], object]]
) -> DataFrame:
    """All columns as they are, and what a function makes of the column ``text``."""
    target = StructType(df.schema.fields + StructType.fromDDL(f"`{name}` {kind}").fields)
    arrow = to_arrow_schema(target)
    place = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = None
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                if function is None:
                    function = prepare()
                part = batch.slice(start, 1024)
                made = [function(t) for t in part.column(place).to_pylist()]
                own = [c.cast(f.type) for c, f in zip(part.columns, arrow)]
                added = pa.array(made, type=arrow.field(len(own)).type)
                yield pa.RecordBatch.from_arrays([*own, added], schema=arrow)

    return df.mapInArrow(run, target)
