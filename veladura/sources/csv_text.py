"""CSV files in which every column is text, and every value belongs to its header's name."""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veladura.operators.protect import named
from veladura.schemas import all_text

# The texts that the common dataframe readers take for "no value".
USUAL_NA_VALUES = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


#: Files up to this size are one split anyway, so reading them whole costs no tasks.
WHOLE_FILE = 128 * 1024 * 1024
_LONGEST_HEADER = 1 << 20


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and size of the files that hold rows, as Spark's own listing chooses them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    system = pattern.getFileSystem(conf)
    found, pending = [], list(system.globStatus(pattern) or [])
    for status in pending:
        inner = list(system.listStatus(status.getPath())) if status.isDirectory() else [status]
        for file in inner:
            name = file.getPath().getName()
            hidden = file is not status and name.startswith(("_", "."))
            if file.isFile() and file.getLen() and not hidden:
                found.append((file.getPath().toString(), file.getLen()))
    return sorted(found)


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The names in a file's first record; only the file's beginning is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(conf).open(file)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
    reader = jvm.java.io.BufferedReader(
        jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")
    )
    try:
        record = ""
        while (line := reader.readLine()) is not None:
            record += line
            if record.strip() and record.count('"') % 2 == 0:
                break
            if len(record) > _LONGEST_HEADER:
                raise ValueError(f"{path} does not begin with a header")
            record += "\n" if record else ""  # a blank line before the header counts for nothing
    finally:
        reader.close()
    return tuple(next(csv.reader([record.removeprefix("\ufeff")], strict=True), ()))


def _names(path: str, header: tuple[str, ...]) -> tuple[str, ...]:
    names = tuple(h.strip() or f"_c{i}" for i, h in enumerate(header))
    twice = [n for n, k in Counter(n.lower() for n in names).items() if k > 1]
    if twice:
        raise ValueError(f"{path} has more than one column {', '.join(map(repr, sorted(twice)))}")
    return names


def read_csv(
    spark: SparkSession,
    path: str,
    columns: Iterable[str] | None = None,
    na_values: Iterable[str] = USUAL_NA_VALUES,
    multi_line: bool | None = None,
) -> DataFrame:
    """Header, all columns text, empty and ``na_values`` null.

    Values belong to the name that their own file's header gives them: files of one folder
    may differ in the order, number and letter case of their columns.  Files with equal
    headers are one scan; the scans are united by name.  Surrounding blanks of a name do not
    count, columns without a name are ``_c0``, ``_c1``, ... by place, and a name that occurs
    twice in a header (case apart) is refused.  With ``columns`` exactly these are returned;
    a file that lacks one is refused.  Without, all names of all files, null where a file
    does not have them.  Only first lines are read to learn the names.  A missing path
    fails here.  A row with more or fewer values than its header fails when it is read,
    rather than being filled up.

    ``multi_line`` reads line breaks inside quotes.  Such a file cannot be split.  By
    default files up to ``WHOLE_FILE`` bytes, which are not split anyway, are read so, and
    larger ones by lines: there a row with a line break fails as one with too few values,
    and ``multi_line=True`` reads the file in one task.
    """
    spark.read.text(path)  # a missing path fails as it does for any scan
    files = _files(spark, path)
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda f: _header(spark, f[0]), files))
    alike: dict[tuple, list[str]] = {}
    spelled: dict[str, str] = {}  # by lower-case name, as the first file has it
    wanted = None if columns is None else list(columns)
    for (file, size), header in zip(files, headers):
        names = _names(file, header)
        lacking = [c for c in wanted or () if c.lower() not in {n.lower() for n in names}]
        if lacking:
            raise ValueError(f"{file} has no column {', '.join(map(repr, lacking))}")
        for name in names:
            spelled.setdefault(name.lower(), name)
        whole = size <= WHOLE_FILE if multi_line is None else multi_line
        alike.setdefault((header, names, whole), []).append(file)
    out = wanted if wanted is not None else list(spelled.values())
    missing = list(na_values)

    def value(name: str, own: dict[str, str]) -> Column:
        if name.lower() not in own:
            return F.lit(None).cast("string").alias(name)
        held = named(own[name.lower()])
        return (F.when(~held.isin(missing), held) if missing else held).alias(name)

    scans = []
    for (header, names, whole), paths in alike.items():
        reader = spark.read.schema(all_text(*names)).options(
            header=True,
            nullValue="",
            escape='"',
            multiLine=whole,
            mode="FAILFAST",
            # a file that was exchanged meanwhile fails, rather than being read by place
            enforceSchema=header != names,
            columnPruning=False,  # else values that nobody asks for are not counted
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
        own = {n.lower(): n for n in names}
        scans.append(reader.csv(paths).select(*[value(c, own) for c in out]))
    if not scans:
        return spark.createDataFrame([], all_text(*out))
    return reduce(DataFrame.unionByName, scans)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header, every value quoted, blanks kept; a directory with one file per task."""
    df.write.mode(mode).options(
        header=True,
        quoteAll=True,
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)
