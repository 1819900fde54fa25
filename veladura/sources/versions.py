"""Tables of plain files that change file by file, version by version.

A table is a folder with ``data`` (files that are never changed) and ``versions``: one
small list per version, naming the files that make it up.  A change reads the keys to find
the files that hold affected rows, writes new files for those alone, and then puts the new
list in place by one rename that fails if that version exists already.  So a reader sees
the old version or the new one, a run that is broken off before the rename changes nothing,
and of two writers that began at the same version the second is refused.

The driver holds names of files, never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from veladura.operators.protect import named
from veladura.operators.validate import duplicate_keys
from veladura.session import kept


class ConflictError(RuntimeError):
    """Another writer has made this version in the meantime."""


@dataclass(frozen=True)
class Version:
    number: int
    schema: StructType
    files: tuple[str, ...]  # below ``data``


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # files

    def _path(self, *below: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *below]))

    def _system(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *below: str) -> list[str]:
        path = self._path(*below)
        if not self._system().exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._system().listStatus(path))

    def _write(self, df: DataFrame) -> tuple[str, ...]:
        """Write rows to new files and name them."""
        folder = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/data/{folder}")
        return tuple(f"{folder}/{n}" for n in self._names("data", folder) if n.startswith("part-"))

    # versions

    def versions(self) -> list[int]:
        return [int(n) for n in self._names("versions") if n.isdigit()]

    def version(self, number: int | None = None) -> Version:
        """The newest version, or an older one."""
        known = self.versions()
        number = (known[-1] if known else 0) if number is None else number
        if number not in known:
            raise FileNotFoundError(f"{self.root} has no version {number}")
        text = self.spark.read.text(f"{self.root}/versions/{number:012d}", wholetext=True).first()[0]
        held = json.loads(text)
        return Version(number, StructType.fromJson(held["schema"]), tuple(held["files"]))

    def _commit(self, version: Version) -> None:
        jvm, draft = self.spark.sparkContext._jvm, f".{uuid.uuid4().hex}"
        out = self._system().create(self._path("versions", draft))
        held = {"schema": version.schema.jsonValue(), "files": version.files}
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._path().toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()
        )
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path("versions", draft), self._path("versions", f"{version.number:012d}"), options)
        except Py4JJavaError as error:
            self._system().delete(self._path("versions", draft), False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                raise ConflictError(f"version {version.number} of {self.root} exists already") from None
            raise

    def _read(self, schema: StructType, files: tuple[str, ...]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{f}" for f in files])

    # use

    def create(self, df: DataFrame) -> Version:
        """The first version."""
        if self.versions():
            raise ConflictError(f"{self.root} is a table already")
        schema = StructType([StructField(f.name, f.dataType) for f in df.schema])
        version = Version(0, schema, self._write(df))
        self._commit(version)
        return version

    def read(self, number: int | None = None) -> DataFrame:
        version = self.version(number)
        return self._read(version.schema, version.files)

    def files_with(self, version: Version, among: Callable[[DataFrame], DataFrame]) -> tuple[str, ...]:
        """The files that hold a row which ``among`` keeps; it should read few columns."""
        rows = self._read(version.schema, version.files)
        if not version.files:
            return ()
        name = F.regexp_extract("_metadata.file_path", "[^/]+/[^/]+$", 0)
        held = among(rows.select("*", name.alias("_file"))).select("_file").distinct()
        return tuple(sorted(r[0] for r in held.collect()))

    def rewrite(self, version: Version, files: tuple[str, ...], change: Callable[[DataFrame], DataFrame]) -> Version:
        """A new version in which ``change`` has been applied to the rows of these files."""
        if not files:
            return version
        changed = change(self._read(version.schema, files))
        changed = changed.select(*[named(f.name).cast(f.dataType).alias(f.name) for f in version.schema])
        stay = tuple(f for f in version.files if f not in set(files))
        new = Version(version.number + 1, version.schema, stay + self._write(changed))
        self._commit(new)
        return new

    def update(self, changes: DataFrame, key: str = "id") -> Version:
        """Replace the rows whose key is in ``changes``; only the files that hold them are rewritten.

        Changed rows get a new ``updated_at``.  Keys that the table does not have are left
        out, two changes for one key are refused.  ``changes`` is computed once.
        """
        version = self.version()
        # a key is needed on both sides, so rows and changes without one stay out of it
        changes = kept(changes.filter(named(key).isNotNull()).select(*version.schema.names), "changes")
        if not duplicate_keys(changes, key).isEmpty():
            raise ValueError(f"several changes for the same {key}")
        keys = changes.select(key)
        files = self.files_with(version, lambda rows: rows.select(key, "_file").join(keys, key, "left_semi"))
        new = F.struct(
            *[F.current_timestamp().alias(c) if c == "updated_at" else named(c) for c in version.schema.names]
        )
        sought = changes.select(named(key).alias("_key"), new.alias("_new"))

        def change(rows: DataFrame) -> DataFrame:
            met = rows.join(sought, named(key) == F.col("_key"), "left")
            return met.select(
                *[
                    F.when(F.col("_key").isNotNull(), F.col("_new")[c]).otherwise(named(c)).alias(c)
                    for c in version.schema.names
                ]
            )

        return self.rewrite(version, files, change)

    def forget(self, before: int) -> None:
        """Remove versions older than ``before`` and all files that no later one has.

        Old versions may hold raw data that a later one has protected.  Files of a writer
        that is still at work would be removed too, so none may be.
        """
        for number in self.versions():
            if number < before and number != self.versions()[-1]:
                self._system().delete(self._path("versions", f"{number:012d}"), False)
        needed = {f for n in self.versions() for f in self.version(n).files}
        for folder in self._names("data"):
            for name in self._names("data", folder):
                if name.startswith("part-") and f"{folder}/{name}" not in needed:
                    self._system().delete(self._path("data", folder, name), False)
