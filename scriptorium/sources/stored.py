"""Tables of rows under keys, changed by batches and kept in versions.

A table is Parquet dealt over buckets by a hash of the key. A change writes the buckets that it touches
anew and names them, with the others as they were, in the next version's list; files are never
changed. The list is moved to its name in one step that fails where the name is taken, so of two
writers one loses; it looks whether the winner touched its buckets, works them out again only then, and
tries the next name. Readers name a version, or get the last one, and are not disturbed.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
TRIES = 20
_BUCKET = "_bucket"
DELETED = "_deleted"
_local = threading.Lock()  # the local file system's move looks and moves in two steps


class VersionTaken(RuntimeError):
    """Another writer made the version that this one was to be."""


class _Files:
    """The few file operations that a table's lists need, in whatever store Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        conf = spark._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.system = self.path(self.root).getFileSystem(conf)
        self.gateway = spark.sparkContext._gateway
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), conf)

    def names(self, folder: str) -> list[str]:
        at = self.path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self.system.listStatus(at)) if self.system.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(f"{self.root}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """The file under a name that must be free; whether it was."""
        draft = self.path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        out = self.system.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.system.mkdirs(self.path(f"{self.root}/{name}").getParent())
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.NONE
        target = self.system.makeQualified(self.path(f"{self.root}/{name}"))
        try:
            with _local:
                self.context.rename(self.system.makeQualified(draft), target, options)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            self.system.delete(draft, False)
            return False

    def remove(self, name: str) -> None:
        self.system.delete(self.path(f"{self.root}/{name}"), True)


@dataclass(frozen=True)
class Version:
    """What one version's list says: where each bucket's rows are, and what made it."""

    number: int
    key: tuple[str, ...]
    buckets: int
    schema: str
    places: dict[int, str]
    operation: str

    def text(self) -> str:
        return json.dumps({"key": self.key, "buckets": self.buckets, "schema": self.schema, "places": self.places, "operation": self.operation})


def _same(rows: DataFrame, keys: DataFrame, key: tuple[str, ...]) -> Column:
    """Rows and keys (``_k0`` and so on) that are equal, nulls to nulls."""
    return reduce(Column.__and__, (rows[k].eqNullSafe(keys[f"_k{i}"]) for i, k in enumerate(key)))


class StoredTable:
    """A table under ``root``; see the module's text. Keys may be null and are compared null-safe."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._files = _Files(spark, root)

    # Reading -----------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._files.names("versions") if n.endswith(".json")]

    def exists(self) -> bool:
        return bool(self.versions())

    def at(self, number: int | None = None) -> Version:
        """A version's list; the last one's without a number."""
        there = self.versions()
        if not there or (number is not None and number not in there):
            raise FileNotFoundError(f"{self.root} has no version {'' if number is None else number}".rstrip())
        number = there[-1] if number is None else number
        own = json.loads(self._files.read(f"versions/{number:012d}.json"))
        return Version(number, tuple(own["key"]), own["buckets"], own["schema"], {int(b): p for b, p in own["places"].items()}, own["operation"])

    def read(self, number: int | None = None) -> DataFrame:
        return self._rows(self.at(number))

    def matching(self, keys: DataFrame, number: int | None = None) -> DataFrame:
        """Rows of the keys asked for; only the buckets that these fall into are read."""
        version = self.at(number)
        own = keys.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(version.key)], self._bucket(version)).distinct()
        rows = self._rows(version, [r[0] for r in own.select(_BUCKET).distinct().collect()])
        return rows.join(own, _same(rows, own, version.key), "left_semi")

    def history(self) -> DataFrame:
        """``(version, operation, buckets)``: what made each version, and how many buckets it wrote anew."""
        rows, before = [], {}
        for n in self.versions():
            own = self.at(n)
            rows.append((n, own.operation, sum(before.get(b) != p for b, p in own.places.items()) + sum(b not in own.places for b in before)))
            before = own.places
        return self.spark.createDataFrame(rows, "version long, operation string, buckets long")

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """Rows of the later version that the earlier one lacks as they are, and the earlier one's that are gone (``change``: new, gone).

        Only buckets that differ are read.
        """
        a, b = self.at(since), self.at(until)
        differ = [k for k in {*a.places, *b.places} if a.places.get(k) != b.places.get(k)]
        old, new = self._rows(a, differ), self._rows(b, differ)
        return new.exceptAll(old).withColumn("change", F.lit("new")).union(old.exceptAll(new).withColumn("change", F.lit("gone")))

    def _rows(self, version: Version, buckets: list[int] | None = None) -> DataFrame:
        own = sorted(p for b, p in version.places.items() if buckets is None or b in buckets)
        if not own:
            return self.spark.createDataFrame([], version.schema)
        return self.spark.read.schema(version.schema).parquet(*[f"{self.root}/{p}" for p in own])

    # Writing -----------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, root: str, rows: DataFrame, key: list[str] | str, buckets: int = BUCKETS) -> StoredTable:
        """A new table of ``rows``, one a key, as version 0."""
        table = cls(spark, root)
        key = (key,) if isinstance(key, str) else tuple(key)
        if missing := set(key) - set(rows.columns):
            raise ValueError(f"no column {sorted(missing)} to be the key")
        if {_BUCKET, DELETED} & {c.lower() for c in rows.columns}:
            raise ValueError(f"{_BUCKET} and {DELETED} are the table's own columns")
        table._check(rows, key)
        schema = StructType([type(f)(f.name, f.dataType, True) for f in rows.schema.fields])
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        empty = Version(-1, key, buckets, ddl, {}, "")
        if not table._commit(Version(0, key, buckets, ddl, table._write(rows, empty), "create")):
            raise VersionTaken(f"{root} is a table already")
        return table

    def merge(self, changes: DataFrame, operation: str = "merge", expect: int | None = None) -> int:
        """Rows put in place of those of their keys; those with ``_deleted`` true go. The version made.

        ``changes`` has a row a key and the table's columns (others are left out, missing ones are null). With
        ``expect`` the change is only made to that version, else :class:`VersionTaken`; without,
        a change that another writer came before is worked out again on what that one left.
        """
        version = self.at()
        changes = changes if DELETED in changes.columns else changes.withColumn(DELETED, F.lit(False))
        self._check(changes, version.key)
        names = [f.name for f in self._fields(version)]
        types = {f.name: f.dataType for f in self._fields(version)}
        own = changes.select(*[(F.col(n) if n in changes.columns else F.lit(None)).cast(types[n]).alias(n) for n in names], F.coalesce(DELETED, F.lit(False)).alias(DELETED))
        touched = [r[0] for r in own.select(self._bucket(version)).distinct().collect()]
        written, base = None, None
        for _ in range(TRIES):
            if expect is not None and version.number != expect:
                raise VersionTaken(f"{self.root} is at version {version.number}, not {expect}")
            if base is None or any(base.places.get(b) != version.places.get(b) for b in touched):
                written, base = self._write(self._merged(version, own, touched), version), version
            places = {b: p for b, p in version.places.items() if b not in touched} | written
            if self._commit(Version(version.number + 1, version.key, version.buckets, version.schema, places, operation)):
                return version.number + 1
            version = self.at()
        raise VersionTaken(f"{self.root} was changed {TRIES} times meanwhile")

    def delete(self, keys: DataFrame, operation: str = "delete") -> int:
        return self.merge(keys.select(*self.at().key).distinct().withColumn(DELETED, F.lit(True)), operation)

    def replace(self, rows: DataFrame, operation: str = "replace") -> int:
        """All rows given up for others, as one version."""
        version = self.at()
        self._check(rows, version.key)
        places = self._write(rows.select(*[f.name for f in self._fields(version)]), version)
        while not self._commit(Version(version.number + 1, version.key, version.buckets, version.schema, places, operation)):
            version = self.at()
        return version.number + 1

    def restore(self, number: int) -> int:
        """An earlier version's rows as the next version; nothing is copied."""
        old, last = self.at(number), self.at()
        while not self._commit(Version(last.number + 1, old.key, old.buckets, old.schema, old.places, f"restore {number}")):
            last = self.at()
        return last.number + 1

    def forget(self, before: int) -> int:
        """Versions before one given up with the files that only they have; how many files' folders went."""
        there = self.versions()
        kept = {p for n in there if n >= before or n == there[-1] for p in self.at(n).places.values()}
        gone = {p for n in there if n < before and n != there[-1] for p in self.at(n).places.values()} - kept
        for n in there:
            if n < before and n != there[-1]:
                self._files.remove(f"versions/{n:012d}.json")
        for place in gone:
            self._files.remove(place)
        return len(gone)

    def _fields(self, version: Version) -> list:
        return self.spark.createDataFrame([], version.schema).schema.fields

    def _bucket(self, version: Version) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in version.key]), F.lit(version.buckets)).cast("int").alias(_BUCKET)

    def _check(self, rows: DataFrame, key: tuple[str, ...]) -> None:
        if again := rows.groupBy(*key).count().where("count > 1").first():
            raise ValueError(f"{again['count']} rows of the key {[again[k] for k in key]}")

    def _merged(self, version: Version, own: DataFrame, touched: list[int]) -> DataFrame:
        keys = own.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(version.key)])
        old = self._rows(version, touched)
        return old.join(keys, _same(old, keys, version.key), "left_anti").unionByName(own.where(~F.col(DELETED)).drop(DELETED))

    def _write(self, rows: DataFrame, version: Version) -> dict[int, str]:
        place = f"data/{uuid.uuid4().hex}"
        dealt = rows.withColumn(_BUCKET, self._bucket(version))
        writer = dealt.repartition(version.buckets, _BUCKET).write.partitionBy(_BUCKET)
        for k in version.key:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.parquet(f"{self.root}/{place}")
        return {int(n.partition("=")[2]): f"{place}/{n}" for n in self._files.names(place) if n.startswith(f"{_BUCKET}=")}

    def _commit(self, version: Version) -> bool:
        return self._files.write_new(f"versions/{version.number:012d}.json", version.text())
