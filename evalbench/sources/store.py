"""Versioned tables of write-once folders in a shared file system, for results that several writers add to.

A commit writes its rows with Spark into folders of their own and then puts a manifest in place: a small JSON file, named
by the version, that lists the folders of every table. It is written under another name and renamed without overwriting,
so a version is there as a whole or not at all; a writer that dies leaves the last version and some folders that nothing
names, which ``vacuum`` removes. Of two writers of one version the second is refused and starts from the new one. A
manifest holds a hash of itself, which is checked when it is read. Old versions stay readable until they are vacuumed.

The file system has to refuse a rename onto an existing name, as HDFS and local folders do.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Taken(RuntimeError):
    """Another writer has committed the version first."""


class Store:
    """Tables (name -> DDL schema) under one sequence of versions, from 0 (nothing)."""

    def __init__(self, spark: SparkSession, base: str, tables: dict[str, str]):
        self.spark, self.base, self.tables = spark, base.rstrip("/"), tables
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.system = self._path("").getFileSystem(self.conf)
        self.system.mkdirs(self._path("log"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self.system.listStatus(self._path("log")))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "action": "", "folders": {name: [] for name in self.tables}}
        stream = self.system.open(self._path(f"log/{version:012d}.json"))
        try:
            found = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        own = found.pop("hash", None)
        if own != _hash(found) or found["version"] != version:
            raise ValueError(f"the manifest of version {version} has changed")
        return found

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table at a version, the last one unless given."""
        folders = self.manifest(version)["folders"].get(table, [])
        schema = self.tables[table]
        return self.spark.read.schema(schema).parquet(*[f"{self.base}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def commit(self, parent: int, action: str, add: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None) -> int:
        """The next version after ``parent``: rows added to tables, or put in place of all of a table's rows."""
        folders = {name: list(old) for name, old in self.manifest(parent)["folders"].items()}
        for rows, whole in ((add or {}, False), (replace or {}, True)):
            for table, df in rows.items():
                folder = f"data/{table}-{uuid.uuid4().hex}"
                wanted = self.spark.createDataFrame([], self.tables[table]).schema
                df.select(*[F.col(f.name).cast(f.dataType) for f in wanted]).write.parquet(f"{self.base}/{folder}", compression="zstd")
                folders[table] = [folder] if whole else [*folders.get(table, []), folder]
        found = {"version": parent + 1, "action": action, "folders": folders}
        self._put(f"log/{parent + 1:012d}.json", json.dumps(found | {"hash": _hash(found)}, sort_keys=True))
        return parent + 1

    def _put(self, name: str, text: str) -> None:
        draft, target = self._path(f"log/.draft-{uuid.uuid4().hex}"), self._path(name)
        out = self.system.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.system.makeQualified(draft), self.system.makeQualified(target), none)
        except Exception as error:  # whatever the file system throws: what counts is whether the version is there
            self.system.delete(draft, False)
            if self.system.exists(target):
                raise Taken(name) from error
            raise

    def retried(self, change: Callable[[int], int], times: int = 5) -> int:
        """``change`` of the last version, again from the new one whenever another writer was first."""
        for left in reversed(range(times)):
            try:
                return change(self.version())
            except Taken:
                if not left:
                    raise
        raise AssertionError

    def insert(self, table: str, rows: DataFrame, key: list[str]) -> int:
        """Add rows by key: one that is stored with the same content is left out, one with other content raises."""

        def change(parent: int) -> int:
            known = self.read(table, parent)
            content = lambda df: F.xxhash64(*[F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns) if c not in key]), {"ignoreNullFields": "false"})])
            other = known.select(*key, content(known).alias("__was")).join(rows.select(*key, content(rows).alias("__is")), key).where("__was <> __is").select(*key).limit(5).collect()
            if other:
                raise ValueError(f"{table}: stored with other content: {[tuple(r) for r in other]}")
            fresh = rows.join(known.select(*key), key, "left_anti")
            return self.commit(parent, f"insert {table}", {table: fresh}) if not fresh.isEmpty() else parent

        return self.retried(change)

    def upsert(self, table: str, rows: DataFrame, key: list[str]) -> int:
        """Rows by key, in place of stored ones."""

        def change(parent: int) -> int:
            kept = self.read(table, parent).join(rows.select(*key), key, "left_anti")
            return self.commit(parent, f"upsert {table}", replace={table: kept.unionByName(rows.select(*kept.columns))})

        return self.retried(change)

    def compact(self, table: str) -> int:
        """One folder for a table of many; the rows stay the same."""
        return self.retried(lambda parent: self.commit(parent, f"compact {table}", replace={table: self.read(table, parent)}))

    def vacuum(self, keep: int = 1) -> int:
        """Delete manifests but the last ``keep``, and folders that no kept one names; not while others write."""
        versions = self.versions()
        kept = versions[-keep:]
        named = {f for v in kept for folders in self.manifest(v)["folders"].values() for f in folders}
        gone = [f"log/{v:012d}.json" for v in versions if v not in kept]
        if self.system.exists(self._path("data")):
            gone += [f"data/{s.getPath().getName()}" for s in self.system.listStatus(self._path("data")) if f"data/{s.getPath().getName()}" not in named]
        for name in gone:
            self.system.delete(self._path(name), True)
        return len(gone)


def _hash(found: dict) -> str:
    return hashlib.sha256(json.dumps(found, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
