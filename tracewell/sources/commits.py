"""A store on a shared file system whose versions appear whole: manifests name the folders of each table's rows."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tracewell.schema import SCHEMA_VERSION


class Conflict(RuntimeError):
    """Another writer has published the version that this one wanted to."""


@dataclass(frozen=True)
class Store:
    """One version of a store, and it stays that version: what others publish later is seen by opening it anew.

    Rows are written to folders of their own first (`<table>/part=<name>`); then a manifest that names all
    folders of the new version is moved to its place, which fails where that version is there already. So a writer that
    fails or loses leaves nothing that a reader sees. The move has to be atomic and to refuse an existing target, as
    it is on HDFS.
    """

    spark: SparkSession
    root: str
    version: int = 0
    folders: dict[str, tuple[str, ...]] = field(default_factory=dict)
    properties: dict = field(default_factory=dict)

    @staticmethod
    def open(spark: SparkSession, root: str, version: int | None = None) -> Store:
        """The given version, or the latest; a root without versions is version 0, which has no tables."""
        root = root.rstrip("/")
        if version is None:
            version = max(_versions(spark, root), default=0)
        if version == 0:
            return Store(spark, root)
        _, fs, path = _at(spark, f"{root}/_versions/{version:020d}.json")
        if not fs.exists(path):
            raise ValueError(f"{root} has no version {version}")
        stream = fs.open(path)
        try:
            held = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        if held["schema_version"] > SCHEMA_VERSION:
            raise ValueError(f"tables of version {held['schema_version']} are newer than {SCHEMA_VERSION}")
        return Store(spark, root, version, {k: tuple(v) for k, v in held["tables"].items()}, held["properties"])

    def table(self, name: str) -> DataFrame:
        """All rows of a table in this version."""
        paths = [f"{self.root}/{name}/{f}" for f in self.folders[name]]
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*paths).drop("part")

    def publish(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, properties: dict | None = None, partition_by: dict[str, list[str]] | None = None, version: int | None = None) -> Store:
        """The next version: tables replaced, rows appended to tables, properties set; all else as in this one.

        Conflict where a version after this one has been published meanwhile, whatever it changed: open the
        store anew, and decide again.
        """
        folders = dict(self.folders)
        for change, rows in (((), replace), (None, append)):
            for name, df in (rows or {}).items():
                part = f"part={uuid.uuid4().hex}"
                df.write.partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{self.root}/{name}/{part}")
                folders[name] = (*(folders.get(name, ()) if change is None else change), part)
        new = Store(self.spark, self.root, self.version + 1 if version is None else version, folders, self.properties | (properties or {}))
        _move_in(self.spark, f"{self.root}/_versions", f"{new.version:020d}.json", json.dumps({"schema_version": SCHEMA_VERSION, "parent": self.version, "tables": folders, "properties": new.properties}))
        return new

    def expire(self, keep: int) -> int:
        """Deletes versions before the last keep ones, and the folders that only they name; the number of folders. Readers of those versions must be gone."""
        versions = sorted(_versions(self.spark, self.root))
        old, kept = versions[:-keep] if keep else [], versions[-keep:]
        named = lambda vs: {(t, f) for v in vs for t, fs in Store.open(self.spark, self.root, v).folders.items() for f in fs}
        gone = named(old) - named(kept)
        for v in old:
            _, fs, path = _at(self.spark, f"{self.root}/_versions/{v:020d}.json")
            fs.delete(path, False)
        for t, f in gone:
            _, fs, path = _at(self.spark, f"{self.root}/{t}/{f}")
            fs.delete(path, True)
        return len(gone)


def _at(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return hadoop, p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, root: str) -> list[int]:
    _, fs, path = _at(spark, f"{root}/_versions")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]


def _move_in(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """Writes a file elsewhere and moves it to its name, which must not exist."""
    hadoop, fs, held = _at(spark, f"{folder}/.{uuid.uuid4().hex}.tmp")
    out = fs.create(held)
    out.write(bytearray(text.encode()))
    out.close()
    target = hadoop.Path(f"{folder}/{name}")
    if fs.exists(target):
        fs.delete(held, False)
        raise Conflict(f"{folder}/{name} has been published by another writer")
    files = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        files.rename(fs.makeQualified(held), fs.makeQualified(target), none)
    except Exception as e:
        fs.delete(held, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"{folder}/{name} has been published by another writer") from None
        raise
