"""Tables as logs: commits append changes, readers merge them, compaction folds them.

A commit writes one folder of changed rows for each table it touches - new rows and tombstones, which are a
key and a mark - so what it writes is in proportion to the change.  It is published as a record that lists
the folders of every table.  The record's name is the next version's number and is made by an operation
that fails if the name is taken (a hard link on local and mounted folders, a rename without overwriting on
others), so of two writers that read the same version one is refused: a commit is only ever taken on top
of the version that was read for it.

A reader takes the last record, and per key the row of the last commit: rows of the compacted table whose
key no change names stay as they are.  Folders never change, so a snapshot stays readable as it was.
Tables may be partitioned by columns of their key; filters on key columns reach the scans.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """The version that was read for a commit is no longer the last one."""


@dataclass(frozen=True)
class Kept:
    """A table of a log: its columns, its key, and the columns of the key it is partitioned by."""

    columns: str
    keys: tuple[str, ...]
    by: tuple[str, ...] = ()

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.columns)


@dataclass
class Change:
    """What a commit does: rows to put, keys to take away, tables to replace as a whole."""

    put: dict[str, DataFrame] = field(default_factory=dict)
    gone: dict[str, DataFrame] = field(default_factory=dict)
    whole: dict[str, DataFrame] = field(default_factory=dict)


class Folder:
    """The few file operations that records need, by the file system that Spark uses."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway, self.path = spark._jvm, spark.sparkContext._gateway, path.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def create(self, name: str, text: str) -> bool:
        """Makes a file as a whole; False, and nothing made, if the name is taken."""
        own, to = self._at(f"_pending/{uuid.uuid4().hex}"), self._at(name)
        out = self._fs.create(own, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(to.getParent())
        try:
            if self._fs.getScheme() == "file":
                os.link(own.toUri().getPath(), to.toUri().getPath())
            else:
                options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self._conf).rename(own, to, options)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self._fs.delete(own, False)


class Snapshot:
    """The tables of a log as one version has them."""

    def __init__(self, log: TableLog, version: int, parts: dict[str, dict]):
        self.log, self.version, self.parts = log, version, parts

    def changes(self, name: str) -> int:
        return len(self.parts.get(name, {}).get("changes", []))

    def _scan(self, schema: StructType, folders: list[str]) -> DataFrame:
        """One scan over the folders of a table: each is a value of a partition column named commit."""
        name = folders[0].split("/")[0]
        return self.log.spark.read.schema(schema).option("basePath", f"{self.log.path}/{name}").parquet(*[f"{self.log.path}/{f}" for f in folders])

    def read(self, name: str) -> DataFrame:
        table, parts = self.log.TABLES[name], self.parts.get(name, {"base": None, "changes": []})
        columns = table.schema.names
        base = self._scan(table.schema, [parts["base"]]) if parts["base"] else self.log.spark.createDataFrame([], table.schema)
        if not parts["changes"]:
            return base.select(*columns)
        rows = self._scan(StructType.fromDDL(f"{table.columns}, _commit LONG, _gone BOOLEAN"), parts["changes"])
        rest = [c for c in columns if c not in table.keys]
        # A row that the same commit takes away and puts is there.
        last = rows.groupBy(*table.keys).agg(F.max_by(F.struct(*rest, "_gone"), F.struct("_commit", ~F.col("_gone"))).alias("_last"))
        live = last.where("NOT _last._gone").select(*table.keys, *[F.col(f"_last.{c}") for c in rest]).select(*columns)
        if not parts["base"]:
            return live
        named = last.select(*[F.col(k).alias(f"_{k}") for k in table.keys])
        same = F.lit(True)
        for k in table.keys:
            same = same & base[k].eqNullSafe(named[f"_{k}"])
        return base.join(named, same, "left_anti").select(*columns).unionByName(live)

    def commit(self, change: Change) -> int:
        """Publishes a change of what this snapshot has; refused if the log has moved on."""
        number, parts = self.version + 1, {n: {"base": p["base"], "changes": list(p["changes"])} for n, p in self.parts.items()}
        for name, df in change.whole.items():
            parts[name] = {"base": self.log._write(name, f"base-{number:012d}", df.select(*self.log.TABLES[name].schema.names)), "changes": []}
        for name in dict.fromkeys([*change.put, *change.gone]):
            table = self.log.TABLES[name]
            marked = lambda df, gone: df.withColumns({"_commit": F.lit(number).cast("long"), "_gone": F.lit(gone)})
            rows = []
            if name in change.put:
                rows.append(marked(change.put[name].select(*table.schema.names), False))
            if name in change.gone:
                empty = {f.name: F.lit(None).cast(f.dataType) for f in table.schema if f.name not in table.keys}
                rows.append(marked(change.gone[name].select(*table.keys).withColumns(empty), True))
            own = parts.setdefault(name, {"base": None, "changes": []})
            own["changes"].append(self.log._write(name, f"change-{number:012d}", rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])))
        if not self.log.folder.create(f"_log/{number:012d}.json", json.dumps({"version": number, "tables": parts})):
            raise Conflict(f"version {self.version} was read, and another writer made version {number}")
        return number


class TableLog:
    TABLES: dict[str, Kept] = {}

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Kept] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)
        if tables is not None:
            self.TABLES = tables

    def _write(self, name: str, kind: str, df: DataFrame) -> str:
        table, at = self.TABLES[name], f"{name}/commit={kind}-{uuid.uuid4().hex}"
        if table.by:
            # A folder's rows are written together, not by every task a few, but a large folder by several.
            df.hint("rebalance", *table.by).sortWithinPartitions(*table.by, *[k for k in table.keys if k not in table.by]).write.partitionBy(*table.by).parquet(f"{self.path}/{at}")
        else:
            df.write.parquet(f"{self.path}/{at}")
        return at

    @property
    def version(self) -> int:
        """The last version's number; -1 before the first commit."""
        names = self.folder.names("_log")
        return int(names[-1].split(".")[0]) if names else -1

    def snapshot(self, version: int | None = None) -> Snapshot:
        number = self.version if version is None else version
        return Snapshot(self, number, json.loads(self.folder.text(f"_log/{number:012d}.json"))["tables"] if number >= 0 else {})

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    def change(self, make: Callable[[Snapshot], Change], tries: int = 5) -> int:
        """Commits make(snapshot); if another writer comes first, makes the change anew from its version."""
        for left in reversed(range(tries)):
            own = self.snapshot()
            try:
                return own.commit(make(own))
            except Conflict:
                if not left:
                    raise
        raise ValueError("no tries")

    def compact(self, most: int = 0) -> int | None:
        """Folds the changes of tables that have more than so many; a base is sorted by its keys, so that
        keyed reads skip row groups."""
        own = self.snapshot()
        whole = {}
        for name, table in self.TABLES.items():
            if own.changes(name) > most:
                rows = own.read(name)
                whole[name] = rows if table.by else rows.repartitionByRange(*table.keys).sortWithinPartitions(*table.keys)
        return own.commit(Change(whole=whole)) if whole else None

    def vacuum(self, versions: int = 1) -> list[str]:
        """Deletes records before the last so many versions, and folders that no other record names."""
        records = self.folder.names("_log")
        old, kept = records[:-versions], records[-versions:]
        used = {f for r in kept for p in json.loads(self.folder.text(f"_log/{r}"))["tables"].values() for f in [p["base"], *p["changes"]] if f}
        for r in old:
            self.folder.delete(f"_log/{r}")
        # A folder of a commit that is still to come bears a later number than the last record's.
        last = int(kept[-1].split(".")[0]) if kept else -1
        gone = [f"{n}/{d}" for n in self.TABLES for d in self.folder.names(n) if f"{n}/{d}" not in used and int(d.split("-")[1]) <= last]
        for f in gone:
            self.folder.delete(f)
        return gone
