"""A record book in a folder: tables that change by commits.

A commit writes new folders of parquet files beside the old ones and then one small manifest that names, per table, the
folders that hold it. A manifest appears whole or not at all and no folder is ever changed, so a reader sees one state and a
failed commit leaves nothing behind but unnamed folders. Of two writers that start from one state the second is refused.

Tables are of two kinds. ``append`` tables (the change feed, the log) are all their folders together. ``keyed`` tables (the
projection, points of a series) are read with the newest row per key; a commit adds rows, deletions among them, in a folder
of their own, and ``compact`` folds the folders into one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordweave.runtime import delete

#: Folders of a keyed table from which a commit folds them into one.
MOST_FOLDERS = 16
GENERATION, GONE = "_generation", "_gone"


class CommitConflict(RuntimeError):
    """Another writer has committed since this one read."""


@dataclass
class State:
    """What one manifest says: its number and, per table, its folders in order and its key (none: append)."""

    number: int = 0
    folders: dict[str, list[str]] = field(default_factory=dict)
    keys: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class Commit:
    """Changes to be written together. Rows to append, rows to put (they replace those of equal key) and keys to delete."""

    appended: dict[str, DataFrame] = field(default_factory=dict)
    put: dict[str, tuple[list[str], DataFrame]] = field(default_factory=dict)
    deleted: dict[str, tuple[list[str], DataFrame]] = field(default_factory=dict)
    replaced: dict[str, DataFrame] = field(default_factory=dict)


class Store:
    """Tables under ``root``, a folder of any file system Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path(f"{self.root}/manifests"))

    # manifests

    def state(self) -> State:
        """The newest state."""
        numbers = [int(s.getPath().getName().removesuffix(".json")) for s in self._files.listStatus(self._path(f"{self.root}/manifests")) if s.getPath().getName().endswith(".json")]
        if not numbers:
            return State()
        said = json.loads(self._read(f"{self.root}/manifests/{max(numbers):012d}.json"))
        return State(max(numbers), said["folders"], said["keys"])

    def _read(self, path: str) -> str:
        stream = self._files.open(self._path(path))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _publish(self, state: State) -> None:
        """Names a state. The lock file of its number is made by one writer only, as making it fails where it exists."""
        name = f"{self.root}/manifests/{state.number:012d}"
        try:
            self._files.create(self._path(f"{name}.lock"), False).close()
        except Exception as e:
            raise CommitConflict(f"state {state.number} is being or has been written by another") from e
        stream = self._files.create(self._path(f"{name}.tmp"), True)
        stream.write(bytearray(json.dumps({"folders": state.folders, "keys": state.keys}).encode()))
        stream.close()
        if not self._files.rename(self._path(f"{name}.tmp"), self._path(f"{name}.json")):
            raise CommitConflict(f"state {state.number} could not be named")

    # tables

    def has(self, name: str) -> bool:
        return bool(self.state().folders.get(name))

    def table(self, name: str, state: State | None = None) -> DataFrame | None:
        """A table of the newest state (or of one read before); None where nothing was ever written to it."""
        state = state or self.state()
        folders = state.folders.get(name)
        if not folders:
            return None
        rows = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.root}/{f}" for f in folders])
        key = state.keys.get(name)
        if not key:
            return rows
        if len(folders) == 1:
            newest = rows
        else:
            others = [c for c in rows.columns if c not in key]
            newest = rows.groupBy(*key).agg(F.max_by(F.struct(*others), GENERATION).alias("_r")).select(*key, "_r.*")
        return newest.where(~F.col(GONE)).drop(GENERATION, GONE)

    def commit(self, change: Commit, based_on: State) -> State:
        """Writes a change on top of the state it was made from and returns the new state."""
        new = State(based_on.number + 1, {t: list(f) for t, f in based_on.folders.items()}, dict(based_on.keys))
        written: list[str] = []

        def write(table: str, rows: DataFrame) -> str:
            folder = f"{table}/{new.number:012d}-{uuid.uuid4().hex[:12]}"
            rows.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
            written.append(folder)
            return folder

        try:
            for table, rows in change.appended.items():
                new.folders.setdefault(table, []).append(write(table, rows))
            keyed: dict[str, DataFrame] = {}
            for table, (key, rows) in change.put.items():
                keyed[table] = rows.withColumn(GONE, F.lit(False))
                new.keys[table] = key
            for table, (key, rows) in change.deleted.items():
                gone = rows.select(*key).distinct().withColumn(GONE, F.lit(True))
                keyed[table] = gone if table not in keyed else keyed[table].unionByName(gone, allowMissingColumns=True)
                new.keys[table] = key
            for table, rows in keyed.items():
                new.folders.setdefault(table, []).append(write(table, rows.withColumn(GENERATION, F.lit(new.number).cast("long"))))
                if len(new.folders[table]) > MOST_FOLDERS:
                    new.folders[table] = [write(table, self._folded(table, new))]
            for table, rows in change.replaced.items():
                marked = rows.withColumn(GONE, F.lit(False)).withColumn(GENERATION, F.lit(new.number).cast("long")) if new.keys.get(table) else rows
                new.folders[table] = [write(table, marked)]
            self._publish(new)
        except BaseException:
            for folder in written:
                delete(self.spark, f"{self.root}/{folder}")
            raise
        return new

    def _folded(self, table: str, state: State) -> DataFrame:
        return self.table(table, state).withColumn(GONE, F.lit(False)).withColumn(GENERATION, F.lit(state.number).cast("long"))

    def compact(self, table: str) -> State:
        """Folds a keyed table into one folder."""
        state = self.state()
        new = State(state.number + 1, {t: list(f) for t, f in state.folders.items()}, dict(state.keys))
        folder = f"{table}/{new.number:012d}-{uuid.uuid4().hex[:12]}"
        self._folded(table, state).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        new.folders[table] = [folder]
        self._publish(new)
        return new

    def clean(self) -> int:
        """Removes the folders that the newest state does not name; how many. For when no reader of an older state is left."""
        named = {f for folders in self.state().folders.values() for f in folders}
        gone = 0
        for table in self._files.listStatus(self._path(self.root)):
            name = table.getPath().getName()
            if name == "manifests" or not table.isDirectory():
                continue
            for folder in self._files.listStatus(table.getPath()):
                if f"{name}/{folder.getPath().getName()}" not in named:
                    gone += bool(self._files.delete(folder.getPath(), True))
        return gone

    def catalogue(self) -> list[tuple[str, str, int]]:
        """(table, kind, folders) of every table, by name."""
        state = self.state()
        return sorted((t, "keyed" if state.keys.get(t) else "append", len(f)) for t, f in state.folders.items())
