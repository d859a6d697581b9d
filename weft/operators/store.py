"""A database folder: immutable table snapshots and one pointer file that is swapped by rename.

A commit writes only what changes, as new folders: a table anew, or rows to add
to it. The pointer names the folders of every table. Readers see the old pointer
or the new one. Documents and paths are keyed: a later folder's row replaces an
earlier one's when they are read, so a run writes only the rows that it changes.
One writer at a time holds the lock file. Tables that are looked
up by a column are written in its order, so scans skip row groups. Works on any
Hadoop file system.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.model import TABLES


#: Column in whose order a table is written.
LAYOUT = {"posting": "term", "mention": "slug", "chunk": "chunk_id", "vector": "docid", "relation": "chunk_id", "path": "relpath", "doc": "docid"}
#: Tables with one row per key.
KEYS = {"doc": "docid", "path": "relpath"}
#: Folders of a table beyond which it is written anew as one.
MAX_PARTS = 32


class Locked(RuntimeError):
    """Another writer is at work."""


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._staged: dict[str, list[str]] = {}
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._fs = self._path("CURRENT").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(jvm.org.apache.hadoop.fs.Path(self.folder))

    # -- pointer

    def _load(self) -> dict:
        if not self._fs.exists(self._path("CURRENT")):
            return {"version": 0, "tables": {}}
        stream = self._fs.open(self._path("CURRENT"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    @property
    def version(self) -> int:
        return self._load()["version"]

    def parts(self, table: str) -> list[str]:
        return self._load()["tables"].get(table, [])

    def read(self, table: str) -> DataFrame:
        parts = self._staged.get(table) or self.parts(table)
        if not parts:
            return self.spark.createDataFrame([], TABLES[table])
        read = lambda *some: self.spark.read.schema(TABLES[table]).parquet(*[f"{self.folder}/{at}" for at in some])
        if table not in KEYS or len(parts) == 1:
            return read(*parts)
        return self._last(table, [read(at) for at in parts])

    def _last(self, table: str, parts: list[DataFrame]) -> DataFrame:
        """The rows of the last part that has their key."""
        key, names = KEYS[table], TABLES[table].names
        rows = reduce(DataFrame.unionByName, (df.select(*names, F.lit(i).alias("_part")) for i, df in enumerate(parts)))
        last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in names if c != key]), "_part").alias("_row"))
        return last.select(key, "_row.*").select(*names)

    def commit(self, changes: dict[str, DataFrame], added: dict[str, DataFrame] | None = None, check: Callable[[], None] | None = None) -> int:
        """Write tables anew (changes) or rows to add to them, and swap the pointer; on failure the pointer is untouched.

        Rows added to a keyed table replace those with their key and have each key once.

        ``check`` sees the new tables through this store before anyone else does; if it raises, they are dropped.
        """
        state = self._load()
        version = state["version"] + 1
        changes, added, made = dict(changes), dict(added or {}), []
        for table in list(added):
            if len(state["tables"].get(table, [])) >= MAX_PARTS:
                old, new = self.read(table), added.pop(table).select(*TABLES[table].names)
                changes[table] = self._last(table, [old, new]) if table in KEYS else old.unionByName(new)
        try:
            for table, df in (*changes.items(), *added.items()):
                at = f"data/v{version:06d}-{uuid.uuid4().hex[:8]}/{table}"
                made.append(at)
                schema = TABLES[table]
                df = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])
                if table in LAYOUT:
                    df = df.repartitionByRange(LAYOUT[table]).sortWithinPartitions(LAYOUT[table])
                df.write.parquet(f"{self.folder}/{at}")
                state["tables"][table] = [at] if table in changes else [*state["tables"].get(table, []), at]
            if check:
                self._staged = state["tables"]
                check()
        except BaseException:
            for at in made:
                self._fs.delete(self._path(at), True)
            raise
        finally:
            self._staged = {}
        state["version"] = version
        self._swap(json.dumps(state))
        return version

    def _swap(self, text: str) -> None:
        new = self._path(f"CURRENT-{uuid.uuid4().hex}")
        out = self._fs.create(new, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(new, self._path("CURRENT"), options)

    def clean(self) -> int:
        """Delete table folders that the pointer does not name; returns how many."""
        kept, gone = {at for parts in self._load()["tables"].values() for at in parts}, 0
        if not self._fs.exists(self._path("data")):
            return 0
        for version in self._fs.listStatus(self._path("data")):
            for t in self._fs.listStatus(version.getPath()):
                at = f"data/{version.getPath().getName()}/{t.getPath().getName()}"
                if at not in kept:
                    gone += bool(self._fs.delete(t.getPath(), True))
        return gone

    # -- meta

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.read("meta").collect()}  # a handful of settings

    def meta_table(self, **values: str) -> DataFrame:
        return self.spark.createDataFrame(sorted({**self.meta(), **values}.items()), TABLES["meta"])

    # -- lock

    def __enter__(self) -> Store:
        try:
            self._fs.create(self._path("LOCK"), False).close()
        except Exception as e:
            raise Locked(f"{self.folder} is being written, or a writer died: delete its LOCK file then") from e
        return self

    def __exit__(self, *exc) -> None:
        self._fs.delete(self._path("LOCK"), False)
