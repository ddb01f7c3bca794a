"""Snapshot tables: every write makes new Parquet folders and then swaps one pointer file, so readers see all tables of a state or none."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SCHEMA_VERSION = 3


class ConflictError(RuntimeError):
    """Another writer committed between the start and the end of a change."""


class Change:
    """Tables written beside the current state; ``commit`` makes them the current one together."""

    def __init__(self, store: Store):
        self.store, self.state, self.before, self.tables, self.held = store, uuid.uuid4().hex, store.manifest(), {}, []

    def _save(self, df: DataFrame, folder: str, by: list[str] = ()) -> DataFrame:
        path = f"{self.store.root}/{folder}"
        df.write.partitionBy(*by).parquet(path)
        return self.store.spark.read.schema(df.schema).parquet(path)

    def put(self, name: str, df: DataFrame, by: list[str] = ()) -> DataFrame:
        """Write a table's next state and return it."""
        out = self._save(df, f"{name}/{self.state}", by)
        self.tables[name] = f"{name}/{self.state}"
        return out

    def hold(self, name: str, df: DataFrame) -> DataFrame:
        """Write rows that only this change needs and return them; they go at the end."""
        self.held.append(f"{self.store.root}/held/{self.state}-{name}")
        return self._save(df, f"held/{self.state}-{name}")

    def commit(self) -> None:
        self.store._commit(self.before, self.tables, self.state)
        for path in self.held:
            fs, p = self.store._fs(path)
            fs.delete(p, True)


class Store:
    """Tables below a root folder that any Hadoop file system holds."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def manifest(self) -> dict:
        fs, p = self._fs(f"{self.root}/current.json")
        if not fs.exists(p):
            return {"schema_version": SCHEMA_VERSION, "tables": {}}
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        if found["schema_version"] > SCHEMA_VERSION:
            raise ValueError(f"the index has schema version {found['schema_version']}, newer than {SCHEMA_VERSION}")
        return found

    def exists(self, table: str) -> bool:
        return table in self.manifest()["tables"]

    def read(self, table: str, schema: StructType | str | None = None) -> DataFrame:
        """The current state of a table; an empty one of ``schema`` if it was never written."""
        folder = self.manifest()["tables"].get(table)
        if folder is None:
            if schema is None:
                raise KeyError(f"no table {table}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{folder}")

    def begin(self) -> Change:
        """A change of several tables that readers see whole or not at all."""
        return Change(self)

    def write(self, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> None:
        change = self.begin()
        for name, df in tables.items():
            change.put(name, df, (partition_by or {}).get(name, []))
        change.commit()

    def _commit(self, before: dict, tables: dict[str, str], state: str) -> None:
        """One rename is the commit; a state that another writer has made since ``before`` is not overwritten."""
        now = self.manifest()
        if now.get("state") != before.get("state"):
            raise ConflictError(f"the index at {self.root} was changed by another writer")
        found = {**now, "state": state, "tables": {**now["tables"], **tables}}
        jvm = self.spark.sparkContext._jvm
        fs, new = self._fs(f"{self.root}/current-{state}.json")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(found).encode()))
        out.close()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if "://" in self.root else self._uri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(
            new, self._fs(f"{self.root}/current.json")[1], self._overwrite()
        )

    def _uri(self):
        return self.spark.sparkContext._jvm.java.net.URI.create("file:///")

    def _overwrite(self):
        sc = self.spark.sparkContext
        options = sc._gateway.new_array(sc._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        return options

    def vacuum(self) -> int:
        """Delete folders of former states; returns how many."""
        current, n = set(self.manifest()["tables"].values()), 0
        for table in {f.split("/")[0] for f in current}:
            fs, p = self._fs(f"{self.root}/{table}")
            for status in fs.listStatus(p):
                if f"{table}/{status.getPath().getName()}" not in current:
                    fs.delete(status.getPath(), True)
                    n += 1
        return n
