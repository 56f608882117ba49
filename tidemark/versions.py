"""Tables that change together: versions beside each other in one folder that all writers see, each a list of Parquet folders.

A version is one small file, put in place by a rename that fails if the name is taken, after all data that it names was written.
A writer says which version it read; if another one has come since, it is refused with code 409 and nothing that it wrote is
ever seen. So several tables change together or not at all, readers keep the version that they began with, and a lost writer leaves the last
version as it was. The folder's filesystem has to have an atomic rename (HDFS has; object stores need a committer of their own).

A table with a key is stored by buckets of its key: a merge rewrites the buckets that its rows are in, by a join inside each,
and leaves the others where they are. Rows that are appended only add a folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.views import RequestError

BUCKETS = 16


class Versions:
    """A folder of versions. Version 0 has no tables."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("versions").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def latest(self) -> int:
        fs, at = self._fs(), self._at("versions")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def _state(self, version: int) -> dict:
        if not version:
            return {"tables": {}, "notes": {}}
        at = f"{self.path}/versions/{version:012d}.json"
        found = self.spark.read.text(at, wholetext=True).first() if self._fs().exists(self._at(f"versions/{version:012d}.json")) else None
        if found is None:
            raise RequestError("no such version", 404)
        return json.loads(found.value)

    def notes(self, version: int | None = None) -> dict:
        return self._state(self.latest() if version is None else version)["notes"]

    def names(self, version: int | None = None) -> list[str]:
        return sorted(self._state(self.latest() if version is None else version)["tables"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._read(self._state(self.latest() if version is None else version), name)

    def _read(self, state: dict, name: str, buckets: set[int] | None = None) -> DataFrame:
        if name not in state["tables"]:
            raise RequestError(f"no such table: {name}", 404)
        table = state["tables"][name]
        schema = StructType.fromJson(table["schema"])
        parts = [folder for bucket, folder in table["parts"] if buckets is None or bucket in buckets]
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], schema)

    def lookup(self, name: str, keys: list, version: int | None = None) -> DataFrame:
        """The rows of a few keys; only the buckets that they are in are read."""
        state = self._state(self.latest() if version is None else version)
        key = state["tables"].get(name, {}).get("key") or name
        asked = self.spark.range(1).select(F.explode(F.array(*map(F.lit, keys))).alias(key))
        return self._read(state, name, {r.b for r in asked.select(self._bucket(key).alias("b")).collect()}).where(F.col(key).isin(keys))

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, df: DataFrame, key: str | None) -> list[list]:
        """df in new folders; the buckets that have rows, with their folders."""
        to = f"data/{uuid.uuid4().hex}/{name}"
        if key is None:
            df.write.parquet(f"{self.path}/{to}")
            return [[-1, to]]
        # a bucket may have many tasks, a task has few buckets
        df.withColumn("_bucket", self._bucket(key)).repartitionByRange(F.col("_bucket"), F.xxhash64(F.col(key).cast("string"))).write.partitionBy("_bucket").parquet(f"{self.path}/{to}")
        fs, at = self._fs(), self._at(to)
        found = [f.getPath().getName() for f in fs.listStatus(at)]
        return [[int(n.removeprefix("_bucket=")), f"{to}/{n}"] for n in sorted(found) if n.startswith("_bucket=")]

    def commit(self, read: int, put: dict[str, DataFrame] | None = None, merge: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, remove: dict[str, DataFrame] | None = None, keys: dict[str, str] | None = None, notes: dict | None = None) -> int:
        """The next version after the one that was read, and its number.

        put: tables with all their rows; merge: rows in place of those of the same key; remove: keys whose rows go (before merge's
        come); append: rows beside those that are there. keys: each table's key, when it is first put or merged.
        """
        if read != self.latest():
            raise RequestError(f"version {read} is not the latest", 409)
        state = self._state(read)
        tables = dict(state["tables"])
        put, merge, append, remove = put or {}, dict(merge or {}), append or {}, remove or {}
        for name, df in put.items():
            key = (keys or {}).get(name, tables.get(name, {}).get("key"))
            tables[name] = {"schema": json.loads(df.schema.json()), "key": key, "parts": self._write(name, df, key)}
        for name in {**merge, **remove}:
            rows, gone = merge.get(name), remove.get(name)
            if name not in tables:
                if rows is not None:
                    key = (keys or {})[name]
                    tables[name] = {"schema": json.loads(rows.schema.json()), "key": key, "parts": self._write(name, rows, key)}
                continue
            table = tables[name]
            key = table["key"]
            touched = [df.select(key) for df in (rows, gone) if df is not None]
            which = touched[0] if len(touched) == 1 else touched[0].unionAll(touched[1])
            at = {r.b for r in which.select(self._bucket(key).alias("b")).distinct().collect()}  # at most BUCKETS
            if not at:
                continue
            left = self._read({"tables": tables}, name, at).join(which.distinct(), key, "left_anti")
            left = left if rows is None else left.unionByName(rows.select(*left.columns))
            tables[name] = table | {"parts": [p for p in table["parts"] if p[0] not in at] + self._write(name, left, key)}
        for name, df in append.items():
            table = tables.get(name) or {"schema": json.loads(df.schema.json()), "key": None, "parts": []}
            if table["key"] is not None:
                raise RequestError(f"{name} has a key: merge into it")
            df = df.select(*(f["name"] for f in table["schema"]["fields"]))
            tables[name] = table | {"parts": table["parts"] + self._write(name, df, None)}
        return self._publish(read + 1, {"tables": tables, "notes": state["notes"] | (notes or {})})

    def _publish(self, version: int, state: dict) -> int:
        jvm, fs = self.spark.sparkContext._jvm, self._fs()
        fs.mkdirs(self._at("versions"))
        draft, final = self._at(f"versions/.{uuid.uuid4().hex}"), self._at(f"versions/{version:012d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise RequestError(f"version {version} was written by another", 409) from None
            raise
        return version

    def update(self, name: str, where: Column, changes: dict[str, Column], read: int | None = None) -> tuple[int, int]:
        """Rows of a table with a key that `where` names, changed; the number of them and the version. Conditional: what is stored decides, and another writer's version refuses it.

        Increments and unset fields are columns like any other: `F.col("n") + 1`, `F.lit(None)`.
        """
        read = self.latest() if read is None else read
        stored, key = self.read(name, read), self._state(read)["tables"][name]["key"]
        n = stored.where(where).count()
        if not n:
            return 0, read
        kinds = dict(stored.dtypes)
        rows = stored.join(stored.where(where).select(key).distinct(), key, "left_semi")  # a key's other rows are written with them
        return n, self.commit(read, merge={name: rows.withColumns({c: F.when(where, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in changes.items()})})

    def retried(self, change: Callable[[int], int | None], times: int = 5) -> int:
        """change(version read), again from the latest version while another writer comes first."""
        for last in range(times):
            read = self.latest()
            try:
                return change(read) or read
            except RequestError as e:
                if e.code != 409 or last == times - 1:
                    raise
        raise AssertionError
