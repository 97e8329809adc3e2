"""Tables of the state as versions: a commit writes new folders and then moves one pointer, so that readers see all of it or none."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from triagemill.operators import state

SCHEMAS = {"jobs": state.JOBS, "skill_patterns": state.SKILL_PATTERNS, "job_skills": state.JOB_SKILLS}


class Conflict(Exception):
    """Another writer has committed since the version that a commit was made from."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def version(self) -> int:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit()), default=0)

    def _folders(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        rows = self.spark.read.option("wholetext", True).text(f"{self.root}/v{version}.json").collect()
        return json.loads(rows[0][0])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        folder = self._folders(self.version() if version is None else version).get(name)
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{folder}") if folder else self.spark.createDataFrame([], SCHEMAS[name])

    def commit(self, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """A new version with these tables, the others as they were. `base`: the version they were made from; Conflict if it isn't the last."""
        last = self.version()
        if base is not None and base != last:
            raise Conflict(f"made from version {base}, the last is {last}")
        folders = self._folders(last)
        for name, rows in tables.items():
            folders[name] = f"{name}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{folders[name]}")
        part, target = self._path(f"{self.root}/{uuid.uuid4().hex}.part"), self._path(f"{self.root}/v{last + 1}.json")
        out = self._fs.create(part)
        out.write(json.dumps(folders).encode())
        out.close()
        if not self._fs.rename(part, target):
            self._fs.delete(part, False)
            raise Conflict(f"version {last + 1} exists")
        return last + 1
