"""Versioned tables of the graph, in parts by name; a version is published by a manifest written last.

Each table lies in a fixed number of parts by the hash of its key. A batch writes the parts that its names fall
in; the manifest takes the other parts over from where they were. Readers see whole versions only.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweft.schemas import ENTITY, RELATION


class Store:
    """Tables ``entities`` (parts by name) and ``relations`` (by subject) under ``root``, which all executors share."""

    SCHEMAS = {"entities": ENTITY, "relations": RELATION}
    KEYS = {"entities": "name", "relations": "subject"}

    def __init__(self, spark: SparkSession, root: str, parts: int = 64):
        self.spark, self.root, self._parts = spark, root.rstrip("/"), parts

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path(self.root))]
        return sorted(int(x[10:]) for x in found if x.startswith("published_"))

    def manifest(self, version: int | None = None) -> dict:
        """``tag``, ``count`` of parts, and for each table the version that holds each part."""
        known = self.versions()
        if not known:
            return {"tag": "", "count": self._parts, **{t: {} for t in self.SCHEMAS}}
        lines = self.spark.read.text(f"{self.root}/published_{version or known[-1]}", wholetext=True).first()
        return json.loads(lines["value"])

    def bootstrap(self) -> None:
        """Empty tables, unless a version exists."""
        if not self.versions():
            self.publish({t: self.spark.createDataFrame([], s) for t, s in self.SCHEMAS.items()})

    def part(self, key: Column | str, count: int | None = None) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(count or self.manifest()["count"])).cast("int")

    def parts_of(self, names: DataFrame) -> list[int]:
        """The parts that names (one column) fall in: a few numbers, however many names."""
        return sorted(r[0] for r in names.select(self.part(F.col(names.columns[0])).alias("part")).distinct().collect())

    def read(self, table: str, parts: list[int] | None = None, version: int | None = None) -> DataFrame:
        """A table, or some of its parts."""
        held = self.manifest(version)[table]
        by_version: dict[int, list[str]] = {}
        for part, at in held.items():
            if parts is None or int(part) in parts:
                by_version.setdefault(at, []).append(part)
        frames = []
        for at, those in sorted(by_version.items()):
            base = f"{self.root}/v{at}/{table}"
            frames.append(self.spark.read.schema(self.SCHEMAS[table]).option("basePath", base).parquet(*[f"{base}/part={p}" for p in those]).select(*self._columns(table)))
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], self.SCHEMAS[table])

    def _columns(self, table: str) -> list[str]:
        return [c.strip().split(" ")[0] for c in self.SCHEMAS[table].split(", ")]

    def publish(self, tables: dict[str, DataFrame], tag: str = "", parts: dict[str, list[int]] | None = None) -> int:
        """Write the next version: the rows given take the place of ``parts`` of a table (of all of it where none are named)."""
        known, held = self.versions(), self.manifest()
        version = (known[-1] if known else 0) + 1
        fs, path = self._fs()
        for name, df in tables.items():
            base = f"{self.root}/v{version}/{name}"
            placed = df.select(*self._columns(name)).withColumn("part", self.part(F.col(self.KEYS[name]), held["count"]))
            placed.repartition("part").write.mode("overwrite").partitionBy("part").parquet(base)
            written = [s.getPath().getName()[5:] for s in fs.listStatus(path(base)) if s.getPath().getName().startswith("part=")]
            gone = None if parts is None or name not in parts else {str(p) for p in parts[name]}
            held[name] = {p: at for p, at in held[name].items() if gone is not None and p not in gone} | {p: version for p in written}
        out = fs.create(path(f"{self.root}/published_{version}"), True)
        out.write(bytearray(json.dumps(held | {"tag": tag}).encode()))
        out.close()
        return version

    def tags(self) -> set[str]:
        """What versions were published under, e.g. the ids of ingested batches."""
        files = [f"{self.root}/published_{v}" for v in self.versions()]
        return {json.loads(r["value"])["tag"] for r in self.spark.read.text(files, wholetext=True).collect()} if files else set()
