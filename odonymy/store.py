"""A folder of Parquet tables with atomic replacement: what the commands hand to each other.

Every write of a table makes a new numbered folder; readers take the newest one that carries
Spark's success mark, and older ones are deleted after it is there. A command that dies leaves
the last complete table in force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "ways": "way_id long, name string, norm_name string, node_ids array<long>, coords array<struct<node_id:long,lon:double,lat:double>>",
    "squares": "osm_id long, name string, lon double, lat double",
    "areas": "area_seq long, osm_id long, from_way boolean, admin_level string, name string, postal_code string, istat string, catasto string, wikidata string, geometry array<array<array<struct<x:double,y:double>>>>",
    "streets": "norm_name string, name string, way_ids array<long>, street_id long",
    "street_groups": "norm_name string, name string, count long",
    "meta": "key string, value long",
}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def present(self) -> bool:
        fs, path = self.fs()
        return fs.exists(path(self.path))

    def _versions(self, name: str, complete: bool = True) -> list[int]:
        fs, path = self.fs()
        at = path(f"{self.path}/{name}")
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n) for n in found if n.isdigit() and (not complete or fs.exists(path(f"{self.path}/{name}/{n}/_SUCCESS"))))

    def has(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str) -> DataFrame:
        """The table's newest complete version; no rows if there is none."""
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}/{versions[-1]:06d}")

    def write(self, name: str, rows: DataFrame) -> None:
        """Replaces the table. ``rows`` may read the version that is replaced."""
        before = self._versions(name, complete=False)
        rows.select(*self.spark.createDataFrame([], SCHEMAS[name]).columns).write.parquet(f"{self.path}/{name}/{(before or [0])[-1] + 1:06d}")
        fs, path = self.fs()
        for old in before:
            fs.delete(path(f"{self.path}/{name}/{old:06d}"), True)

    def clear(self, name: str) -> None:
        fs, path = self.fs()
        fs.delete(path(f"{self.path}/{name}"), True)

    def parts(self, folder: str) -> list[str]:
        """Names under a folder of unfinished work that carry the success mark, ascending."""
        fs, path = self.fs()
        at = path(f"{self.path}/{folder}")
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in found if fs.exists(path(f"{self.path}/{folder}/{n}/_SUCCESS")))

    def meta(self, key: str) -> int | None:
        row = self.read("meta").where(F.col("key") == key).first()
        return row.value if row else None

    def set_meta(self, **values: int | None) -> None:
        """Sets numbers by key; None removes."""
        kept = {r.key: r.value for r in self.read("meta").collect()} | values
        self.write("meta", self.spark.createDataFrame([(k, v) for k, v in sorted(kept.items()) if v is not None], SCHEMAS["meta"]))

    def header(self) -> dict[str, int]:
        """parsed and unnamed counts of the extraction (0 if unknown), distinct groups of the ways."""
        groups = self.read("ways").agg(F.count_distinct("norm_name")).first()[0]
        return {"parsed": self.meta("parsed_count") or 0, "unnamed": self.meta("unnamed_count") or 0, "groups": groups}

    def register_views(self) -> None:
        """All tables as temporary views, for ad-hoc SQL."""
        for name in SCHEMAS:
            self.read(name).createOrReplaceTempView(name)
