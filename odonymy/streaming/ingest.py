"""Resumable ingestion and joining.

Ingestion is a stream of way files with a checkpoint: each micro-batch is upserted, a batch that
is run again changes nothing, and a new start goes on where the last one stopped. Extraction from
a dump goes by ranges of way ids with a cursor, so an interrupted one resumes as well. Joining works
through buckets of street keys and notes the finished ones, so an interrupted run resumes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odonymy.functions.names import normalize_name
from odonymy.operators import streets
from odonymy.sources import osm
from odonymy.store import SCHEMAS, Store

RAW = "way_id long, name string, node_ids array<long>, coords array<struct<node_id:long,lon:double,lat:double>>"


def upsert(store: Store, batch: DataFrame, key: str = "way_id", order: Column | None = None) -> None:
    """Rows of the batch replace those of the same id; of several in the batch the last by ``order`` holds (without one: the greatest by content). A null name is an error."""
    if not batch.where("name is null").isEmpty():
        raise ValueError("a way without a name cannot be stored")
    content = F.struct(*(c for c in store.read("ways").columns if c != key))
    last = F.max(content) if order is None else F.max(F.struct(order.alias("o"), content.alias("r")))["r"]
    one = batch.groupBy(key).agg(last.alias("r")).select(key, "r.*")
    kept = store.read("ways").join(one.select(key), key, "left_anti")
    store.write("ways", kept.unionByName(one.select(*kept.columns)))


def named(ways: DataFrame) -> DataFrame:
    """Named ways with their key; an empty name counts as one."""
    return ways.where("name is not null").withColumn("norm_name", normalize_name(F.col("name")))


def follow_ways(spark: SparkSession, source: str, store: Store, checkpoint: str) -> None:
    """Takes in all files that came since the last start (Parquet of RAW) and returns.

    Of several rows of one id the last read holds: the later file (by time, then name), the later
    row. Counts are kept per micro-batch, so a batch that Spark runs again replaces its own.
    """
    place = F.struct("file_modification_time", "file_path", "row_index")

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        parsed, unnamed = batch.agg(F.count("*"), F.count_if(F.col("name").isNull())).first()
        upsert(store, named(batch), order=place)
        store.set_meta(**{f"parsed@{number}": parsed, f"unnamed@{number}": unnamed})
        every = {r.key: r.value for r in store.read("meta").collect()}
        store.set_meta(**{f"{what}_count": sum(v for k, v in every.items() if k.startswith(f"{what}@")) for what in ("parsed", "unnamed")})
        batch.unpersist()

    stream = spark.readStream.schema(RAW).parquet(source).select("*", *(f"_metadata.{c}" for c in ("file_modification_time", "file_path", "row_index")))
    run = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def extract_in_steps(store: Store, nodes: DataFrame, ways: DataFrame, steps: int = 4) -> tuple[int, int]:
    """Named highways into the store, by ranges of ascending way id; returns (parsed, unnamed).

    A range's rows and the cursor - the greatest id done, which is the folder's name - come into
    force together, by the success mark. A run that finds a cursor goes on behind it; without one it
    is a fresh run. At the end the parts become the ways table and the cursor is gone.
    """
    spark, folder = store.spark, "ways_parts"
    done = store.parts(folder)
    if not done:
        store.clear(folder)
    cursor = max(map(int, done), default=None)
    left = ways.where(F.col("tags")["highway"].isNotNull()).select("way_id")
    left = left if cursor is None else left.where(F.col("way_id") > cursor)
    ends = left.agg(F.percentile_approx("way_id", [k / steps for k in range(1, steps + 1)], 10_000)).first()[0] or []
    for end in sorted(set(ends)):
        osm.highways(nodes, ways, cursor, end).write.mode("overwrite").parquet(f"{store.path}/{folder}/{end}")
        cursor = end
    names = store.parts(folder)
    schema = spark.createDataFrame([], SCHEMAS["ways"]).schema
    every = spark.read.schema(schema).parquet(*(f"{store.path}/{folder}/{n}" for n in names)) if names else spark.createDataFrame([], schema)
    parsed, unnamed = every.agg(F.count("*"), F.count_if(F.col("name").isNull())).first()
    store.write("ways", every.where("name is not null"))
    store.set_meta(parsed_count=parsed, unnamed_count=unnamed)
    store.clear(folder)
    return parsed, unnamed


def join_in_buckets(store: Store, threshold: float | None, projection=None, buckets: int = 1) -> int:
    """Streets of all ways, bucket by bucket of norm_name; returns the streets this run made.

    Finished buckets stand in streets_parts with Spark's success mark. A run that finds some goes on
    with the others; only if there are none is it a fresh one. At the end the parts become the
    streets table, and the aggregate is rebuilt.
    """
    spark, ways = store.spark, store.read("ways")
    fs, path = store.fs()
    part = lambda b: f"{store.path}/streets_parts/of={buckets}/bucket={b}"
    made = 0
    for b in range(buckets):
        if fs.exists(path(f"{part(b)}/_SUCCESS")):
            continue
        mine = ways.where(F.pmod(F.xxhash64("norm_name"), F.lit(buckets)) == b) if buckets > 1 else ways
        streets.streets(streets.components(mine, threshold, projection)).write.mode("overwrite").parquet(part(b))
        made += spark.read.parquet(part(b)).count()
    every = spark.read.schema(SCHEMAS["streets"]).parquet(*(part(b) for b in range(buckets)))
    store.write("streets", every)
    store.write("street_groups", streets.street_groups(store.read("streets")))
    store.clear("streets_parts")
    return made
