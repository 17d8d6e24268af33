"""Session settings and shared-storage helpers used by every operator."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "odonymy", **conf: str) -> SparkSession:
    """A session with the settings the library is tested under; an active one is reused."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own_root: list[str] = []
PART, PARTS = 64 << 20, 4  # bytes of a table that go through a step at a time, and how many times at most
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where that is unset and Spark runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="odonymy-"))
    return _own_root[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame | Iterable[DataFrame], name: str, files: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors.

    Several frames of one schema (see ``split``) are written one after the other. files: how many at
    most, for results known to be small; the last stage then has as many tasks.
    """
    path = spark = schema = None
    for part in [df] if isinstance(df, DataFrame) else df:
        spark, schema = part.sparkSession, part.schema
        path = path or scratch_path(spark, name)
        (part.coalesce(files) if files else part).write.mode("append").parquet(path)
        del part  # its shuffles can go
    return spark.read.schema(schema).parquet(path)


def split(df: DataFrame, parts: int, key: str = "norm_name") -> Iterator[DataFrame]:
    """The rows of ``df`` in so many parts that keep those of a key together; the shuffles of a part are freed before the next.

    For steps that shuffle much: what is worked out from one part stands on disk at a time. Each part reads the inputs again.
    """
    if parts == 1:
        yield df
        return
    for k in range(parts):
        yield df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == k)
        gc.collect()  # what Python still holds in cycles, the driver's JVM keeps
        for _ in range(2):
            release(df.sparkSession)


def parts_of(df: DataFrame, times: int = 1) -> int:
    """In how many parts to work on a stored table: one for each PART bytes of the columns it has, PARTS at most; one if that is not known.

    times: how many times its size the step shuffles, where that is far more.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() * times
    return max(1, min(PARTS, -(-size // PART))) if size < 1 << 50 else 1


def discard(df: DataFrame) -> None:
    """Deletes the files behind a DataFrame that ``materialize`` returned."""
    spark = df.sparkSession
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def release(spark: SparkSession) -> None:
    """Frees the disk of shuffles that nothing refers to any more: Spark removes them when the driver's JVM has collected the plans.

    To be called between large steps, after ``materialize``; else they stay until a collection comes about by itself.
    """
    for _ in range(2):  # the first collection ends what still refers to the last query
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application, and keeps the workers small.

    Rows of text are large: batches of a thousand are enough (only Spark's default is changed). Worker
    processes give freed arrays back to the system.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")
    context = spark.sparkContext
    if getattr(context, "_odonymy_shipped", False):
        return
    for name, value in (("MALLOC_ARENA_MAX", "2"), ("MALLOC_MMAP_THRESHOLD_", str(4 << 20)), ("MALLOC_TRIM_THRESHOLD_", str(16 << 20))):
        context.environment.setdefault(name, value)
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="odonymy-zip-"), "odonymy.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._odonymy_shipped = True
