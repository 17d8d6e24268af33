"""Paths that are local or URIs of any file system Spark reaches, and names derived from them."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def is_uri(path: object) -> bool:
    return "://" in str(path)


def _hadoop(spark: SparkSession, path: object):
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def is_file(path: object, spark: SparkSession | None = None) -> bool:
    if not is_uri(path):
        return os.path.isfile(path)
    fs, at = _hadoop(spark or SparkSession.getActiveSession(), path)
    return fs.exists(at) and fs.getFileStatus(at).isFile()


def read_text(path: object, spark: SparkSession | None = None) -> str:
    """A small text file, whole, as UTF-8."""
    if not is_uri(path):
        with open(path, encoding="utf-8", newline="") as f:
            return f.read()
    spark = spark or SparkSession.getActiveSession()
    fs, at = _hadoop(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_bytes(path: object, data: bytes, spark: SparkSession | None = None) -> None:
    """Replaces a small file."""
    if not is_uri(path):
        with open(path, "wb") as f:
            f.write(data)
        return
    fs, at = _hadoop(spark or SparkSession.getActiveSession(), path)
    stream = fs.create(at, True)
    try:
        stream.write(data)
    finally:
        stream.close()


def write_text(path: object, text: str, spark: SparkSession | None = None) -> None:
    write_bytes(path, text.encode(), spark)


def name_of(path: object) -> str:
    return str(path).rstrip("/").rpartition("/")[2]


def stem_of(path: object) -> str:
    """The name without its last suffix."""
    name = name_of(path)
    return name[: name.rfind(".")] if name.rfind(".") > 0 else name


def beside(path: object, name: str) -> str:
    """Another name in the same folder."""
    head, slash, _ = str(path).rstrip("/").rpartition("/")
    return f"{head}{slash}{name}"
