"""Versions in a folder of any file system that Spark reads: names that are taken once, so that of two writers one learns of the other."""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str) -> tuple[Any, Any, Any]:
    """(file system, path, file context) of a path."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    own = jvm.org.apache.hadoop.fs.Path(path)
    fs = own.getFileSystem(conf)
    return fs, fs.makeQualified(own), jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, path, _ = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def take(spark: SparkSession, fresh: str, name: str) -> bool:
    """Renames a file to a name, unless that is taken already: whether it was free."""
    _, source, context = _file_system(spark, fresh)
    _, target, _ = _file_system(spark, name)
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(source, target, none)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    fs, own, _ = _file_system(spark, path)
    fs.delete(own, True)


def publish(spark: SparkSession, folder: str, version: int, content: Any) -> bool:
    """Writes content as JSON under a version that must be free: whether it was."""
    fresh = f"{folder}/_new-{uuid.uuid4().hex}"
    fs, path, _ = _file_system(spark, fresh)
    out = fs.create(path)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    done = take(spark, fresh, f"{folder}/{version:020d}.json")
    if not done:
        fs.delete(path, False)
    return done


def published(spark: SparkSession, folder: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in names(spark, folder) if n.endswith(".json") and not n.startswith("_")]


def content(spark: SparkSession, folder: str, version: int) -> Any:
    fs, path, _ = _file_system(spark, f"{folder}/{version:020d}.json")
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def shared_folder(spark: SparkSession) -> str:
    """Folder for tables between jobs: spark.checkpoint.dir, or one in /tmp for a local master that has none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not where and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{where or 'file:///tmp/checkpoints/hanmaru'}/{spark.sparkContext.applicationId}"
