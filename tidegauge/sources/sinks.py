"""Sinks: event-log lines and daily results that are published once."""

from __future__ import annotations

import errno
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_lines(events: DataFrame, *keep: str) -> DataFrame:
    """Lines `time | LABEL | message` with their day, and the columns to keep."""
    line = F.concat_ws(" | ", F.date_format("ts", "yyyy.MM.dd HH:mm:ss"), F.upper("label"), F.col("message").cast("string"))
    return events.select(*keep, line.alias("value"), F.date_format("ts", "yyyyMMdd").alias("day"))


def write_event_log(events: DataFrame, path: str) -> None:
    """Append text lines, one folder a day."""
    log_lines(events).write.mode("append").partitionBy("day").text(path)


def _last_version(spark: SparkSession, path: str) -> int:
    """The newest version of a published table; 0 if there is none."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(there):
        return 0
    names = [x.getPath().getName() for x in fs.listStatus(there)]
    return max([0, *(int(x.removeprefix("version=")) for x in names if x.startswith("version="))])


def _take(spark: SparkSession, staged: str, version: str) -> bool:
    """Give staged files the name of a version, in one step; False if another writer has taken it."""
    jvm = spark._jvm
    from_, to = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(version)
    if from_.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file":
        try:
            os.rename(from_.toUri().getPath(), to.toUri().getPath())  # never replaces a folder with files
        except OSError as e:
            if e.errno in (errno.ENOTEMPTY, errno.EEXIST):
                return False
            raise
        return True
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(from_.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(from_, to, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError:
        if context.util().exists(to):
            return False
        raise
    return True


def publish_daily_results(spark: SparkSession, results: DataFrame, path: str, schema: str = "account long, magic long, day timestamp_ntz, net_pnl double, deals long") -> int:
    """Publish the results (account, magic, day, ...) that the table at path doesn't have yet; how many they were.

    A result that comes again, by a retry or in another batch, is left out. Of the table only the batch's span of days is
    read. New results are staged where readers don't look, and become visible all at once, as a folder of the next version. Of
    several writers one takes a version's name; the others look again at what is new, so that each result is published once. A
    writer that dies leaves nothing but a staged folder. Needs a store that renames folders in one step, as HDFS does.
    """
    keys = ["account", "magic", "day"]
    results = results.dropDuplicates(keys).persist()
    try:
        span = results.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
        while True:
            version = _last_version(spark, path)
            new = results
            if version:
                done = spark.read.schema(f"{schema}, version int").parquet(path).where(F.col("day").between(F.lit(span["a"]), F.lit(span["b"])))
                new = results.join(done.select(*(F.col(k).alias(f"done_{k}") for k in keys)), [F.col(k) == F.col(f"done_{k}") for k in keys], "left_anti")
            if new.isEmpty():
                return 0
            staged = f"{path}/_staged/{uuid.uuid4().hex}"
            new.write.parquet(staged)
            n = spark.read.parquet(staged).count()
            if _take(spark, staged, f"{path}/version={version + 1}"):
                return n
    finally:
        results.unpersist()
