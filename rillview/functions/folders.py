"""Folders of intermediate results: below the one that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_top(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only where the session names none and everything runs in one process."""
    if not (top := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="rillview-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted at the latest when the application ends."""
    path = f"{shared_top(spark)}/{name}-{uuid.uuid4().hex}"
    where, system = _place(spark, path)
    system.deleteOnExit(where)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where, system = _place(spark, path)
    system.delete(where, True)


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    where, system = _place(spark, folder)
    return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file is there whole or not at all."""
    where, system = _place(spark, path)
    begun, _ = _place(spark, f"{path}.begun")
    out = system.create(begun, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    system.delete(where, False)
    system.rename(begun, where)


def read_text(spark: SparkSession, path: str) -> str:
    where, system = _place(spark, path)
    into = system.open(where)
    try:
        return bytes(into.readAllBytes()).decode("utf-8")
    finally:
        into.close()
