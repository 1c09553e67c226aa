"""Cutting lineage where a plan would grow with each round of a loop, and letting go of what earlier plans took."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see, as ``spark.checkpoint.dir`` names it.

    Only in local mode with the setting unset (tests) is a folder of this machine taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = os.path.join(tempfile.gettempdir(), "watchglass-shared")
    os.makedirs(folder, exist_ok=True)
    return f"file://{folder}"


#: Paths written inside each open ``scratch``, the innermost last.
_open: list[list[str]] = []


def stored(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends, and lost executors lose nothing.

    Inside a ``scratch`` the table goes with it, unless it ``outlives`` it.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _open and not outlives:
        _open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that ``stored`` has written, through the file system that holds them."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``stored`` writes inside are removed at the end; no frame that reads them may be used after it."""
    _open.append([])
    try:
        yield
    finally:
        remove(spark, _open.pop())


def give_back(spark: SparkSession) -> bool:
    """Hands memory that the driver has freed back to the system; whether its JVM did.

    Compiling plans takes and frees much memory outside of Java's heap, and the C library keeps what is freed. A JVM
    or a C library that can't be asked keeps it as before.
    """
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def array(kind: str, *values: object) -> object:
        made = gateway.new_array(getattr(jvm.java.lang, kind), len(values))
        for i, value in enumerate(values):
            made[i] = value
        return made

    try:  # what "jcmd ... System.trim_native_heap" does; through the interface, as the server's own class isn't public
        named = jvm.java.lang.Class.forName
        kinds = map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
        invoke = named("javax.management.MBeanServer").getMethod("invoke", array("Class", *kinds))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return str(invoke.invoke(server, array("Object", commands, "systemTrimNativeHeap", None, None))).startswith("Trim native heap")
    except Py4JError:
        return False
