"""Shared storage for frames that must not be computed twice."""

from __future__ import annotations

import io
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one, if driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tabloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def trim(spark: SparkSession) -> str:
    """Give the system back what the driver's JVM has freed outside its heap; what the JVM says of it (empty: it can't).

    A plan of many jobs starts hundreds of driver threads, and the C library keeps what they free, by thread."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = array(jvm.Object, 4)  # Py4J sees an interface's methods only by reflection
        args[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        args[1] = "systemTrimNativeHeap"
        return call.invoke(server, args)
    except Py4JError:  # neither HotSpot from 17.0.9 on, nor glibc
        return ""


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again."""
    at = f"{shared_dir(df.sparkSession)}/tabloom/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class _Output(io.RawIOBase):
    """A file that Spark's stores hold, written from the driver."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        self._out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self._out.write(bytes(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self._out.close()
        super().close()


def open_output(path: str, text: bool = False):
    """A buffered file at any path that Spark writes to, for what is written row by row in order."""
    raw = io.BufferedWriter(_Output(SparkSession.getActiveSession(), path), 1 << 20)
    return io.TextIOWrapper(raw, encoding="utf-8", newline="") if text else raw
