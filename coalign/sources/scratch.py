"""Stage tables in the shared scratch folder (S05, S06): written once, read by what follows."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``. It is removed when the driver ends.

    Where that is unset, a local session uses a temporary folder; a cluster, whose
    machines don't share one, gets an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = base or "file://" + tempfile.mkdtemp(prefix="coalign-")
        _own[app] = f"{base.rstrip('/')}/coalign-{app}"
        atexit.register(_remove, spark, _own[app])
    return _own[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session has ended already
        pass


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writers, _before = threading.Lock(), 0, "false"


@contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Writes in here drop their shuffle files when they are done: what they made is read from their table."""
    global _writers, _before
    with _lock:
        if not _writers:
            _before = spark.conf.get(_CLEANUP, "false")
            spark.conf.set(_CLEANUP, "true")
        _writers += 1
    try:
        with tended(spark):
            yield
    finally:
        with _lock:
            _writers -= 1
            if not _writers:
                spark.conf.set(_CLEANUP, _before)
        _let_go(spark)


#: Seconds between two looks at the driver's memory, and the most where collecting has been no use.
PAUSE, LONGEST = 5, 60
_tended, _over = 0, threading.Event()


@contextmanager
def tended(spark: SparkSession) -> Iterator[None]:
    """While what is in here runs, which may be many jobs or a long one, memory of the driver is given back again and again, by one thread for all that runs at once."""
    global _tended, _over

    def tend(over: threading.Event) -> None:
        pause = PAUSE
        while not over.wait(pause):
            try:
                pause = PAUSE if _let_go(spark) else min(2 * pause, LONGEST)
            except Exception:  # the session has ended
                return

    with _lock:
        if not _tended:
            _over = threading.Event()
            thread = InheritableThread(target=tend, args=(_over,))
            thread.daemon = True
            thread.start()
        _tended += 1
    try:
        yield
    finally:
        with _lock:
            _tended -= 1
            if not _tended:
                _over.set()


def _let_go(spark: SparkSession) -> bool:
    """Gives memory of the driver that is only kept for later back to the system: of its heap, where that has grown to half of what it may have, and of what its compilers and codecs have freed.

    What lives there between stage tables is a small part of both. Shuffle files and broadcasts that nothing refers to any more go too.
    Returns whether the heap is within that half now.
    """
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        jvm.java.lang.System.gc()
    try:
        _trim(spark)
    except Py4JError:  # a JVM without that command
        pass
    return 2 * runtime.totalMemory() <= runtime.maxMemory()


def _executors(spark: SparkSession) -> int:
    """How many there are besides the driver, which is all that a local session has."""
    return max(0, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)


def relieve(spark: SparkSession) -> None:
    """Has each executor collect its heap, which otherwise stays as large as it has ever been, though little of it lives between stage tables.

    A process that an executor starts, such as one to set a file's mode, counts as
    large as the executor's JVM until it has become that process. As many tasks as
    executors are dealt out one to each where all have a core free.
    """
    if n := _executors(spark):
        spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


def _trim(spark: SparkSession) -> None:
    """The JVM's command System.trim_native_heap, by the interface of its server, as the class is not open."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    text, thing = jvm.java.lang.String, jvm.java.lang.Object
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
    given = new_array(thing, 4)
    for k, v in enumerate((jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", new_array(thing, 0), new_array(text, 0))):
        given[k] = v
    invoke.invoke(server, given)


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """The same rows, read back from a table in the shared scratch folder.

    This cuts the lineage: what comes later does not depend on shuffle files of
    executors that may be lost, and these are dropped once the table is there.
    """
    spark = df.sparkSession
    path, schema = f"{scratch_dir(spark)}/{uuid.uuid4().hex}", df.schema
    writer = df.write.option("compression", "zstd")
    with _without_leftovers(spark):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._scratch = path
    return back


def cut_in_turn(parts: Iterable[DataFrame]) -> DataFrame:
    """The rows of ``parts``, which have the same columns, from one table: a part is asked for and written when the one before is there and its shuffle files are gone."""
    path = schema = None
    for df in parts:
        spark = df.sparkSession
        path, schema = path or f"{scratch_dir(spark)}/{uuid.uuid4().hex}", df.schema
        with _without_leftovers(spark):
            df.write.mode("append").option("compression", "zstd").parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._scratch = path
    return back


def cut_buckets(df: DataFrame, key: str) -> DataFrame:
    """Like ``cut``, with the rows in as many buckets by ``key`` as there are shuffle partitions.

    What groups or joins by the key later reads the rows in place and shuffles the
    other side only.
    """
    spark = df.sparkSession
    name = f"coalign_{uuid.uuid4().hex}"
    path, buckets = f"{scratch_dir(spark)}/{name}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _without_leftovers(spark):
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    back = spark.table(name)
    back._scratch = path
    return back


def drop(*tables: DataFrame, part: str = "") -> None:
    """Deletes stage tables, or a ``part`` of them (column=value), that nothing will read any more."""
    for table in tables:
        _delete(table.sparkSession, f"{table._scratch}/{part}".rstrip("/"))
