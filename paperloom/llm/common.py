"""Helpers shared by the training-data operators: scratch tables, stable keys, distributed ranks."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import threading
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

class _Scratch(threading.local):
    """Scratch tables by owner; each thread has its own, so runs side by side in one driver don't delete each other's."""

    def __init__(self) -> None:
        self.paths: dict[str, list[str]] = {}


_scratch = _Scratch()
_own_dir: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; only a local master without it gets a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="paperloom-")
    return _own_dir[app]


def scratch(spark: SparkSession, owner: str) -> str:
    """A new path in the shared folder, which ``drop`` deletes."""
    path = f"{checkpoint_dir(spark)}/paperloom/{owner}-{uuid.uuid4().hex}"
    _scratch.paths.setdefault(owner, []).append(path)
    return path


def materialize(df: DataFrame, owner: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, owner)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(owner: str, spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete an owner's scratch tables that nothing reads any more: those after the first ``since``, but the last ``keep``."""
    paths = _scratch.paths.get(owner, [])
    end = len(paths) - keep
    gone, _scratch.paths[owner] = paths[since:end], paths[:since] + paths[max(since, end) :]
    for p in gone:
        delete(spark, p)


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    files, where = _folder(spark, path)
    files.delete(where, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder, on whatever file system it is; none if it doesn't exist."""
    files, where = _folder(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(where) if f.isDirectory()) if files.exists(where) else []


def written(owner: str) -> int:
    """How many scratch tables an owner has now, for ``drop(since=...)``."""
    return len(_scratch.paths.get(owner, []))


def release(spark: SparkSession) -> str | None:
    """Give back the driver's memory that nothing uses any more, for callers that run many jobs one after another.

    Dead plans and broadcasts go from the heap, and native memory that was freed goes back to the
    system: the JVM's allocator keeps it otherwise, most of it in its threads' arenas. Returns what
    the JVM says of it; one without that command keeps it (None).
    """
    context = spark.sparkContext
    jvm = context._jvm
    gc.collect()
    jvm.System.gc()
    with contextlib.suppress(Py4JError):
        # by the interface's method, as the server's class is not open to Py4J
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = context._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    return None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one window of a class should rank, if the whole table were of that class.
WINDOW_ROWS = 500_000


def class_rank(df: DataFrame, by: list[str], order: list[str], rows: int, salts: int = 64, to: str = "rank") -> DataFrame:
    """0-based gapless rank of each row within the class ``by``, in a table of ``rows`` rows.

    A class may hold any share of the rows: it is dealt over ``salts`` windows, or as many as the
    table's rows call for, by a hash of ``order``, and the windows' starts come from a prefix sum
    over their counts.
    """
    salts = max(salts, -(-rows // WINDOW_ROWS))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    keys = [*by, "_salt"]
    counts = salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*keys).orderBy(*order)
    ranked = salted.withColumn("_rank", F.row_number().over(own) - 1)
    on = [ranked[k].eqNullSafe(starts[k]) for k in by] + [ranked["_salt"] == starts["_salt"]]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    return ranked.join(starts, cond).select(*[ranked[c] for c in df.columns], (starts["_start"] + ranked["_rank"]).alias(to))


def utf8_len(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: Bytes of rows that Spark hands to Python at once, unless the session says otherwise: whole texts come in any length.
BATCH_BYTES = 8 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; absent columns become nulls, so extra or clashing columns do no harm."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, _BATCH_DEFAULT) in (None, _BATCH_DEFAULT):
        conf.set(_BATCH_CONF, BATCH_BYTES)
    low = {c: c for c in df.columns}
    return df.select(*[(df[f"`{low[c]}`"] if c in low else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


#: Tables of ids of up to this many rows (16 MB of longs) are broadcast; beyond, both sides are shuffled.
BROADCAST_IDS = 2_000_000


def checked_broadcast(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` (a written table of a few fixed-size columns) for a join, broadcast only if its counted size is within the limit."""
    return F.broadcast(ids) if ids.count() <= limit else ids
