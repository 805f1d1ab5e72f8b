"""What the operators of this subpackage share: the shared folder, written tables, word rules."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import re
import sys
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are none of space, tab, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor see.

    It is the one named in ``spark.checkpoint.dir``; only where that is unset and all runs on one machine
    a local folder is made the checkpoint folder. On a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
        path = "file:///tmp/checkpoints/sediment"
        spark.conf.set("spark.checkpoint.dir", path)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch():
    """Tables that are written while it lasts go when it ends, however it ends; those to keep go with the scope around it."""
    _scopes.append([])
    try:
        yield
    finally:
        drop(*_scopes.pop())


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` as a written table: lineage ends here, lost executors lose nothing.

    ``keep`` is for tables that a result still reads when the operator's ``scratch`` has ended.
    """
    path = fresh(df.sparkSession, name)
    out = df.sparkSession.read.schema(df.schema)
    df.write.parquet(path)
    out = out.parquet(path)
    out.staged = path
    if len(_scopes) > keep:
        _scopes[-1 - keep].append(out)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(t.staged)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def unused(columns: list[str], name: str) -> str:
    """The name, or one made from it, that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


#: Rows of a key that a task takes in any case if they are ids alone, and hot keys for each task at most.
HOT_ROWS, HOT_KEYS = 4096, 4


def hot_keys(counts: DataFrame, total: int, least: int = HOT_ROWS) -> DataFrame | None:
    """Of ``counts``, whose column ``n`` counts the rows of a key, those keys that hold more than a task's share of all ``total``
    rows, with ``parts``, the number of tasks that they are dealt over.

    A key is hot from a part of 1 / HOT_KEYS of a task's even share on, so there are no more hot keys than HOT_KEYS times the
    number of shuffle partitions, whatever the input. ``least`` rows of a key are no matter for a task.
    """
    spark = counts.sparkSession
    most = max(least, total // (HOT_KEYS * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if total <= most:
        return None
    hot = stage(counts.filter(F.col("n") > most).withColumn("parts", F.ceil(F.col("n") / most).cast("int")).coalesce(1), "hot-keys")
    return None if hot.isEmpty() else hot


def dealt_join(rows: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one``, which has a row for a key at most; rows of hot keys are dealt over tasks by a hash of
    all their columns and of the partition they come from, and their row of ``one`` is repeated for each of those tasks."""
    if hot is None:
        return rows.join(one, keys, how)
    few = F.broadcast(hot.select(*keys, F.col("parts").alias("_parts")))  # bounded, see hot_keys
    dealt = rows.join(few, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.coalesce("_parts", F.lit(1))).cast("int"))
    each = one.join(few, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return dealt.drop("_parts").join(each.drop("_parts"), [*keys, "_part"], how).drop("_part")


def filesystem(uri: str):
    """The Arrow file system and the path in it, for executors that read and write files of their own format."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:/") else "file://" + uri[5:])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of ``text``; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def crc32_ids(ids) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def worker_threads() -> None:
    """Keeps native libraries in Python workers to the one core that a task has."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("OMP_NUM_THREADS", "1")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


#: Rows of an Arrow batch: texts vary in length, and batches of texts or sets lie in the JVM and in Python at once.
BATCH_ROWS = 2000


@contextlib.contextmanager
def tuned(spark: SparkSession):
    """Smaller Arrow batches while it lasts, and Python workers that give memory back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    env = spark.sparkContext.environment
    for k, v in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "2"), ("MALLOC_TRIM_THRESHOLD_", str(1 << 20))):
        env.setdefault(k, v)
    spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def lean(run):
    """A function of batches that begins without what other operators keep in the worker, and ends without its own waste."""

    @functools.wraps(run)
    def lighter(batches):
        if encoding := sys.modules.get("sediment.llm.encoding"):
            encoding.release()
        yield from run(batches)
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return lighter
