"""What the training-data operators share."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions of this package travel to the executors by value, so a cluster
# needs no copy of the package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: a Parquet table in the shared checkpoint folder.

    Unlike a checkpoint() the table has its own statistics: those of a checkpointed plan
    are products over all joins before it and outgrow the driver in an iteration.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str = "harrow") -> str:
    """A new folder below the one that the cluster names in ``spark.checkpoint.dir``, deleted when the driver ends.

    Where that setting is missing a temporary folder is used, but only if driver and executors are one process.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = _own_folder()
    path = f"{top}/{name}/{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="harrow-")


def shared(spark: SparkSession, value: object):
    """A function that gives ``value`` on the executors; its ``drop`` frees the copies there.

    The value is broadcast as bytes that hold the classes of this package too; a
    plain broadcast would look for the package on the workers.
    """
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get() -> object:
        return cloudpickle.loads(held.value)

    get.drop = held.unpersist
    return get


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task``, the function of a Python task over batches, whose worker gives back at its end what it has freed.

    Workers stay for later tasks, and so do the free parts of their heap and of Arrow's pool, and
    the globals of functions that came by value, which only the collector of cycles frees.
    """

    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Free memory of this process goes back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on the session hands Python at most ``rows`` rows at once, for rows that hold whole texts: each batch stands
    in buffers outside the heap of its executor, twice for what comes back, and in its worker. A lower setting stays."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= rows:
        spark.conf.set(BATCH_ROWS, rows)


PASSAGES = "array<struct<start:int,stop:int>>"


def merged(spans: Column) -> Column:
    """Sorted spans (start, stop) with those that overlap or touch as one."""

    def join(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            out = []
            for own in column:
                found: list[dict] = []
                for s in own:
                    if found and s["start"] <= found[-1]["stop"]:
                        found[-1]["stop"] = max(found[-1]["stop"], s["stop"])
                    else:
                        found.append({"start": s["start"], "stop": s["stop"]})
                out.append(found)
            yield pd.Series(out)

    return F.pandas_udf(join, PASSAGES)(spans)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z only, as the contracts ask; lower() would fold other letters too."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns; further columns of the input, whatever their names, stay out of the way."""
    return docs.select(*[docs[c].alias(c) for c in columns])


def lookup(df: DataFrame, width: Column | int = 16, most: int = 16 << 20) -> DataFrame:
    """A materialised side of a join: broadcast once its summed ``width`` in bytes proves to be at most ``most``;
    beyond that the join is left to Spark, which shuffles both sides."""
    size = df.agg(F.sum(F.lit(width) if isinstance(width, int) else width).alias("n")).first().n or 0
    return F.broadcast(df) if size <= most else df


def matching(rows: DataFrame, wanted: DataFrame, on: str, salt: str, salts: int = 32, most: int = 16 << 20) -> DataFrame:
    """The rows whose ``on`` is in ``wanted`` (materialised, one column without repeats).

    Where ``wanted`` is too large to broadcast, both sides are dealt by ``on``
    and a hash of ``salt``, so that the rows of one hot value meet in ``salts`` tasks, not in one.
    """
    if wanted.count() * 16 <= most:
        return rows.join(F.broadcast(wanted), on)
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    return dealt.join(wanted.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [on, "__salt"]).drop("__salt")


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def packed(docs: DataFrame, **named: str) -> DataFrame:
    """Every row as one struct ``kept`` beside the named columns, so that no column of the input can clash with an operator's."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("kept"), *[docs[c].alias(n) for n, c in named.items()])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component) for every node of the links.

    Each round points every node at the least of itself and its neighbours and
    contracts the links: in the first round by value, which settles stars around
    their least node, then by a hash drawn anew each round, so that
    components of any shape, paths too, lose a constant share of their nodes. Links
    are aggregated before they are shuffled; nothing is collected.
    """
    edges = materialise(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    at, k = None, 0
    while at is None or not edges.isEmpty():
        rank = lambda c: F.struct((F.xxhash64(c, F.lit(k)) if k else F.col(c)).alias("p"), F.col(c).alias("n"))  # noqa: B023, E731
        both = edges.select("u", rank("v").alias("r")).union(edges.select("v", rank("u").alias("r")))
        step = materialise(both.groupBy("u").agg(F.min("r").alias("r")).select("u", F.least("r", rank("u"))["n"].alias("to")))
        at = step.toDF("node", "at") if at is None else at.join(step.toDF("at", "to"), "at", "left").select("node", F.coalesce("to", "at").alias("at"))
        moved = edges.join(step.toDF("u", "x"), "u").join(step.toDF("v", "y"), "v").where("x <> y")
        edges, k = materialise(moved.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()), k + 1
    at = materialise(at)
    return materialise(at.join(at.groupBy("at").agg(F.min("node").alias("root")), "at").select("node", "root"))
