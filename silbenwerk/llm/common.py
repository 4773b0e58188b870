"""Small helpers that the operators of this subpackage share."""
from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share; a local one only on a local master where none is configured (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


ROWS_A_FILE = 200_000


def cut(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder.

    Spark removes them there when nothing refers to them if spark.cleaner.referenceTracking.cleanCheckpoints is set.

    most_rows, where a bound is known: small tables then fill a few files, not one per task.
    """
    shared_dir(df.sparkSession)
    if most_rows is not None:
        df = df.coalesce(most_rows // ROWS_A_FILE + 1)
    return df.checkpoint()


class Scratch:
    """Bulky intermediate tables in the shared folder; `drop` removes them when the slim result exists."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, *by: str) -> DataFrame:
        """by: columns with a folder for each value, so that a reader opens only what it needs."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def no_rows(*columns: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def give_back() -> None:
    """Memory that is free in this process goes back to the system.

    A Python worker outlives its task, and without this keeps what its largest block took while other stages run.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only glibc has it


def lean_batches(run: Callable) -> Callable:
    """A function for mapInArrow that gives its memory back when a task ends."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return lean


def lean_group(run: Callable) -> Callable:
    """A function for applyInPandas that gives its memory back after each group."""

    def lean(group: pd.DataFrame) -> pd.DataFrame:
        out = run(group)
        give_back()
        return out

    return lean


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of df, used to choose how many hash buckets the work is split into."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, each: int, least: int = 16, most: int = 1 << 16) -> int:
    """A power of two, growing with the input: one bucket for about `each` bytes; beyond `most`, for up to 64 times as much.

    The size of rows that come from no file is unknown; 256 buckets then.
    """
    size, n = planned_bytes(df), least
    want = size / each if size < 1 << 60 else 256
    while n < want and (n < most or want > 64 * n):
        n *= 2
    return n


def crc_mod(col, n: int):
    return F.crc32(col.cast("string").cast("binary")) % n


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components: edges(a, b) -> (node, comp), comp the least node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each is a grouping by
    min, which combines before the shuffle; the edge table never grows beyond the input's order,
    and is cut to the shared folder after each round. Self-loops are allowed.
    """
    both = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
    nodes = both.select(F.col("a").alias("node")).union(both.select(F.col("b"))).distinct()
    cur = cut(both.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen, size = None, cur.count()
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked with u's least neighbour
        sym = cur.union(cur.select("b", "a"))
        least = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sym.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours are linked with the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "a", "m")
        cur = cut(small.select(F.col("x").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), 2 * size)
        now = cur.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    return nodes.join(cur.groupBy("a").agg(F.min("b").alias("b")).withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("comp"))
