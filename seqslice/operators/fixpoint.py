"""Semi-naive fixpoints over DataFrames. Every round is a table in the shared folder, so lineage stays short and a lost
executor costs one round. Least fixpoints end by themselves: nothing bounds the number of rounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqslice-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Tables that no later round reads."""
    for x in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(x)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fixpoint(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], merge: int = 16, linear: bool = False, hops: int = 16) -> DataFrame:
    """The least relation that holds seed and step's results. step gets (new rows, all rows) and may return known rows.

    The relation is the rounds' tables together; every merge tables become one, so that few files are listed and read, and
    what was merged is removed. linear: step looks at new rows alone. Later rounds then take several steps at once, up to
    hops, so that long chains need few rounds.
    """
    spark, cols = seed.sparkSession, seed.columns
    base = f"{shared_dir(spark)}/fixpoint-{uuid.uuid4().hex}"
    read = lambda *p: spark.read.schema(seed.schema).parquet(*p)
    seed.distinct().write.parquet(f"{base}/0")
    paths, last, spent, k = [f"{base}/0"], f"{base}/0", [], 0
    while True:
        k += 1
        every = read(*paths)
        found = x = step(read(last), every).select(*cols)
        for _ in range(min(hops, 2 ** (k // 4)) - 1 if linear else 0):
            x = step(x.distinct(), every).select(*cols)
            found = found.unionByName(x)
        new = found.distinct().join(every, cols, "left_anti")
        last = f"{base}/{k}"
        new.write.parquet(last)
        remove(spark, *spent)
        spent = []
        if read(last).isEmpty():
            return every
        paths.append(last)
        if len(paths) > merge:
            read(*paths).write.parquet(f"{base}/to-{k}")
            # the newest table is the next round's input
            paths, spent = [f"{base}/to-{k}"], paths


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node) reachable from seeds (node), themselves included, along edges (src, dst)."""
    e = stage(edges.select("src", "dst").distinct())
    return fixpoint(seeds.select("node"), lambda d, _: d.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")), linear=True)


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) joined by a path of one edge or more. Rounds grow with the logarithm of the longest path (squaring)."""
    every = stage(edges.select("src", "dst").distinct())
    n = every.count()
    while True:
        b = every.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
        every = stage(every.unionByName(every.join(b, F.col("dst") == F.col("mid")).select("src", F.col("end").alias("dst"))).distinct())
        m = every.count()
        if m == n:
            return every
        n = m
