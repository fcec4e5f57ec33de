"""Shared plumbing of the training-data operators: shared-folder staging, row keys, native text helpers."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Word separators of the operators whose words are runs of ASCII letters, digits and non-ASCII characters.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the operators that split on ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqslice-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors cost nothing before it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand Python at most rows rows at a time: texts are long, and a batch is held on both sides."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def drop_stage(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(conf).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing holds any more go when the driver collects its garbage, which with little of it
    may come after the next large shuffle. Spark's listeners hold the newest plan until there is another: a small one here."""
    spark.range(1).collect()
    gc.collect()
    spark._jvm.System.gc()


def staged_bytes(df: DataFrame) -> int:
    """Size of a staged table as Spark's own statistics give it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Staged tables of at most so many bytes are broadcast.
SMALL = 8 << 20


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Broadcast hint for a staged table, only where its measured size is under limit; else the planner's join."""
    return F.broadcast(df) if staged_bytes(df) <= (SMALL if limit is None else limit) else df


def split_by_keys(df: DataFrame, cols: list[str], keys: DataFrame, of: list[str]) -> tuple[DataFrame, DataFrame]:
    """df in two: rows whose cols may be a row of keys (columns of), and rows whose cols are none. For joins of wide rows with
    a staged table of keys: where that is too large to be broadcast, only the first part need be dealt out. Nulls are values.

    The test is one bit a hash, in bitmaps of 64 bits a key, 8 MiB at most: with over a million keys more rows pass.
    """
    if staged_bytes(keys) <= SMALL:
        return df, df.limit(0)
    per = 32768  # bits of Spark's bitmaps
    buckets = max(1, min(2048, -(-64 * keys.count() // per)))
    place = lambda c: F.pmod(F.xxhash64(F.lit(5), *c), F.lit(per * buckets)).alias("_at")
    bits = keys.select(place(of)).groupBy(F.expr(f"_at div {per}").alias("_bucket")).agg(F.bitmap_construct_agg(F.expr(f"_at % {per}")).alias("_bits"))
    x = df.withColumn("_at", place(cols)).join(F.broadcast(stage(bits, "key-bits")), F.expr(f"_at div {per} = _bucket"), "left")
    hit = F.expr(f"coalesce(shiftright(cast(conv(hex(substring(_bits, cast((_at % {per}) div 8 AS int) + 1, 1)), 16, 10) AS int), cast(_at % 8 AS int)) & 1, 0) = 1")
    return x.where(hit).select(*df.columns), x.where(~hit).select(*df.columns)


def row_key(*cols: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols])


def same(left: DataFrame, right: DataFrame, *cols: str) -> Column:
    """Null-safe equality on cols, as a join condition."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def ascii_lower(c: Column) -> Column:
    """A-Z only, whatever else the text holds."""
    return F.translate(c, UPPER, UPPER.lower())


def plain_words(c: Column) -> Column:
    """Lower-cased words joined by single spaces; null and wordless texts give ''."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(c, F.lit(""))), NON_WORD, " "))


def count_plain(t: Column) -> Column:
    """Number of words in a text of plain_words()."""
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(col)).alias("b")).first()["b"] or 0)


def parts_for(n_bytes: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(n_bytes / each))
