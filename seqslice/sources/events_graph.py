"""Graphs over the events table: units, control-flow edges and call edges, as laid down in FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

TYPES = ["click", "error", "purchase", "signup", "view"]
WIDTH = 22  # unit numbers of a method: 20 states, its entry and its exit


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, t (index of the type), k, ord (from 1 in a user's time)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type")).alias("t1"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.select("event_id", "user_id", (F.col("t1") - 1).alias("t"), "k", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("ord"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-1: src, dst, method_id: an event and the user's next one."""
    w = Window.partitionBy("user_id").orderBy("ord")
    return events(spark, sf_dir).withColumn("dst", F.lead("event_id").over(w)).where("dst is not null").select(F.col("event_id").alias("src"), "dst", F.col("user_id").alias("method_id"))


def state(e: DataFrame) -> DataFrame:
    return e.withColumn("unit", F.col("user_id") * WIDTH + F.col("t") * 4 + F.col("k") % 4)


def cfg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-2: distinct (src, dst, method_id) between states, from the entry and to the exit."""
    w = Window.partitionBy("user_id").orderBy("ord")
    e = state(events(spark, sf_dir)).withColumn("next", F.lead("unit").over(w))
    m = F.col("user_id")
    edges = F.array(
        F.when(F.col("ord") == 1, F.struct((m * WIDTH + 20).alias("src"), F.col("unit").alias("dst"))),
        F.struct(F.col("unit").alias("src"), F.coalesce("next", m * WIDTH + 21).alias("dst")),
    )
    return e.select(m.alias("method_id"), F.explode(F.array_compact(edges)).alias("e")).select("e.src", "e.dst", "method_id").distinct()


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-2: unit_id, method_id, ord, is_call; clicks and purchases are calls, purchases never have a body."""
    s = state(events(spark, sf_dir)).select("unit", "user_id").distinct()
    ends = s.select("user_id").distinct().select(F.explode(F.array(F.col("user_id") * WIDTH + 20, F.col("user_id") * WIDTH + 21)).alias("unit"), "user_id")
    ordinal = F.col("unit_id") % WIDTH
    kind = F.floor(ordinal / 4)
    u = s.unionByName(ends).select(F.col("unit").alias("unit_id"), F.col("user_id").alias("method_id"))
    return u.withColumn("ord", ordinal).withColumn("is_call", (ordinal < 20) & kind.isin(0, 2))


def calls(spark: SparkSession, sf_dir: str, acyclic: bool = False) -> DataFrame:
    """FX-3 on FX-2 units: distinct (call_unit, callee_id, method_id) of clicks whose k is a user."""
    e = state(events(spark, sf_dir)).where("t = 0")
    users = e.sparkSession.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("callee_id")).distinct()
    c = e.select(F.col("unit").alias("call_unit"), F.col("k").alias("callee_id"), F.col("user_id").alias("method_id")).distinct().join(users, "callee_id", "left_semi")
    c = c.where(F.col("callee_id") > F.col("method_id")) if acyclic else c
    return c.select("call_unit", "callee_id", "method_id")


def layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX-4: distinct (src, dst, method_id) of the layered branching graphs, two users a method, eight layers."""
    e = events(spark, sf_dir).where("ord <= 8").withColumn("m", F.floor(F.col("user_id") / 2)).withColumn("n", F.col("m") * 1000 + F.col("ord") * 10 + F.col("t"))
    w = Window.partitionBy("user_id").orderBy("ord")
    e = e.withColumn("next", F.lead("n").over(w))
    edges = F.array(
        F.when(F.col("ord") == 1, F.struct((F.col("m") * 1000).alias("src"), F.col("n").alias("dst"))),
        F.struct(F.col("n").alias("src"), F.coalesce("next", F.col("m") * 1000 + 999).alias("dst")),
    )
    return e.select(F.col("m").alias("method_id"), F.explode(F.array_compact(edges)).alias("e")).select("e.src", "e.dst", "method_id").distinct()


def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, seq): sequences over FX-2 that end at main's first purchase: its last purchase before it, and the first
    purchase of each method that main calls."""
    p = state(events(spark, sf_dir)).where("t = 2").groupBy("user_id").agg(F.min("unit").alias("low"), F.max("unit").alias("high"))
    main = p.where("user_id = 0").select(F.col("low").alias("tail"), "high")
    callee = calls(spark, sf_dir).where("method_id = 0").select(F.col("callee_id").alias("user_id")).distinct()
    # main is one row
    heads = p.join(callee, "user_id").select(F.col("low").alias("h")).crossJoin(F.broadcast(main)).select("h", "tail")
    heads = heads.unionByName(main.select(F.col("high").alias("h"), "tail")).where("h <> tail").distinct()
    return heads.select(F.col("h").alias("seq_id"), F.array("h", "tail").alias("seq"))


def two_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq): criteria(), and main's first purchase before its last one, a second group."""
    p = state(events(spark, sf_dir)).where("t = 2 AND user_id = 0").agg(F.min("unit").alias("low"), F.max("unit").alias("high"))
    return criteria(spark, sf_dir).select("seq").unionByName(p.where("low <> high").select(F.array("low", "high").alias("seq")))
