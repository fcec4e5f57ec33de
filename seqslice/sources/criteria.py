"""Criteria text: one sequence a line, calls separated by ';', each caller/callee/line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import class_name, covers_line, method_name


def resolve(specs: DataFrame, sites: DataFrame) -> DataFrame:
    """(spec, unit_id): the first unit, by method and place, that a specification (spec) names; those that name none are left out.

    sites: unit_id, method_id, ord, line, end_line and the names class_name, method_name, callee_class, callee_name. A unit is
    named by any line that its position covers.
    """
    p = F.split("spec", "/")
    s = specs.withColumn("_p", p).where(F.size("_p") == 3)
    caller, callee = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    s = s.select("spec", class_name(caller).alias("class_name"), method_name(caller).alias("method_name"), class_name(callee).alias("callee_class"), method_name(callee).alias("callee_name"), F.get("_p", F.lit(2)).try_cast("long").alias("_line"))
    m = s.join(sites, ["class_name", "method_name", "callee_class", "callee_name"])
    m = m.where(covers_line(F.col("line"), F.col("end_line"), F.col("_line")))
    return m.withColumn("_r", F.row_number().over(Window.partitionBy("spec").orderBy("method_id", "ord", "unit_id"))).where("_r = 1").select("spec", "unit_id")


def parse(lines: DataFrame, sites: DataFrame) -> DataFrame:
    """(value, seq) of lines (value): each distinct line that is not blank, and its units; seq is null where a call cannot be
    resolved, or where there is none."""
    lines = lines.where(F.trim("value") != "").select(F.trim("value").alias("value")).distinct()
    parts = F.filter(F.split("value", ";"), lambda c: F.trim(c) != "")
    x = lines.select("value", F.posexplode_outer(parts).alias("pos", "spec")).withColumn("spec", F.trim("spec"))
    x = x.join(resolve(x.where("spec is not null").select("spec").distinct(), sites), "spec", "left")
    good = x.groupBy("value").agg(F.bool_or(F.col("unit_id").isNull()).alias("bad"), F.array_sort(F.collect_list(F.struct("pos", "unit_id"))).alias("s"))
    return good.select("value", F.when(~F.col("bad"), F.transform("s", lambda v: v["unit_id"].cast("long"))).alias("seq"))


def read(spark: SparkSession, path: str, sites: DataFrame) -> DataFrame:
    """parse() of a text file."""
    return parse(spark.read.text(path), sites)
