"""What a run writes: one text a tail, named after it, the slices as Parquet by tail, and a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text
from ..sources.program import Program

#: Lines of the slice file.
RULE, HEADER = "=" * 58, "Units in the tailored program:"


def lines(slices: DataFrame, program: Program) -> DataFrame:
    """(tail_unit, signature, pos, line): for each method of a slice, by signature, a rule, its name, a header, and its units in
    body order."""
    s = slices.join(program.units.select("unit_id", "ord", "line", "text"), "unit_id").join(program.methods.select("method_id", "signature"), "method_id")
    unit = s.select("tail_unit", "signature", "method_id", F.concat(F.lit("3"), F.format_string("%012d", "ord"), F.format_string("%020d", "unit_id")).alias("k"), text.unit_text(F.col("text"), F.col("line")).alias("line"))
    head = F.array(F.struct(F.lit("0").alias("k"), F.lit(RULE).alias("line")), F.struct(F.lit("1").alias("k"), F.concat(F.lit("Method: "), F.col("signature")).alias("line")), F.struct(F.lit("2").alias("k"), F.lit(HEADER).alias("line")))
    heads = s.select("tail_unit", "signature", "method_id").distinct().select("tail_unit", "signature", "method_id", F.explode(head).alias("x")).select("tail_unit", "signature", "method_id", "x.k", "x.line")
    order = Window.partitionBy("tail_unit").orderBy("signature", "method_id", "k")
    return unit.unionByName(heads).withColumn("pos", F.row_number().over(order)).select("tail_unit", "signature", "pos", "line")


def call_texts(program: Program) -> DataFrame:
    """(unit_id, call): every call as the criteria file writes it."""
    s = program.sites().where("is_call")
    return s.select("unit_id", text.call_text(F.concat_ws(".", "class_name", "method_name"), F.concat_ws(".", "callee_class", "callee_name"), F.col("line")).alias("call"))


def criteria_texts(sequences: DataFrame, program: Program) -> DataFrame:
    """(seq, text): sequences as the criteria file writes them, each call followed by a semicolon."""
    x = sequences.select("seq", F.posexplode("seq").alias("i", "unit_id")).join(call_texts(program), "unit_id")
    by = x.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("i", "call"))).alias("a"))
    return by.select("seq", F.concat(F.array_join(F.transform("a", lambda v: v["call"]), ";"), F.lit(";")).alias("text"))


def file_names(program: Program, tails: DataFrame, extended: bool, main_class: str) -> DataFrame:
    """(tail_unit, name) of tails (tail_unit): caller, callee and line in short names."""
    s = program.sites().select(F.col("unit_id").alias("tail_unit"), "class_name", "method_name", "callee_class", "callee_name", "line").join(tails, "tail_unit", "left_semi")
    short = lambda c: text.short_name(F.col(c))
    name: Column = F.concat(short("class_name"), F.lit("."), F.col("method_name"), F.lit(";"), short("callee_class"), F.lit("."), F.col("callee_name"), F.lit(";"), F.col("line").cast("string"), F.lit("-ext" if extended else ""), F.lit(f"-all-{main_class}.output"))
    return s.select("tail_unit", name.alias("name"))


def facts(passed: DataFrame, program: Program) -> DataFrame:
    """(pos, class_name, signature, unit_id, fact) of facts (n, f) at application units, by class, signature and body order."""
    sites = program.sites().join(program.classes.where("not is_library").select("class_id"), "class_id", "left_semi")
    x = passed.join(sites.select(F.col("unit_id").alias("n"), "class_name", "signature", "ord"), "n").select("class_name", "signature", "ord", F.col("n").alias("unit_id"), F.col("f").alias("fact"))
    # a method's rows are numbered apart: no task holds all of them
    return x.withColumn("pos", F.row_number().over(Window.partitionBy("class_name", "signature").orderBy("ord", "unit_id", "fact"))).drop("ord")


def write(slices: DataFrame, program: Program, out_dir: str, names: DataFrame, log: list[str]) -> None:
    """Under out_dir: slices (Parquet by tail_unit), text/tail_unit=n/<name>, and log.txt. A tail is one file, so that it can be
    read on its own; tails with the same name do not meet."""
    spark = slices.sparkSession
    slices.write.mode("overwrite").partitionBy("tail_unit").parquet(f"{out_dir}/slices")
    x = lines(slices, program).repartition("tail_unit").sortWithinPartitions("tail_unit", "pos")
    x.select("tail_unit", "line").write.mode("overwrite").partitionBy("tail_unit").text(f"{out_dir}/text")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(out_dir).getFileSystem(conf)
    for r in names.collect():  # tails of a text that was written by hand
        found = fs.globStatus(path(f"{out_dir}/text/tail_unit={r['tail_unit']}/part-*"))
        to = path(f"{out_dir}/text/tail_unit={r['tail_unit']}/{r['name']}")
        if found:
            fs.rename(found[0].getPath(), to)
        else:  # an empty slice is an empty file
            fs.create(to).close()
    stream = fs.create(path(f"{out_dir}/log.txt"))
    stream.write(bytearray("".join(f"{x}\n" for x in log).encode()))
    stream.close()
