"""python -m seqslice -sc-file FILE -program FOLDER [-out-dir FOLDER] ...: slices by a criteria file, over a program's tables."""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.text import elapsed_text, parse_boolean
from .plans import slicing
from .plans.slicing import Options
from .sinks import report
from .sources import criteria
from .sources.program import Program

TEXTS = {"-sc-file": "sc_file", "-program": "program", "-out-dir": "out_dir", "-main-class": "main_class"}
FLAGS = {"-extend-sc": "extend_sc", "-retain-cycle": "retain_cycle", "-exclude-library": "exclude_library", "-exclude-library-extension": "exclude_library_extension"}


def parse(args: list[str]) -> Options:
    """Options of a command line. Only "true", in any case, is true; -block-package-prefix may stand more than once."""
    out, left = Options(), list(args)
    while left:
        name = left.pop(0)
        if name not in {*TEXTS, *FLAGS, "-block-package-prefix"}:
            raise ValueError(f"Unknown option: {name}")
        if not left:
            raise ValueError(f"{name} needs a value")
        value = left.pop(0)
        if name in TEXTS:
            setattr(out, TEXTS[name], value)
        elif name in FLAGS:
            setattr(out, FLAGS[name], parse_boolean(value))
        else:
            out.block_package_prefix.append(value)
    return out


def run(spark: SparkSession, options: Options) -> DataFrame:
    """Reads, slices and writes; returns the slices (tail_unit, method_id, unit_id)."""
    if not options.sc_file or not options.program:
        raise ValueError("-sc-file and -program are needed")
    log, began = [], time.time()
    program = Program.read(spark, options.program).staged()
    main = slicing.main_method(program, options.main_class)
    nodes = slicing.reachable_units(program, main).select("unit_id")
    sites = program.sites().join(nodes, "unit_id", "left_semi")
    found = criteria.read(spark, options.sc_file, sites)
    sequences, bad = found.where("seq IS NOT NULL").select("seq").distinct(), found.where("seq IS NULL")
    log += [f"skipped: {r['value']}" for r in bad.orderBy("value").collect()]
    log += [f"> {r['text']}" for r in report.criteria_texts(sequences, program).orderBy("text").collect()]
    if sequences.isEmpty():
        log.append("no criteria could be read")
    slices = slicing.slices(program, sequences, options, main)
    tails = sequences.select(F.element_at("seq", -1).alias("tail_unit")).distinct()
    for r in tails.join(slices, "tail_unit", "left_anti").orderBy("tail_unit").collect():
        log.append(f"the slice of {r['tail_unit']} is empty: its criteria cannot be met")
    class_name = program.methods.where(F.col("method_id") == main).join(program.classes.select("class_id", F.col("name").alias("class_name")), "class_id").first()["class_name"]
    log.append(f"elapsed time: {elapsed_text(int(1000 * (time.time() - began)))}")
    report.write(slices, program, options.out_dir, report.file_names(program, tails, options.extend_sc, class_name), log)
    return slices


def main(args: list[str]) -> int:
    if not args or "-help" in args:
        print(__doc__, "options:", " ".join([*TEXTS, *FLAGS, "-block-package-prefix"]))
        return 0
    options = parse(args)
    spark = SparkSession.builder.getOrCreate()
    print(f"{run(spark, options).count()} units in slices, written to {options.out_dir}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
