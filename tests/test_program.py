"""A small program from tables to slice files, its extension, and the graph algorithms against plain Python."""

import random

import pytest

from seqslice import __main__ as cli
from seqslice.operators import dominance, extension, graph
from seqslice.plans import slicing
from seqslice.sources.program import SCHEMAS, Program


def program(spark, **rows):
    return Program(**{t: spark.createDataFrame(rows.get(t, []), s) for t, s in SCHEMAS.items()})


def unit(i, m, line, call=None, kind=None, base=None, local=None, new=None, text=None):
    return (i, m, i % 100, line, line, text or f"u{i}", call is not None, kind, call, base, local, None, False, False, new)


def tutorial(spark):
    """A.main makes a B and calls foo and bar on it, in lines 3 to 5; b's methods have no bodies."""
    methods = [(0, 0, "main", "<A: void main()>", True, False, True), *((-k, 1, n, f"<B: void {n}()>", False, n == "<init>", False) for k, n in ((1, "<init>"), (2, "foo"), (3, "bar")))]
    units = [unit(0, 0, 3, local=7, new=1, text="b = new B"), unit(1, 0, 3, -1, "special", 7), unit(2, 0, 4, -2, "virtual", 7, text="b.foo()"), unit(3, 0, 5, -3, "virtual", 7, text="b.bar()"), unit(4, 0, -1, text="return")]
    return program(spark, units=units, methods=methods, classes=[(0, "A", "", False, False), (1, "B", "", False, False)], cfg=[(k, k + 1, 0, False) for k in range(4)])


def test_command_line(spark, tmp_path):
    tutorial(spark).write(f"{tmp_path}/program")
    (tmp_path / "criteria.txt").write_text("A.main/B.foo/4;A.main/B.bar/5\n\n;\nA.main/B.bar/5;A.main/B.foo/4\nA.main/B.no/4\n A.main/B.foo/4;A.main/B.bar/5;\n")
    o = cli.parse(["-sc-file", f"{tmp_path}/criteria.txt", "-program", f"{tmp_path}/program", "-out-dir", f"{tmp_path}/out", "-extend-sc", "FALSE", "-block-package-prefix", "x", "-block-package-prefix", "y"])
    assert not o.extend_sc and o.retain_cycle and o.block_package_prefix == ["x", "y"]
    got = {(r.tail_unit, r.unit_id) for r in cli.run(spark, o).collect()}
    assert got == {(3, k) for k in range(4)}
    want = ["=" * 58, "Method: <A: void main()>", "Units in the tailored program:", "  b = new B {line: 3}", "  u1 {line: 3}", "  b.foo() {line: 4}", "  b.bar() {line: 5}"]
    assert (tmp_path / "out/text/tail_unit=3/A.main;B.bar;5-all-A.output").read_text().splitlines() == want
    assert (tmp_path / "out/text/tail_unit=2/A.main;B.foo;4-all-A.output").read_text() == ""
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/slices").select("tail_unit", "unit_id").collect()} == got
    log = (tmp_path / "out/log.txt").read_text().splitlines()
    assert log[:2] == ["skipped: ;", "skipped: A.main/B.no/4"] and "> A.main/B.foo/4;A.main/B.bar/5;" in log and any("2 is empty" in x for x in log)


def test_options():
    for bad in (["-no"], ["-sc-file"]):
        with pytest.raises(ValueError):
            cli.parse(bad)


def extended(spark):
    """main: on one side of a branch it makes a C, on the other a D, and calls run() on it; C.run calls the criteria's put."""
    methods = [(0, 0, "main", "main", True, False, True), (1, 1, "run", "C.run", False, False, True), (2, 2, "run", "D.run", False, False, True)]
    methods += [(3, 1, "<init>", "C.init", False, True, True), (4, 2, "<init>", "D.init", False, True, True), (-3, 3, "put", "put", False, False, False), (-4, 3, "get", "get", False, False, False)]
    units = [unit(0, 0, 1), unit(1, 0, 2, local=7, new=1), unit(2, 0, 2, 3, "special", 7), unit(3, 0, 3, local=7, new=2), unit(4, 0, 3, 4, "special", 7), unit(5, 0, 4, 1, "virtual", 7), unit(6, 0, 5, -4, "virtual", 8), unit(7, 0, 6)]
    units += [unit(101, 1, 10, -3, "virtual", 9), unit(102, 1, 11), unit(201, 2, 20), unit(202, 2, 21), *(unit(100 * m + k, m, k) for m in (3, 4) for k in (1, 2))]
    cfg = [(0, 1, 0), (1, 2, 0), (2, 5, 0), (0, 3, 0), (3, 4, 0), (4, 5, 0), (5, 6, 0), (6, 7, 0), (101, 102, 1), (201, 202, 2), (301, 302, 3), (401, 402, 4)]
    pts = [(7, "new", 1, None, None), (7, "new", 3, None, None)]
    return program(spark, units=units, methods=methods, classes=[(k, n, "", False, False) for k, n in enumerate(("Main", "C", "D", "Api"))], supers=[(2, 1)], cfg=[(*e, False) for e in cfg], calls=[(5, 1, "explicit"), (5, 2, "explicit"), (2, 3, "explicit"), (4, 4, "explicit")], pts=pts)


def test_extension(spark):
    """put stands behind the making of a C alone, so the extended slice leaves the side that makes a D."""
    p = extended(spark).staged()
    c = slicing.followed(p)
    assert {tuple(r) for r in extension.method_extensions(p, c).collect()} == {(1, 2), (2, 4), (3, 2), (3, 4), (4, 4)}
    seqs = spark.createDataFrame([([101, 6],)], "seq array<bigint>")
    units = {e: {r.unit_id for r in slicing.slices(p, seqs, slicing.Options(extend_sc=e)).collect()} for e in (False, True)}
    assert units[True] == {0, 1, 2, 5, 6, 101, 102, 301, 302} and units[False] == units[True] | {3, 4, 401, 402}


def cut_by_hand(edges, head):
    """The nearest member of a true component loses its callers in it, one component at a time."""
    edges, reach = set(edges), lambda e, s: s | reach(e, n) if (n := s | {b for a, b in e if a in s}) != s else s
    while True:
        seen, depth, level, d = {head}, {head: 0}, {head}, 0
        while level:
            d += 1
            level = {b for a, b in edges if a in level} - seen
            seen |= level
            depth |= {n: d for n in level}
        after = {n: reach(edges, {b for a, b in edges if a == n}) for n in seen}
        cyclic = [n for n in seen if n in after[n]]
        if not cyclic:
            return edges
        n = min(cyclic, key=lambda n: (depth[n], n))
        edges -= {(a, n) for a in seen if (a, n) in edges and a in after[n] and n in after[a]}


def test_break_cycles(spark):
    r = random.Random(4)
    for n, m in ((6, 12), (9, 14)):
        e = {(r.randrange(n), r.randrange(n)) for _ in range(m)} | {(0, 1)}
        got = graph.break_cycles(spark.createDataFrame(sorted(e), "src long, dst long"), 0)
        assert {tuple(x) for x in got.collect()} == cut_by_hand(e, 0)


def test_long_chain(spark):
    """No bound on rounds: a chain of 800 edges is walked to its end."""
    from pyspark.sql import functions as F

    from seqslice.operators.fixpoint import reach

    e = spark.range(800).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert reach(e, spark.range(1).withColumnRenamed("id", "node")).count() == 801


def test_dominators_of_large_bodies():
    """A body of 100,000 units, with a loop around it, in linear memory; redirections leave catches without exits."""
    import pandas as pd

    n = 100_000
    b = dominance.Body(pd.DataFrame({"src": [*range(n), n - 1], "dst": [*range(1, n + 1), 1]}))
    assert b.back_edges() == [(n - 1, 1)] and b.below(1) == n - 1 and b.exits(b.loops()) == {1: {n}}


def test_redirections(spark):
    cfg = spark.createDataFrame([(0, 1, 0), (1, 2, 0), (2, 1, 0), (2, 3, 0), (3, 4, 0), (4, 3, 0), (4, 5, 0)], "src long, dst long, method_id long")
    catches = spark.createDataFrame([(3,)], "unit_id long")
    got = {(r.src, r.header, r.exit) for r in dominance.redirections(cfg, catches).collect()}
    assert got == {(2, 1, 3), (4, 3, None)}
    assert {(r.src, r.dst) for r in dominance.break_loops(cfg, catches).collect()} == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)}
