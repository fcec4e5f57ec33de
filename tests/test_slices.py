"""Slices of small hand-made programs, and the queries that have SQL against DuckDB."""

import duckdb
import pytest

from seqslice.operators import graph, ifds
from seqslice.plans import registry

# name: edges, units of each method, calls, call edges, criteria, expected slice
PROGRAMS = {
    "straight": ([(0, 1), (1, 2), (2, 3), (3, 4)], {0: range(5)}, [1, 2, 3], [], (2, 3), {0, 1, 2, 3}),
    "wrong order": ([(0, 1), (1, 2), (2, 3), (3, 4)], {0: range(5)}, [1, 2, 3], [], (3, 2), set()),
    "branch": ([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 5)], {0: range(6)}, [1, 4], [], (1, 4), {0, 1, 3, 4}),
    "loop": ([(0, 1), (1, 2), (2, 3), (3, 1), (1, 4)], {0: range(5)}, [2, 3], [], (3, 2), {0, 1, 2, 3}),
    "recursion": ([(0, 1), (1, 2), (30, 31), (30, 32), (31, 33), (32, 33)], {0: range(3), 3: range(30, 34)}, [0, 1, 31, 32], [(0, 3), (31, 3)], (32, 1), {0, 1, 30, 31, 32, 33}),
    "context": ([(0, 1), (0, 2), (1, 3), (2, 4), (4, 5), (5, 3), (40, 41)], {0: range(6), 4: [40, 41]}, [1, 4, 2, 5], [(1, 4), (4, 4)], (2, 5), {0, 2, 4, 5, 40, 41}),
}


PROGRAMS |= {
    "two calls": ([(0, 1), (1, 2), (2, 3), (10, 11), (10, 12), (11, 13), (12, 13)], {0: range(4), 1: range(10, 14)}, [0, 1, 2, 11], [(0, 1), (1, 1)], (11, 2), {0, 1, 2, 10, 11, 12, 13}),
    "tail with a body": ([(0, 1), (1, 2), (20, 21)], {0: range(3), 2: [20, 21]}, [0, 1], [(1, 2)], (0, 1), {0, 1}),
}


def test_slices(spark):
    """All programs in one run: their units and methods are numbered apart, and every main is called by one common main."""
    cfg, units, calls, seqs, want = [], [], [], [], {}
    shift = lambda k, x: 1000 * (k + 1) + x
    mains = []
    for k, (edges, methods, is_call, call_edges, seq, slice_) in enumerate(PROGRAMS.values()):
        own = {u: m for m, us in methods.items() for u in us}
        cfg += [(shift(k, a), shift(k, b)) for a, b in edges]
        units += [(shift(k, u), shift(k, m), u in is_call) for u, m in own.items()]
        calls += [(shift(k, u), shift(k, m)) for u, m in call_edges]
        seqs.append(([shift(k, u) for u in seq],))
        want[shift(k, seq[-1])] = {shift(k, u) for u in slice_}
        mains.append(shift(k, 0))
    # a common main that calls each program once, on one side of a branch each
    units += [(1, 0, False), (999, 0, False)] + [(2 + i, 0, True) for i in range(len(mains))]
    cfg += [(1, 2 + i) for i in range(len(mains))] + [(2 + i, 999) for i in range(len(mains))]
    calls += [(2 + i, m) for i, m in enumerate(mains)]
    f = lambda rows, cols: spark.createDataFrame(rows, cols)
    got = ifds.slices(f(cfg, "src long, dst long"), f(units, "unit_id long, method_id long, is_call boolean"), f(calls, "call_unit long, callee_id long"), f(seqs, "seq array<bigint>"))
    have: dict = {}
    for r in got.collect():
        have.setdefault(r.tail_unit, set()).add(r.unit_id)
    for i, (tail, w) in enumerate(want.items()):
        assert (list(PROGRAMS)[i], have.get(tail, set())) == (list(PROGRAMS)[i], w | {1, 2 + i} if w else set())


def test_break_cycles(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (2, 3)], "src long, dst long")
    got = graph.break_cycles(e, 0)
    assert {tuple(r) for r in got.collect()} == {(0, 1), (1, 2), (2, 3)} and graph.true_sccs(got).isEmpty()


SLOW = set()


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE) - SLOW))
def test_against_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    cur = con.execute(registry.ORACLE[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall())
    df = registry.QUERIES[name](spark, d)
    assert sorted(tuple(r) for r in df.select(*sorted(names)).collect()) == want
