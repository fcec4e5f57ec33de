"""Slices of several groups on one view against their SQL, where class initialisers are attached and called; cycle cuts of
dense graphs."""

import random

import duckdb
import pytest

from seqslice.operators import graph
from seqslice.plans import registry, slicing


@pytest.mark.parametrize("name", ["slice_blocked", "slice_program"])
def test_initialisers_against_sql(spark, name):
    """On sf0.01 the groups' classes differ, and allocations call class initialisers; on sf0.001 no initialiser is attached."""
    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM read_parquet('/root/testdata/sf0.01/events.parquet')")
    want = con.execute(f"SELECT tail_unit, method_id, unit_id FROM ({registry.ORACLE[name]})").fetchall()
    got = registry.QUERIES[name](spark, "/root/testdata/sf0.01").select("tail_unit", "method_id", "unit_id").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_dense_cuts(spark):
    """Of a complete graph what leads to larger nodes is left; the number of jobs does not follow the number of cuts."""
    e = spark.createDataFrame([(a, b) for a in range(60) for b in range(60)], "src long, dst long")
    spark.sparkContext.setJobGroup("dense", "")
    got = {tuple(r) for r in graph.break_cycles(e, 0).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("dense"))
    spark.sparkContext.setJobGroup("", "")
    assert got == {(a, b) for a in range(60) for b in range(60) if a < b} and jobs < 150


def test_closing_times():
    r = random.Random(5)
    for _ in range(300):
        n = r.randrange(1, 9)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(20))]

        def closes(a, b, t):
            seen, todo = {b}, [b]
            while todo:
                x = todo.pop()
                new = {d for s, d in edges if s == x and d <= t} - seen
                seen |= new
                todo += new
            return max(a, b) <= t and a in seen

        assert graph.closing_times(n, edges) == [next((t for t in range(n) if closes(a, b, t)), n) for a, b in edges]


def test_loops_broken_once(spark, monkeypatch):
    """Views read broken loops from a table: bodies are not walked anew each time that a view's control flow is read."""
    seen, view = [], slicing.blocked_view
    monkeypatch.setattr(slicing, "blocked_view", lambda *a: seen.append(view(*a)) or seen[-1])
    registry.QUERIES["slice_without_cycles"](spark, "/root/testdata/sf0.001")
    plans = [v.cfg._jdf.queryExecution().optimizedPlan().toString() for v in seen]
    assert plans and not any("InPandas" in p for p in plans)
