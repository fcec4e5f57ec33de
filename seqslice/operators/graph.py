"""Call-graph algebra: reachability, components, cycle breaking, label propagation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .fixpoint import closure, fixpoint, reach, stage

#: The kinds of call edges that are followed.
CALL_KINDS = ["reflective_class", "reflective_constructor", "reflective_method", "explicit", "thread", "executor", "async_task", "clinit", "privileged"]


def method_graph(calls: DataFrame) -> DataFrame:
    """Method to method: src, dst."""
    return calls.select(F.col("method_id").alias("src"), F.col("callee_id").alias("dst")).distinct()


def reachable_methods(calls: DataFrame, main: DataFrame) -> DataFrame:
    return reach(method_graph(calls), main)


def scc(edges: DataFrame) -> DataFrame:
    """(node, root): strongly connected components by colours; root is the component's largest node.

    A node's colour is the largest node that reaches it; those of a colour that reach the colour's own node are its
    component. Nodes without edges in or out among what is left are components of their own.
    """
    left = stage(edges.select("src", "dst").distinct())
    nodes = stage(left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct())
    out = nodes.select("node", F.col("node").alias("root")).limit(0)
    while True:
        inner = left.where("src <> dst")
        live = stage(inner.select(F.col("src").alias("node")).intersect(inner.select(F.col("dst").alias("node"))))
        out = out.unionByName(nodes.join(live, "node", "left_anti").select("node", F.col("node").alias("root")))
        if live.isEmpty():
            return out
        s, d = live.select(F.col("node").alias("src")), live.select(F.col("node").alias("dst"))
        kept = stage(inner.join(s, "src", "left_semi").join(d, "dst", "left_semi"))
        if live.count() < nodes.count():  # trim until every node has edges in and out
            nodes, left = live, kept
            continue
        color = stage(live.select("node", F.col("node").alias("c")))
        while True:
            by = kept.join(color, kept["src"] == color["node"]).groupBy("dst").agg(F.max("c").alias("m"))
            new = stage(color.join(by, color["node"] == by["dst"], "left").select("node", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("up")))
            moved = new.where("up").limit(1).count()
            color = new.drop("up")
            if not moved:
                break
        a = color.select(F.col("node").alias("src"), F.col("c").alias("ca"))
        b = color.select(F.col("node").alias("dst"), F.col("c").alias("cb"))
        same = stage(kept.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", F.col("ca").alias("c")))
        members = fixpoint(color.where("node = c").select("node", "c"), lambda dl, _, e=same.withColumnRenamed("c", "ec"): dl.join(e, (F.col("node") == F.col("dst")) & (F.col("c") == F.col("ec"))).select(F.col("src").alias("node"), "c"), linear=True)
        out = stage(out.unionByName(members.select("node", F.col("c").alias("root"))))
        nodes = stage(nodes.join(members.select("node"), "node", "left_anti"))
        left = kept.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
        left = stage(left)
        if nodes.isEmpty():
            return out


def true_sccs(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(node, root) of components with a cycle: over one node, or a self-loop."""
    m = stage(members if members is not None else scc(edges))
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    big = m.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    return m.join(big, "root", "left_semi").select("node", "root").unionByName(m.join(loops, "node", "left_semi").select("node", "root")).distinct()


def cycle_labels(edges: DataFrame) -> DataFrame:
    """(node): members of cycles and all that they reach."""
    return reach(edges, true_sccs(edges).select("node").distinct())


def cycle_cuts(edges: DataFrame, head: int) -> DataFrame:
    """(src, dst): the edges that break_cycles() takes away.

    No shortest way from head takes a cut edge, as the nearest member of a component is no farther than its callers in it. So
    depths stay, and an edge is cut when it closes a cycle whose nearest member it enters. Each true component is a group.
    """
    e = stage(edges.select("src", "dst").distinct())
    start = e.sparkSession.range(1).select(F.lit(head).cast("long").alias("node"))
    seen = reach(e, start)
    live = stage(e.join(seen.withColumnRenamed("node", "src"), "src", "left_semi"))
    members = stage(true_sccs(live))
    if members.isEmpty():
        return e.limit(0)
    at = stage(members.join(_depths(live, start, members), "node"))
    src = at.select(F.col("node").alias("src"), "root", F.col("depth").alias("ds"))
    dst = at.select(F.col("node").alias("dst"), F.col("root"), F.col("depth").alias("dd"))
    return stage(live.join(src, "src").join(dst, ["dst", "root"]).groupBy("root").applyInPandas(_cut, "src long, dst long"))


def _cut(edges: pd.DataFrame) -> pd.DataFrame:
    """Of a component's edges (src, dst, depths ds and dd) those that cycle_cuts() takes away."""
    key = {n: (d, n) for a, b in (("src", "ds"), ("dst", "dd")) for n, d in zip(edges[a].tolist(), edges[b].tolist())}
    place = {n: i for i, n in enumerate(sorted(key, key=key.get, reverse=True))}
    pairs = [(place[a], place[b]) for a, b in zip(edges["src"].tolist(), edges["dst"].tolist())]
    times = closing_times(len(place), pairs)
    return edges.loc[[b >= a and t == b for (a, b), t in zip(pairs, times)], ["src", "dst"]]


def closing_times(n: int, edges: list[tuple[int, int]]) -> list[int]:
    """Of each edge between 0 .. n - 1 the smallest t for which it lies on a cycle of nodes up to t; n if there is none.

    By halves of the range of t: an edge inside a component of the nodes up to its middle closes in the lower half. The upper
    half then sees that component as one node, so an edge is looked at once a halving."""
    out = [n] * len(edges)
    # edges as (number, src, dst, first t)
    todo = [(0, n, [(i, a, b, max(a, b)) for i, (a, b) in enumerate(edges)])]
    while todo:
        low, high, some = todo.pop()
        if low >= n or not some:
            continue
        if low == high:
            for i, *_ in some:
                out[i] = low
            continue
        mid = (low + high) // 2
        of = strong_roots([(a, b) for _, a, b, t in some if t <= mid])
        lower = [x for x in some if x[3] <= mid and of[x[1]] == of[x[2]]]
        inside = {x[0] for x in lower}
        todo.append((low, mid, lower))
        todo.append((mid + 1, high, [(i, of.get(a, a), of.get(b, b), t) for i, a, b, t in some if i not in inside]))
    return out


def strong_roots(edges: list[tuple[int, int]]) -> dict[int, int]:
    """node -> its strongly connected component's root (Tarjan, without recursion)."""
    after: dict[int, list[int]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    number, low, root, open_ = {}, {}, {}, []
    for first in after:
        if first in number:
            continue
        number[first] = low[first] = len(number)
        open_.append(first)
        way = [(first, iter(after[first]))]
        while way:
            n, rest = way[-1]
            for m in rest:
                if m not in number:
                    number[m] = low[m] = len(number)
                    open_.append(m)
                    way.append((m, iter(after[m])))
                    break
                if m not in root:
                    low[n] = min(low[n], number[m])
            else:
                way.pop()
                if way:
                    low[way[-1][0]] = min(low[way[-1][0]], low[n])
                if low[n] == number[n]:
                    while n not in root:
                        root[open_.pop()] = n
    return root


def _depths(edges: DataFrame, start: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, depth): edges from start, as far as all of wanted (node) have theirs."""
    level = stage(start.select("node", F.lit(0).alias("depth")))
    every, n = level, 0
    while True:
        if wanted.join(every, "node", "left_anti").isEmpty():
            return every
        n += 1
        step = level.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(n).alias("depth")).distinct()
        level = stage(step.join(every, "node", "left_anti"))
        every = stage(every.unionByName(level))


def break_cycles(edges: DataFrame, head: int) -> DataFrame:
    """edges without those that close cycles reachable from head: again and again the member of each true component that is
    nearest to head (ties: the smallest) loses its callers inside the component, until none is left."""
    e = edges.select("src", "dst").distinct()
    return e.join(cycle_cuts(e, head), ["src", "dst"], "left_anti")


def cycle_report(calls: DataFrame, cuts: DataFrame) -> DataFrame:
    """(call_unit, n_callees, callees): what every call unit loses by the cuts (src, dst) between methods; one row a key, as
    listed by the report on broken cycles."""
    lost = calls.join(cuts, (calls["method_id"] == cuts["src"]) & (calls["callee_id"] == cuts["dst"])).select("call_unit", "callee_id").distinct()
    return lost.groupBy("call_unit").agg(F.count("*").alias("n_callees"), F.array_join(F.array_sort(F.collect_list("callee_id")), ",").alias("callees"))


def class_closure(supers: DataFrame) -> DataFrame:
    """Reflexive and transitive: (class_id, super_id) from (class_id, super_id)."""
    own = supers.select(F.col("class_id").alias("src"), F.col("super_id").alias("dst"))
    nodes = own.select(F.col("src").alias("n")).unionByName(own.select(F.col("dst").alias("n"))).distinct()
    return closure(own).unionByName(nodes.select(F.col("n").alias("src"), F.col("n").alias("dst"))).distinct().select(F.col("src").alias("class_id"), F.col("dst").alias("super_id"))


def contract(edges: DataFrame, useless: DataFrame) -> DataFrame:
    """edges (src, dst) with the useless nodes bypassed and self edges dropped."""
    u = useless.select("node").distinct()
    a = edges.join(u.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    inner = a.join(u.withColumnRenamed("node", "src"), "src", "left_semi")
    skip = closure(inner) if not inner.isEmpty() else inner
    skip = skip.select(F.col("src").alias("s"), F.col("dst").alias("d")).unionByName(u.select(F.col("node").alias("s"), F.col("node").alias("d"))).distinct()
    into = edges.join(u.withColumnRenamed("node", "dst"), "dst", "left_semi").join(u.withColumnRenamed("node", "src"), "src", "left_anti")
    outof = edges.join(u.withColumnRenamed("node", "src"), "src", "left_semi").join(u.withColumnRenamed("node", "dst"), "dst", "left_anti").select(F.col("src").alias("o"), F.col("dst").alias("t"))
    around = into.join(skip, F.col("dst") == F.col("s")).join(outof, F.col("d") == F.col("o")).select("src", F.col("t").alias("dst"))
    plain = edges.join(u.withColumnRenamed("node", "src"), "src", "left_anti").join(u.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    return plain.unionByName(around).where("src <> dst").distinct()


def clinit_edges(cfg: DataFrame, starts: DataFrame, is_call: DataFrame) -> DataFrame:
    """(start, call): the first calls on the ways from units that are not calls; ways end at calls."""
    c = stage(is_call.select(F.col("unit_id").alias("n")).distinct())
    e = stage(cfg.select("src", "dst").distinct())
    seen = fixpoint(starts.select("start", F.col("start").alias("n")), lambda d, _: d.join(c, "n", "left_anti").join(e, F.col("n") == F.col("src")).select("start", F.col("dst").alias("n")), linear=True)
    return seen.join(c, "n", "left_semi").select("start", F.col("n").alias("call"))
