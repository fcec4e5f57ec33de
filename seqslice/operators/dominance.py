"""Dominators, natural loops and branches of method bodies.

Bodies are independent, and a body is bounded (65,535 bytes of bytecode), so each is one pandas group. Dominators are kept as
a tree (the iterative algorithm of Cooper, Harvey and Kennedy over reverse postorder), tests of dominance are interval tests
on it, so a body takes memory in proportion to its edges; only dominators() writes out all pairs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F


class Body:
    """A body's graph and dominator tree. Heads are the nodes without predecessors; what they do not reach is not in it."""

    def __init__(self, pdf: pd.DataFrame, back: bool = False):
        self.succ: dict[int, list[int]] = {}
        a, b = (pdf["dst"], pdf["src"]) if back else (pdf["src"], pdf["dst"])
        for x, y in sorted(set(zip(a.tolist(), b.tolist()))):
            self.succ.setdefault(int(x), []).append(int(y))
            self.succ.setdefault(int(y), [])
        self.pred: dict[int, list[int]] = {n: [] for n in self.succ}
        for x, ys in self.succ.items():
            for y in ys:
                self.pred[y].append(x)
        self._order()
        self._tree()

    def _order(self) -> None:
        seen, post = set(), []
        for h in sorted(n for n in self.succ if not self.pred[n]):
            if h in seen:
                continue
            seen.add(h)
            stack = [(h, iter(self.succ[h]))]
            while stack:
                n, it = stack[-1]
                for m in it:
                    if m not in seen:
                        seen.add(m)
                        stack.append((m, iter(self.succ[m])))
                        break
                else:
                    post.append(n)
                    stack.pop()
        self.order = post[::-1]  # reverse postorder
        self.place = {n: i for i, n in enumerate(self.order)}

    def _tree(self) -> None:
        """idom as places; -1 is a root above all heads."""
        place, up, moved = self.place, [None] * len(self.order), True

        def meet(a: int, b: int) -> int:
            while a != b:
                if a > b:
                    a = up[a]
                else:
                    b = up[b]
                if a == -1 or b == -1:
                    return -1
            return a

        while moved:
            moved = False
            for i, n in enumerate(self.order):
                new = None
                if not self.pred[n]:
                    new = -1
                for p in self.pred[n]:
                    j = place.get(p)
                    if j is not None and (up[j] is not None) and new != -1:
                        new = j if new is None else meet(new, j)
                if new != up[i]:
                    up[i], moved = new, True
        self.up = up
        kids: list[list[int]] = [[] for _ in up]
        roots = []
        for i, u in enumerate(up):
            (roots if u == -1 else kids[u]).append(i)
        self.first, self.last, self.depth, t = [0] * len(up), [0] * len(up), [0] * len(up), 0
        for r in roots:
            stack = [(r, 0, False)]
            while stack:
                i, d, done = stack.pop()
                if done:
                    self.last[i] = t
                    continue
                self.first[i], self.depth[i] = t, d
                t += 1
                stack.append((i, d, True))
                stack += [(k, d + 1, False) for k in kids[i]]

    def dominates(self, d: int, n: int) -> bool:
        """Reflexive; False where either is not reached."""
        if d not in self.place or n not in self.place:
            return False
        i, j = self.place[d], self.place[n]
        return self.first[i] <= self.first[j] < self.last[i]

    def below(self, n: int) -> int:
        """How many nodes n strictly dominates."""
        i = self.place.get(n)
        return 0 if i is None else self.last[i] - self.first[i] - 1

    def above(self, n: int):
        """n's strict dominators, the nearest first."""
        i = self.place.get(n)
        while i is not None and self.up[i] != -1:
            i = self.up[i]
            yield self.order[i]

    def back_edges(self) -> list[tuple[int, int]]:
        return [(n, d) for n in self.order for d in self.succ[n] if self.dominates(d, n)]

    def loops(self, backs=None) -> dict[int, set[int]]:
        """header -> body, merged; a self-loop's body is its header."""
        out: dict[int, set[int]] = {}
        for n, h in self.back_edges() if backs is None else backs:
            body, stack = out.setdefault(h, {h}), [n]
            while stack:
                x = stack.pop()
                if x not in body:
                    body.add(x)
                    stack += [p for p in self.pred[x] if p in self.place]
        return out

    def exits(self, loops: dict[int, set[int]]) -> dict[int, set[int]]:
        """header -> where its loop is left to; an exit that dominates the header leads into an outer loop's header, and that
        loop's exits stand for it. Outer loops come first, so each is worked out once."""
        out: dict[int, set[int]] = {}
        for h in sorted(loops, key=lambda h: self.depth[self.place[h]]):
            own: set[int] = set()
            for x in {b for a in loops[h] for b in self.succ[a]} - loops[h]:
                if not self.dominates(x, h):
                    own.add(x)
                else:
                    own |= out.get(x, set())
            out[h] = own
        return out


def _rows(rows, cols) -> pd.DataFrame:
    return pd.DataFrame(sorted(rows), columns=cols, dtype="int64")


def dominators(cfg: DataFrame, post: bool = False) -> DataFrame:
    """(method_id, node, dom), reflexive; post: post-dominators."""

    def run(key, pdf):
        b = Body(pdf, post)
        return _rows([(key[0], n, d) for n in b.order for d in (n, *b.above(n))], ["method_id", "node", "dom"])

    return cfg.groupBy("method_id").applyInPandas(run, "method_id long, node long, dom long")


def immediate_dominators(cfg: DataFrame) -> DataFrame:
    """(method_id, node, idom) of all nodes but heads and nodes that several heads reach without one node in common."""

    def run(key, pdf):
        b = Body(pdf)
        return _rows([(key[0], n, d) for n in b.order for d in [next(b.above(n), None)] if d is not None], ["method_id", "node", "idom"])

    return cfg.groupBy("method_id").applyInPandas(run, "method_id long, node long, idom long")


def back_edges(cfg: DataFrame) -> DataFrame:
    """(method_id, src, dst): edges to a dominator of their source."""

    def run(key, pdf):
        return _rows([(key[0], n, d) for n, d in Body(pdf).back_edges()], ["method_id", "src", "dst"])

    return cfg.groupBy("method_id").applyInPandas(run, "method_id long, src long, dst long")


def natural_loops(cfg: DataFrame, catches: DataFrame | None = None) -> DataFrame:
    """(method_id, header, node); headers that are catches (unit_id) are left out."""

    def run(key, pdf):
        return _rows([(key[0], h, n) for h, body in Body(pdf).loops().items() for n in body], ["method_id", "header", "node"])

    out = cfg.groupBy("method_id").applyInPandas(run, "method_id long, header long, node long")
    return out if catches is None else out.join(catches.select(F.col("unit_id").alias("header")), "header", "left_anti").select("method_id", "header", "node")


def loop_exits(cfg: DataFrame) -> DataFrame:
    """(method_id, header, exit): where a loop is left to, with the rule of Body.exits()."""

    def run(key, pdf):
        b = Body(pdf)
        return _rows([(key[0], h, x) for h, xs in b.exits(b.loops()).items() for x in xs], ["method_id", "header", "exit"])

    return cfg.groupBy("method_id").applyInPandas(run, "method_id long, header long, exit long")


def redirections(cfg: DataFrame, catches: DataFrame | None = None) -> DataFrame:
    """(method_id, src, header, exit): where each back edge src -> header is turned to; exit is null where it is only cut: out
    of loops without exits, and where the header is a catch (unit_id)."""

    def run(key, pdf):
        b = Body(pdf)
        backs, caught = b.back_edges(), set(pdf.loc[pdf["caught"], "dst"].tolist())
        kept = [e for e in backs if e[1] not in caught]
        exits = b.exits(b.loops(kept))
        rows = [(key[0], n, h, x) for n, h in kept for x in sorted(exits[h]) or [None]] + [(key[0], n, h, None) for n, h in backs if h in caught]
        return pd.DataFrame(rows, columns=["method_id", "src", "header", "exit"]).astype({"method_id": "int64", "src": "int64", "header": "int64", "exit": "Int64"})

    c = cfg.select("method_id", "src", "dst")
    if catches is None:
        c = c.withColumn("caught", F.lit(False))
    else:
        c = c.join(catches.select(F.col("unit_id").alias("dst"), F.lit(True).alias("caught")).distinct(), "dst", "left").withColumn("caught", F.coalesce("caught", F.lit(False)))
    return c.groupBy("method_id").applyInPandas(run, "method_id long, src long, header long, exit long")


def break_loops(cfg: DataFrame, catches: DataFrame | None = None) -> DataFrame:
    """cfg (src, dst, method_id) with every back edge turned to its loop's exits; those to catches are cut."""
    e = cfg.select("src", "dst", "method_id").distinct()
    r = redirections(cfg, catches)
    # one pass over the bodies: a row says both what goes and what comes
    both = e.select("src", "dst", "method_id", F.lit(0).alias("off")).unionByName(r.select("src", F.explode(F.array(F.struct(F.col("header").alias("dst"), F.lit(1).alias("off")), F.struct(F.col("exit").alias("dst"), F.lit(0).alias("off")))).alias("x"), "method_id").select("src", "x.dst", "method_id", "x.off"))
    return both.where("dst is not null").groupBy("src", "dst", "method_id").agg(F.max("off").alias("off")).where("off = 0").select("src", "dst", "method_id")


def _lowest(b: Body, p: Body, n: int):
    """n's nearest strict dominator that n does not post-dominate."""
    return next((d for d in b.above(n) if not p.dominates(n, d)), None)


def branch_units(cfg: DataFrame) -> DataFrame:
    """(method_id, node, branch): nodes on one side of a branch only, and their lowest branch."""

    def run(key, pdf):
        b, p = Body(pdf), Body(pdf, True)
        out = []
        for n in b.succ:
            if b.below(n) + p.below(n) + 1 >= len(b.succ):
                continue
            x = first = _lowest(b, p, n)
            while x is not None:
                if any(s != n and not b.dominates(s, n) and s not in b.succ[n] for s in b.succ[x]):
                    out.append((key[0], n, first))
                    break
                x = _lowest(b, p, x)
        return _rows(out, ["method_id", "node", "branch"])

    return cfg.groupBy("method_id").applyInPandas(run, "method_id long, node long, branch long")


def other_branch_calls(cfg: DataFrame, units: DataFrame) -> DataFrame:
    """(method_id, node, branch): nodes and their lowest branch of which some other side holds a call (units: is_call) before
    the sides meet, that is before a node that post-dominates the branch."""

    def run(key, pdf):
        b, p = Body(pdf), Body(pdf, True)
        calls = set(pdf.loc[pdf["src_call"], "src"].tolist()) | set(pdf.loc[pdf["dst_call"], "dst"].tolist())
        holds: dict[tuple[int, int], bool] = {}

        def side(s: int, x: int) -> bool:
            if (s, x) not in holds:
                seen, stack, hit = set(), [s], False
                while stack and not hit:
                    y = stack.pop()
                    if y not in seen:
                        seen.add(y)
                        hit = y in calls
                        stack += [z for z in b.succ[y] if z == x or not p.dominates(z, x)]
                holds[s, x] = hit
            return holds[s, x]

        out = []
        for n in b.order:
            x = _lowest(b, p, n)
            if x is not None and any(s != n and not b.dominates(s, n) and side(s, x) for s in b.succ[x]):
                out.append((key[0], n, x))
        return _rows(out, ["method_id", "node", "branch"])

    c = units.where("is_call").select(F.col("unit_id").alias("u")).distinct()
    x = cfg.select("method_id", "src", "dst")
    for side in ("src", "dst"):
        x = x.join(c.select(F.col("u").alias(side), F.lit(True).alias(f"{side}_call")), side, "left").withColumn(f"{side}_call", F.coalesce(f"{side}_call", F.lit(False)))
    return x.groupBy("method_id").applyInPandas(run, "method_id long, node long, branch long")
