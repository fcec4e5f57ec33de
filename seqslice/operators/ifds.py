"""Context-sensitive dataflow over facts as relations, and the two passes of a slice.

A path edge (g, m, d1, n, f) says that, for the criteria that end at g, fact f holds at n of method m if d1 held at m's entry.
Facts are strings: '' is zero, 'e' epsilon, else unit ids joined by commas. All groups of criteria are solved at once.

Methods are dealt to parts of about ``PART_UNITS`` units. A round carries new facts through each part, calls and returns
inside it included, until the part has no more to say; then joins carry facts over calls and returns between parts. So
rounds follow how often paths change parts, not how long they are. They are semi-naive; returns join new exits with all
callers and all exits with new callers. Zero always goes along and never counts as a result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .fixpoint import fixpoint, stage

ZERO, EPSILON = "", "e"


@dataclass
class GraphView:
    """A two-level graph in one direction.

    next (m, n, r); calls (n, callee, p, real): p is the call unit, which is n itself or, backwards, stands before it; real:
    not a class initialiser; starts, exits (m, n); call_nodes (n): calls or, backwards, return sites; callers (callee, r): the
    call units of a method, with those that are not entered.
    """

    next: DataFrame
    calls: DataFrame
    starts: DataFrame
    exits: DataFrame
    call_nodes: DataFrame
    callers: DataFrame

    def staged(self) -> GraphView:
        return GraphView(*[stage(x.distinct()) for x in (self.next, self.calls, self.starts, self.exits, self.call_nodes, self.callers)])


@dataclass
class Criteria:
    """By group g, the unit that its sequences end at: units (g, n, is_tail, is_head), follow (g, n, rest): what may stand behind
    n; sequences (g, seq)."""

    units: DataFrame
    follow: DataFrame
    sequences: DataFrame

    def blocked(self) -> DataFrame:
        """(g, p): calls that a group does not enter."""
        return self.units.where("not is_tail").select("g", F.col("n").alias("p"))

    def staged(self) -> Criteria:
        return Criteria(stage(self.units), stage(self.follow), stage(self.sequences))


def criteria(sequences: DataFrame) -> Criteria:
    """From (seq): array of unit ids."""
    s = sequences.select(F.col("seq").cast("array<bigint>").alias("seq")).where(F.size("seq") > 0).distinct().withColumn("g", F.element_at("seq", -1))
    x = s.select("g", "seq", F.posexplode("seq").alias("i", "n"))
    units = x.groupBy("g", "n").agg(F.max(F.col("i") == F.size("seq") - 1).alias("is_tail"), F.max(F.col("i") == 0).alias("is_head"))
    rest = x.where(F.col("i") < F.size("seq") - 1).select("g", "n", text(F.slice("seq", F.col("i") + 2, F.size("seq") - F.col("i") - 1)).alias("rest"))
    return Criteria(units, rest.distinct(), s.select("g", text(F.col("seq")).alias("seq")))


def text(seq: Column) -> Column:
    return F.array_join(F.transform(seq, lambda u: u.cast("string")), ",")


def add_head(n: Column, f: Column) -> Column:
    return F.concat(n.cast("string"), F.when(f == ZERO, F.lit("")).otherwise(F.concat(F.lit(","), f)))


def forward(cfg: DataFrame, units: DataFrame, calls: DataFrame, callers: DataFrame | None = None, clinit: DataFrame | None = None) -> GraphView:
    """cfg (src, dst), units (unit_id, method_id, is_call), calls (call_unit, callee_id); callers: as calls, where a method's
    callers are not those whose callee it is; clinit (callee_id): class initialisers."""
    u = units.select(F.col("method_id").alias("m"), F.col("unit_id").alias("n"))
    edges = cfg.select(F.col("src").alias("n"), F.col("dst").alias("r")).join(u, "n").select("m", "n", "r")
    has_body = u.select(F.col("m").alias("callee")).distinct()
    pair = lambda c: c.select(F.col("call_unit").alias("n"), F.col("callee_id").alias("callee")).join(has_body, "callee", "left_semi").select("n", "callee")
    c = pair(calls).withColumn("p", F.col("n"))
    if clinit is None:
        c = c.withColumn("real", F.lit(True))
    else:
        c = c.join(clinit.select(F.col("callee_id").alias("callee"), F.lit(False).alias("_real")).distinct(), "callee", "left").select("n", "callee", "p", F.coalesce("_real", F.lit(True)).alias("real"))
    starts = u.join(edges.select(F.col("r").alias("n")), "n", "left_anti").select("m", "n")
    exits = u.join(edges.select("n"), "n", "left_anti").select("m", "n")
    back = pair(calls if callers is None else callers).select("callee", F.col("n").alias("r"))
    return GraphView(edges, c, starts, exits, units.where("is_call").select(F.col("unit_id").alias("n")), back)


def backward(v: GraphView, everywhere: bool = False) -> GraphView:
    """Successors and predecessors, starts and exits, calls and return sites swapped. Methods are entered behind call units;
    everywhere: behind all units with callees, as forward, so behind allocations that class initialisers are called from."""
    back = v.next.select("m", F.col("r").alias("n"), F.col("n").alias("r"))
    sites = v.next.join(v.call_nodes, "n", "left_semi").select("n", "r")
    calls = (v.next.select("n", "r") if everywhere else sites).join(v.calls, "n").select(F.col("r").alias("n"), "callee", "p", "real")
    return GraphView(back, calls, v.exits, v.starts, sites.select(F.col("r").alias("n")), v.callers)


def only(v: GraphView, units: DataFrame) -> DataFrame:
    """(g, m, n, r): v's edges to units (g, n) alone, by group."""
    return v.next.join(units.select("g", F.col("n").alias("r")), "r").select("g", "m", "n", "r")


EDGE, CALL, BODY, PUT, OWN, LIVE, ENTER, BACK, END, EXT = range(10)
PROGRAM = ["m", "kind", "g", "a", "b", "f", "callee", "p", "real"]
PART_UNITS = 100_000


def _part(df: DataFrame, kind: int, m, g=None, a=None, b=None, f=None, callee=None, p=None, real=None) -> DataFrame:
    col = lambda x, t: (F.lit(None) if x is None else F.col(x)).cast(t)
    return df.select(F.col(m).alias("m"), F.lit(kind).alias("kind"), col(g, "long").alias("g"), col(a, "long").alias("a"), col(b, "long").alias("b"), col(f, "string").alias("f"), col(callee, "long").alias("callee"), col(p, "long").alias("p"), col(real, "boolean").alias("real"))


class FlowFunctions:
    """A pass's four flow functions. Inside a body, normal and call-to-return flow are one plain function that step() makes of
    the body's program (rows of PROGRAM); call and return flow are Columns and joins over the rows at calls and exits."""

    def __init__(self, view: GraphView, sc: Criteria):
        self.view, self.sc = view, sc

    def program(self) -> DataFrame:
        """Rows of PROGRAM: the edges, and what step() needs beside them."""
        raise NotImplementedError

    @staticmethod
    def step(rows: pd.DataFrame):
        """(g, n, f) -> list of (r, f)."""
        raise NotImplementedError

    strips = False  # call flow: a call that is the fact's head goes off it
    ext: DataFrame | None = None

    def enter(self, f: Column, n: Column) -> Column:
        """Call flow: the fact at the callee's entry."""
        return strip(f, n) if self.strips else f

    def sites(self) -> DataFrame:
        """(g, m, n, callee, p, r, real): where calls come back to; g is null for all groups; real: all facts, else zero alone."""
        v = self.view
        return v.calls.select("n", "callee", "p").join(v.next, "n").select(F.lit(None).cast("long").alias("g"), "m", "n", "callee", "p", "r", F.lit(True).alias("real")).distinct()

    def calling(self) -> DataFrame:
        """Rows of PROGRAM that a part needs to follow calls inside it."""
        v = self.view
        begin = v.starts.select(F.col("m").alias("callee"), F.col("n").alias("s"))
        inside = v.next.select("m", "n").distinct().join(v.calls.select("n", "callee", "p").distinct(), "n").join(begin, "callee")
        out = _part(inside, ENTER, "m", a="n", b="s", callee="callee", p="p").unionByName(_part(self.sites(), BACK, "m", "g", "n", "r", callee="callee", p="p", real="real")).unionByName(_part(v.exits, END, "m", a="n"))
        if self.ext is None:
            return out
        at = v.next.select("m", F.col("r").alias("ext_unit")).distinct()
        return out.unionByName(_part(self.ext.join(at, "ext_unit"), EXT, "m", a="unit", b="ext_unit"))

    def returned(self, x: DataFrame) -> DataFrame:
        """Return flow: x (g, m, d1, n, callee, p, r, f) with what holds at r."""
        return x


def strip_text(f: str, n: int) -> str:
    """f without its head where that is n."""
    head, _, rest = f.partition(",")
    return (rest or EPSILON) if head == str(n) else f


def strip(f: Column, n: Column) -> Column:
    """strip_text as a Column."""
    first = F.substring_index(f, ",", 1) == n.cast("string")
    return F.when((f == ZERO) | (f == EPSILON) | ~first, f).when(~F.contains(f, F.lit(",")), F.lit(EPSILON)).otherwise(F.substring(f, F.instr(f, ",") + 1, F.length(f)))


class BottomUp(FlowFunctions):
    """Facts are what is matched from a unit to the end; they grow where a call is passed that may stand before them."""

    def __init__(self, view: GraphView, sc: Criteria, ext: DataFrame | None = None):
        super().__init__(view, sc)
        self.ext = ext

    def program(self) -> DataFrame:
        v, sc = self.view, self.sc
        own = v.next.select("m", F.col("r").alias("u")).unionByName(v.next.select("m", F.col("n").alias("u"))).distinct()
        grow = sc.follow.select("g", F.col("n").alias("u"), F.col("rest").alias("fin")).unionByName(sc.units.where("is_tail").select("g", F.col("n").alias("u"), F.lit(ZERO).alias("fin")))
        sites = own.join(v.call_nodes.distinct(), own["u"] == v.call_nodes["n"], "left_semi")
        return _part(v.next, EDGE, "m", a="n", b="r").unionByName(_part(sites, CALL, "m", a="u")).unionByName(_part(own.join(grow, "u"), PUT, "m", "g", "u", f="fin"))

    @staticmethod
    def step(rows):
        succ, site, put = {}, set(), set()
        for kind, g, a, b, f in zip(rows["kind"], rows["g"], rows["a"], rows["b"], rows["f"]):
            if kind == EDGE:
                succ.setdefault(int(a), []).append(int(b))
            elif kind == CALL:
                site.add(int(a))
            elif kind == PUT:
                put.add((int(g), int(a), f))

        def moves(g, n, f):
            at = n in site
            for r in succ.get(n, ()):
                yield r, f
                if at and (g, r, f) in put:
                    yield r, f"{r},{f}" if f else str(r)

        return moves

    def sites(self):
        real = self.view.callers.select("callee", "r", F.lit(True).alias("_real")).distinct()
        return super().sites().drop("real").join(real, ["callee", "r"], "left").select("g", "m", "n", "callee", "p", "r", F.col("_real").isNotNull().alias("real"))

    def returned(self, x):
        """A fact comes back to units that call the callee (zero to all others too) and, to an extension call that may stand
        before it, with that call as well. Backwards, r is the call unit."""
        real = self.view.callers.select("callee", "r", F.lit(True).alias("_real")).distinct()
        x = x.join(real, ["callee", "r"], "left").where((F.col("f") == ZERO) | F.col("_real")).drop("_real")
        if self.ext is None:
            return x
        return x.unionByName(extended(x.where((F.col("f") != ZERO) & (F.col("f") != EPSILON)), "r", self.sc, self.ext).select(*x.columns))


def extended(x: DataFrame, at: str, sc: Criteria, ext: DataFrame) -> DataFrame:
    """Rows of x (g, f and the unit at) with at put before f, where it can extend it: f's head is no unit of the criteria but a
    head, at extends that head, and does not stand in f yet."""
    inside = sc.units.where("not is_head").select(F.col("g").alias("_g"), F.col("n").alias("_h"))
    e = ext.select(F.col("unit").alias("_u"), F.col("ext_unit").alias("_x"))
    x = x.withColumn("_head", F.substring_index("f", ",", 1).try_cast("long"))
    new = x.join(inside, (F.col("g") == F.col("_g")) & (F.col("_head") == F.col("_h")), "left_anti").join(e, (F.col("_head") == F.col("_u")) & (F.col(at) == F.col("_x")))
    new = new.where(~F.array_contains(F.split("f", ","), F.col(at).cast("string")))
    return new.withColumn("f", add_head(F.col(at), F.col("f"))).drop("_head", "_u", "_x")


class TopDown(FlowFunctions):
    """Facts are what is still to be matched; a criteria call strips itself, other calls with bodies stop what passes over."""

    def __init__(self, view: GraphView, sc: Criteria, edges: DataFrame, extended: bool = False):
        """edges (g, m, n, r): what a group may walk."""
        super().__init__(view, sc)
        self.edges, self.strips = edges, extended

    def program(self) -> DataFrame:
        v = self.view
        in_body = lambda df: v.next.select("m", "n").distinct().join(df, "n")
        out = _part(self.edges, LIVE, "m", "g", "n", "r").unionByName(_part(in_body(v.call_nodes.distinct()), CALL, "m", a="n"))
        body = v.calls.where("real").select("n").distinct()
        return out.unionByName(_part(in_body(body), BODY, "m", a="n")).unionByName(_part(in_body(self.sc.units.select("g", "n").distinct()), OWN, "m", "g", "n"))

    @staticmethod
    def step(rows):
        succ, call, body, own = {}, set(), set(), set()
        for kind, g, a, b in zip(rows["kind"], rows["g"], rows["a"], rows["b"]):
            if kind == LIVE:
                succ.setdefault((int(g), int(a)), []).append(int(b))
            elif kind == OWN:
                own.add((int(g), int(a)))
            elif kind in (CALL, BODY):
                (call if kind == CALL else body).add(int(a))

        def moves(g, n, f):
            if n in call:
                if (g, n) in own:
                    f = strip_text(f, n)
                elif n in body and f != ZERO:
                    return ()
            return [(r, f) for r in succ.get((g, n), ())]

        return moves

    def sites(self):
        return super().sites().drop("g").join(self.edges.select("g", "n", "r"), ["n", "r"]).select("g", "m", "n", "callee", "p", "r", "real")

    def returned(self, x):
        """Return sites are successors, so a group's are those that it may walk to."""
        return x.join(self.edges.select("g", "n", "r"), ["g", "n", "r"], "left_semi")


class Part:
    """Tabulation inside one part: its program, what is known there, and a worklist."""

    def __init__(self, rows: pd.DataFrame, step, strips: bool, blocked: set, inner: set):
        """blocked (g, p): calls not entered; inner (g, n): criteria units that are no heads, which nothing extends."""
        self.moves, self.strips, self.blocked, self.inner = step(rows), strips, blocked, inner
        self.enter, self.back, self.end, self.ext = {}, {}, set(), set()
        own = set(rows.loc[rows["kind"] == END, "m"].tolist()) | set(rows["m"].tolist())
        num = lambda x: None if x is None or x != x else int(x)
        for kind, g, a, b, callee, p, real in zip(*(rows[c].tolist() for c in ("kind", "g", "a", "b", "callee", "p", "real"))):
            if kind == END:
                self.end.add(int(a))
            elif kind == EXT:
                self.ext.add((int(a), int(b)))
            elif kind in (ENTER, BACK) and int(callee) in own:
                if kind == ENTER:
                    self.enter.setdefault(int(a), []).append((int(b), int(callee), int(p)))
                else:
                    self.back.setdefault((int(a), int(callee)), []).append((num(g), int(b), int(p), bool(real)))
        self.seen, self.exits, self.callers, self.stack, self.out = set(), {}, {}, [], []

    def note(self, x) -> None:
        """x is known, from a round before."""
        g, m, d1, n, f = x
        self.seen.add(x)
        if n in self.end:
            self.exits.setdefault((g, m, d1), set()).add(f)
        for _, callee, p in self.enter.get(n, ()):
            if (g, p) not in self.blocked:
                self.callers.setdefault((g, callee, strip_text(f, n) if self.strips else f), set()).add((m, d1, n))

    def push(self, x) -> None:
        if x not in self.seen:
            self.seen.add(x)
            self.stack.append(x)
            self.out.append(x)

    def come_back(self, g, callee, f, caller) -> None:
        m, d1, n = caller
        for of, r, p, real in self.back.get((n, callee), ()):
            if (of is None or of == g) and (real or f == ZERO) and (g, p) not in self.blocked:
                self.push((g, m, d1, r, f))
                if self.ext and f not in (ZERO, EPSILON):
                    units = f.split(",")
                    if (int(units[0]), r) in self.ext and (g, int(units[0])) not in self.inner and str(r) not in units:
                        self.push((g, m, d1, r, f"{r},{f}"))

    def run(self) -> list:
        while self.stack:
            g, m, d1, n, f = self.stack.pop()
            for r, x in self.moves(g, n, f):
                self.push((g, m, d1, r, x))
            for s, callee, p in self.enter.get(n, ()):
                if (g, p) not in self.blocked:
                    d3 = strip_text(f, n) if self.strips else f
                    self.push((g, callee, d3, s, d3))
                    of = self.callers.setdefault((g, callee, d3), set())
                    if (m, d1, n) not in of:
                        of.add((m, d1, n))
                        for x in tuple(self.exits.get((g, callee, d3), ())):
                            self.come_back(g, callee, x, (m, d1, n))
            if n in self.end:
                of = self.exits.setdefault((g, m, d1), set())
                if f not in of:
                    of.add(f)
                    for caller in tuple(self.callers.get((g, m, d1), ())):
                        self.come_back(g, m, f, caller)
        return self.out


PATH = "g long, m long, d1 string, n long, f string"


def through_parts(new: DataFrame, known: DataFrame | None, program: DataFrame, flows: FlowFunctions, parts: int) -> DataFrame:
    """New rows (g, m, d1, n, f): the seeds new and all that they lead to inside their parts, given what is known there."""
    part = F.pmod(F.xxhash64("m"), F.lit(parts)).alias("part")
    x = new.select(part, "g", "m", "d1", "n", "f", F.lit(True).alias("fresh"))
    if known is not None:
        old = known.select(part, "g", "m", "d1", "n", "f", F.lit(False).alias("fresh"))
        x = x.unionByName(old.join(x.select("part").distinct(), "part", "left_semi").select(*x.columns) if parts > 1 else old)
    step, strips = type(flows).step, flows.strips
    # criteria are a text that was written by hand
    blocked = {(r["g"], r["p"]) for r in flows.sc.blocked().collect()}
    inner = {(r["g"], r["n"]) for r in flows.sc.units.where("not is_head").collect()}

    def run(rows, text):
        out = []
        if rows["fresh"].any():
            p = Part(text, step, strips, blocked, inner)
            of = lambda fresh: zip(*(rows.loc[rows["fresh"] == fresh, c].tolist() for c in ("g", "m", "d1", "n", "f")))
            for r in of(False):
                p.note(r)
            for r in of(True):
                p.push(r)
            out = p.run()
        return pd.DataFrame(out, columns=["g", "m", "d1", "n", "f"]).astype({"g": "int64", "m": "int64", "n": "int64"})

    return x.groupBy("part").cogroup(program.withColumn("part", part).groupBy("part")).applyInPandas(run, PATH)


def path_edges(view: GraphView, seeds: DataFrame, flows: FlowFunctions) -> DataFrame:
    """(g, m, d1, n, f) from seeds (g, m, n, f), zero included."""
    program = stage(flows.program().unionByName(flows.calling()))
    parts = max(1, -(-view.next.select("n").distinct().count() // PART_UNITS))
    first = seeds.select("g", "m", F.col("f").alias("d1"), "n", "f")
    blocked = flows.sc.blocked()
    end = view.exits.select("n").distinct().withColumn("_end", F.lit(True))
    at = view.calls.select("n").distinct().withColumn("_call", F.lit(True))
    cols = ["g", "m", "d1", "n", "f"]

    def marked(x: DataFrame) -> DataFrame:
        """With what n is: later rounds find exits and calls among their rows without a join."""
        x = x.join(end, "n", "left").join(at, "n", "left")
        return x.withColumn("at_end", F.col("_end").isNotNull()).withColumn("at_call", F.col("_call").isNotNull()).select(*cols, "at_end", "at_call")

    start = stage(marked(through_parts(first, None, program, flows, parts)))
    if parts == 1:
        return start.select(*cols)
    begin = view.starts.select(F.col("m").alias("callee"), F.col("n").alias("s"))
    into = stage(view.calls.select("n", "callee", "p").join(begin, "callee"))
    sites = stage(flows.sites().select("n", "callee", "p", "r").distinct())

    def opened(x: DataFrame, to: DataFrame) -> DataFrame:
        """Rows at calls with what their group enters there."""
        return x.where("at_call").select(*cols).join(to, "n").join(blocked, ["g", "p"], "left_anti")

    def returns(ends: DataFrame, callers: DataFrame) -> DataFrame:
        e = ends.where("at_end").select("g", F.col("m").alias("callee"), F.col("d1").alias("d3"), F.col("f").alias("d4"))
        c = opened(callers, sites).withColumn("d3", flows.enter(F.col("f"), F.col("n"))).drop("f")
        x = e.join(c, ["g", "callee", "d3"]).withColumnRenamed("d4", "f")
        return flows.returned(x.select("g", "m", "d1", "n", "callee", "p", "r", "f")).select("g", "m", "d1", F.col("r").alias("n"), "f")

    def step(delta: DataFrame, every: DataFrame) -> DataFrame:
        f = flows.enter(F.col("f"), F.col("n"))
        entered = opened(delta, into).select("g", F.col("callee").alias("m"), f.alias("d1"), F.col("s").alias("n"), f.alias("f"))
        new = entered.unionByName(returns(delta, every)).unionByName(returns(every, delta)).distinct()
        new = new.join(every.select(*cols), cols, "left_anti")
        return marked(through_parts(new, every, program, flows, parts))

    return fixpoint(start, step).select(*cols)


def solve(view: GraphView, seeds: DataFrame, flows: FlowFunctions) -> DataFrame:
    """(g, n, f) from seeds (g, m, n, f): every fact that holds at a unit on some matched path, zero included."""
    return path_edges(view, seeds, flows).select("g", "n", "f").distinct()


@dataclass
class Passes:
    """What a slice leaves, by group: the view and criteria; all facts (g, n, f) of the first pass with zero; units with others
    (g, n), which are the bottom-up reachable ones; the facts that the second pass starts with (g, f); its facts; the slice's
    units (g, n)."""

    view: GraphView
    sc: Criteria
    bottom_up: DataFrame
    live: DataFrame
    begin: DataFrame | None = None
    top_down: DataFrame | None = None
    units: DataFrame | None = None


def _in_main(x: DataFrame, main: int) -> DataFrame:
    return x.where(F.col("m") == F.lit(main))


def first_pass(view: GraphView, sequences: DataFrame, main: int = 0, ext: DataFrame | None = None, everywhere: bool = False) -> Passes:
    """Bottom up from main's ends. view is staged(); everywhere: see backward()."""
    sc = criteria(sequences).staged()
    back = backward(view, everywhere).staged()
    seeds = _in_main(view.exits, main).join(sc.units.select("g").distinct()).withColumn("f", F.lit(ZERO))  # one row a group and end of main
    facts = stage(solve(back, seeds, BottomUp(back, sc, ext)))
    return Passes(view, sc, facts, stage(facts.where(F.col("f") != ZERO).select("g", "n").distinct()))


def first_facts(p: Passes, main: int = 0, extended: bool = False) -> DataFrame:
    """(g, f): what the second pass starts with: the facts at main's first units that are whole sequences or, extended, that
    are longest and end with one."""
    at = p.bottom_up.join(_in_main(p.view.starts, main).select("n"), "n", "left_semi").where(F.col("f") != ZERO).select("g", "f").distinct()
    if extended:
        return maximal(at, p.sc.sequences)
    return at.join(p.sc.sequences.select("g", F.col("seq").alias("f")), ["g", "f"], "left_semi")


def both_passes(view: GraphView, sequences: DataFrame, main: int = 0, ext: DataFrame | None = None, everywhere: bool = False) -> Passes:
    """Both passes for all sequences (seq), and the units where their facts meet; everywhere: see backward()."""
    p = first_pass(view, sequences, main, ext, everywhere)
    begin = stage(first_facts(p, main, ext is not None))
    zero = begin.select("g").distinct().withColumn("f", F.lit(ZERO))  # zero alone leads to no fact
    seeds = begin.unionByName(zero).join(_in_main(view.starts, main))  # main's first units: one but for handlers
    walk = TopDown(view, p.sc, only(view, p.live), ext is not None)
    down = stage(solve(view, seeds, walk).where(F.col("f") != ZERO))
    met = down.join(p.bottom_up, ["g", "n", "f"], "left_semi").select("g", "n")
    done = down.where(F.col("f") == EPSILON).join(p.live, ["g", "n"], "left_semi").select("g", "n")
    return replace(p, begin=begin, top_down=down, units=stage(met.unionByName(done).distinct()))


def maximal(facts: DataFrame, sequences: DataFrame) -> DataFrame:
    """Facts (g, f) that are no proper suffix of another and end with a sequence (g, seq). Both tests meet on the last unit."""
    last = lambda c: F.substring_index(c, ",", -1)
    f, g = facts.withColumn("k", last("f")), facts.select(F.col("g").alias("g2"), F.col("f").alias("f2"), last("f").alias("k2"))
    longer = (F.col("g") == F.col("g2")) & (F.col("k") == F.col("k2")) & F.endswith(F.col("f2"), F.concat(F.lit(","), F.col("f")))
    s = sequences.select(F.col("g").alias("g3"), "seq", last("seq").alias("k3"))
    whole = (F.col("g") == F.col("g3")) & (F.col("k") == F.col("k3")) & F.endswith(F.concat(F.lit(","), F.col("f")), F.concat(F.lit(","), F.col("seq")))
    return f.join(g, longer, "left_anti").join(s, whole, "left_semi").select("g", "f")


def slices(cfg: DataFrame, units: DataFrame, calls: DataFrame, sequences: DataFrame, main: int = 0, ext: DataFrame | None = None) -> DataFrame:
    """(tail_unit, method_id, unit_id) for all sequences (seq) over plain tables; plans.slicing adds views and extension."""
    view = forward(stage(cfg), stage(units), stage(calls)).staged()
    got = both_passes(view, stage(sequences), main, ext).units
    return got.join(units.select("unit_id", "method_id"), F.col("n") == F.col("unit_id")).select(F.col("g").alias("tail_unit"), "method_id", "unit_id")
