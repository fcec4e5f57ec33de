"""Criteria extension: which call sites may stand before a criteria unit, from points-to and call tables.

What extends a unit depends on its method alone, so the relation is worked out by method and only followed by unit, from
the heads of the criteria.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import dominance, views
from .fixpoint import fixpoint, reach, stage
from .graph import class_closure, contract, cycle_labels, true_sccs

INSTANCE = ("virtual", "interface", "special")


def polymorphic(calls: DataFrame, clinit: DataFrame | None = None) -> DataFrame:
    """(call_unit, n_callees) of calls with over one callee, class initialisers (callee_id) not counted."""
    c = calls if clinit is None else calls.join(clinit, "callee_id", "left_anti")
    return c.groupBy("call_unit").agg(F.countDistinct("callee_id").alias("n_callees")).where("n_callees > 1")


def constructor_calls(new_units: DataFrame, cfg: DataFrame, constructor: DataFrame) -> DataFrame:
    """(new_unit, call_unit): the first constructor call on the local that an allocation defines, of several the smallest; null
    where there is none. new_units: unit_id, local; constructor: unit_id, base_local."""
    k = stage(constructor.select(F.col("unit_id").alias("k"), "base_local").distinct())
    e = stage(cfg.select("src", "dst").distinct())
    hit = (F.col("n") == F.col("k")) & (F.col("local") == F.col("base_local"))

    def step(d, _):
        return d.join(k, hit, "left_anti").join(e, F.col("n") == F.col("src")).select("new_unit", "local", F.col("dst").alias("n"))

    seen = fixpoint(new_units.select(F.col("unit_id").alias("new_unit"), "local", F.col("unit_id").alias("n")), step, linear=True)
    return seen.join(k, hit, "left").groupBy("new_unit").agg(F.min("k").alias("call_unit"))


def constructors(sites: DataFrame) -> DataFrame:
    """(unit_id, base_local, class_id): calls of constructors on a local, and the constructor's class. sites: as
    Program.sites() with decl_class_id and decl_constructor."""
    return sites.where("is_call AND decl_constructor AND base_local IS NOT NULL").select("unit_id", "base_local", F.col("decl_class_id").alias("class_id"))


def allocations(sites: DataFrame) -> DataFrame:
    """(alloc_kind, alloc_unit, alloc_local): where objects come from: allocations, and newInstance calls by their receiver."""
    new = sites.where("new_class_id IS NOT NULL").select(F.lit("new").alias("alloc_kind"), F.col("unit_id").alias("alloc_unit"), F.lit(None).cast("long").alias("alloc_local"))
    made = sites.where("is_call AND callee_name = 'newInstance' AND base_local IS NOT NULL").where(F.col("invoke_kind").isin(*INSTANCE)).groupBy("base_local").agg(F.max("unit_id").alias("alloc_unit"))
    return new.unionByName(made.select(F.lit("class").alias("alloc_kind"), "alloc_unit", F.col("base_local").alias("alloc_local")))


def with_declared(program) -> DataFrame:
    """The program's sites with the class of the declared callee, and whether that is a constructor or of an interface."""
    m = program.methods.select(F.col("method_id").alias("decl_method_id"), F.col("class_id").alias("decl_class_id"), F.col("is_constructor").alias("decl_constructor"))
    c = program.classes.select(F.col("class_id").alias("decl_class_id"), F.col("is_interface").alias("decl_interface"))
    return program.sites().join(m, "decl_method_id", "left").join(c, "decl_class_id", "left").withColumn("decl_constructor", F.coalesce("decl_constructor", F.lit(False)))


def receivers(sites: DataFrame, callers: DataFrame) -> DataFrame:
    """(callee_id, call_unit, base, invoke_kind, decl_method_id, decl_class_id, decl_interface): the local that a method's caller
    (call_unit, callee_id) calls it on: the first argument of invoke, what newInstance is assigned to, else the base; null at
    callers that are no instance calls."""
    base = F.when(F.col("callee_name") == "invoke", F.col("first_arg")).when(F.col("callee_name") == "newInstance", F.col("assigned_local")).otherwise(F.col("base_local"))
    is_instance = F.coalesce(F.col("is_call") & F.col("invoke_kind").isin(*INSTANCE), F.lit(False))
    s = sites.select(F.col("unit_id").alias("call_unit"), "is_call", is_instance.alias("is_instance"), F.when(is_instance, base).alias("base"), "invoke_kind", "decl_method_id", "decl_class_id", "decl_interface")
    return callers.select("call_unit", "callee_id").distinct().join(s, "call_unit")


def method_extensions(program, callers: DataFrame) -> DataFrame:
    """(method_id, ext_unit): what may stand before any unit of a method. Of static methods their calls; of others the
    constructor (or newInstance) calls of what their callers' receivers may point to, where that class may run the method,
    and callers that are no instance calls themselves."""
    sites = stage(with_declared(program))
    target = program.methods.select(F.col("method_id").alias("callee_id"), F.col("class_id").alias("target_class"), "is_static", F.col("is_constructor").alias("target_constructor"))
    r = stage(receivers(sites, callers).join(target, "callee_id"))
    plain = r.where("is_static AND is_call OR NOT is_static AND NOT is_instance").select(F.col("callee_id").alias("method_id"), F.col("call_unit").alias("ext_unit"))
    ups = stage(class_closure(program.supers).unionByName(program.classes.select("class_id", F.col("class_id").alias("super_id"))).distinct())
    made = made_by(program, sites)
    x = r.where("NOT is_static AND is_instance AND base IS NOT NULL").join(program.pts, F.col("base") == F.col("local_id"))
    x = x.withColumn("alloc_key", F.coalesce("alloc_unit", "alloc_local")).drop("alloc_unit", "alloc_local").join(made, ["alloc_kind", "alloc_key"])
    x = x.withColumn("made_class", F.when(F.col("alloc_kind") == "new", F.col("cons_class")).otherwise(F.col("alloc_class")))
    x = x.select("callee_id", "ext_unit", "made_class", "invoke_kind", "target_class", "target_constructor", "decl_method_id", "decl_class_id", "decl_interface").distinct()
    return plain.unionByName(possible(x, ups, implementers(program, ups), views.dispatch(program.methods, program.supers)).select(F.col("callee_id").alias("method_id"), "ext_unit")).distinct()


def made_by(program, sites: DataFrame) -> DataFrame:
    """(alloc_kind, alloc_key, ext_unit, cons_class): the call that stands for an allocation: its first constructor call with the
    constructor's class, or the newInstance call on a class object's local."""
    cons = stage(constructors(sites))
    calls = constructor_calls(views.new_units(program.units), program.cfg, cons).where("call_unit IS NOT NULL")
    new = calls.join(cons.select(F.col("unit_id").alias("call_unit"), F.col("class_id").alias("cons_class")), "call_unit").select(F.lit("new").alias("alloc_kind"), F.col("new_unit").alias("alloc_key"), F.col("call_unit").alias("ext_unit"), "cons_class")
    by_class = allocations(sites).where("alloc_kind = 'class'").select("alloc_kind", F.col("alloc_local").alias("alloc_key"), F.col("alloc_unit").alias("ext_unit"), F.lit(None).cast("long").alias("cons_class"))
    return new.unionByName(by_class)


def implementers(program, ups: DataFrame) -> DataFrame:
    """(class_id, iface_id): classes whose own or upper classes implement the interface."""
    return ups.join(program.implements.select(F.col("class_id").alias("super_id"), "iface_id"), "super_id").select("class_id", "iface_id").distinct()


def possible(x: DataFrame, ups: DataFrame, impls: DataFrame, dispatch: DataFrame) -> DataFrame:
    """Rows of x whose made_class may run callee_id there. Special calls and constructors: a subclass of the method's class. Else
    a subtype of the declared class (an implementer, if that is an interface) for which the call comes to callee_id."""
    special = F.col("target_constructor") | (F.col("invoke_kind") == "special")
    up = lambda to: (F.col("made_class") == F.col("class_id")) & (F.col(to) == F.col("super_id"))
    direct = x.where(special).join(ups, up("target_class"), "left_semi")
    goes = (F.col("made_class") == dispatch["class_id"]) & (x["decl_method_id"] == dispatch["decl_method_id"]) & (F.col("callee_id") == F.col("target_id"))
    rest = x.where(~special).join(dispatch, goes, "left_semi")
    by_class = rest.where("NOT decl_interface").join(ups, up("decl_class_id"), "left_semi")
    by_iface = rest.where("decl_interface").join(impls, (F.col("made_class") == F.col("class_id")) & (F.col("decl_class_id") == F.col("iface_id")), "left_semi")
    return direct.unionByName(by_class).unionByName(by_iface)


def exclude_library(by_method: DataFrame, library: DataFrame) -> DataFrame:
    """by_method without all rows of a method that any library unit (unit_id) extends."""
    bad = by_method.join(library.select(F.col("unit_id").alias("ext_unit")), "ext_unit", "left_semi").select("method_id").distinct()
    return by_method.join(bad, "method_id", "left_anti").select("method_id", "ext_unit")


def from_heads(by_method: DataFrame, units: DataFrame, heads: DataFrame) -> DataFrame:
    """(unit, ext_unit): what extends the heads (n), what extends that, and so on; no unit extends itself."""
    m = stage(by_method.join(units.select("method_id", F.col("unit_id").alias("unit")), "method_id").where("unit <> ext_unit").select("unit", "ext_unit"))
    seen = reach(m.select(F.col("unit").alias("src"), F.col("ext_unit").alias("dst")), heads.select(F.col("n").alias("node")))
    return m.join(seen.select(F.col("node").alias("unit")), "unit", "left_semi").select("unit", "ext_unit")


def in_branch_or_virtual(callers: DataFrame, units: DataFrame, branch_units: DataFrame, clinit: DataFrame | None = None) -> DataFrame:
    """(method_id): methods called from a unit in a branch, or by a virtual or interface call with several callees, and what
    they call. callers: call_unit, callee_id."""
    poly = polymorphic(callers, clinit).select("call_unit").join(units.where(F.col("invoke_kind").isin("virtual", "interface")).select(F.col("unit_id").alias("call_unit")), "call_unit", "left_semi")
    own = units.where("is_call").select(F.col("unit_id").alias("call_unit"), "method_id")
    from_branch = own.join(branch_units.select(F.col("unit_id").alias("call_unit")), "call_unit", "left_semi").select("call_unit")
    seeds = callers.join(from_branch.unionByName(poly).distinct(), "call_unit", "left_semi").select(F.col("callee_id").alias("node")).distinct()
    down = callers.join(own, "call_unit").select(F.col("method_id").alias("src"), F.col("callee_id").alias("dst")).distinct()
    return reach(down, seeds).select(F.col("node").alias("method_id"))


def useless_units(units: DataFrame, criteria: DataFrame, main: int, cyclic_units: DataFrame, cyclic_methods: DataFrame, reachable: DataFrame, branch_units: DataFrame, called: DataFrame, class_calls: DataFrame) -> DataFrame:
    """(unit_id): not in the criteria nor in main, and in a cycle, a class$ call, out of reach, or neither in a branch nor
    under one or a polymorphic call."""
    u = units.join(criteria.select(F.col("n").alias("unit_id")), "unit_id", "left_anti").where(F.col("method_id") != main)
    plain = u.join(branch_units.select("unit_id"), "unit_id", "left_anti").join(called, "method_id", "left_anti")
    parts = [u.join(cyclic_units.select("unit_id"), "unit_id", "left_semi"), u.join(cyclic_methods.select("method_id"), "method_id", "left_semi"), u.join(class_calls.select("unit_id"), "unit_id", "left_semi"), u.join(reachable.select("method_id"), "method_id", "left_anti"), plain]
    out = parts[0].select("unit_id")
    for p in parts[1:]:
        out = out.unionByName(p.select("unit_id"))
    return out.distinct()


def relation(edges: DataFrame, useless: DataFrame) -> DataFrame:
    """(unit, ext_unit) after the useless units are bypassed."""
    e = contract(edges.select(F.col("unit").alias("src"), F.col("ext_unit").alias("dst")), useless.select(F.col("unit_id").alias("node")))
    return e.select(F.col("src").alias("unit"), F.col("dst").alias("ext_unit"))


def labels(program, callees: DataFrame, main: int) -> DataFrame:
    """(id, on, tag): every label of the program's units and methods. callees: call_unit, callee_id.

    loop: units in loops, exceptional flow left out; branch: units on one side of a branch; constructor: calls that construct
    an allocation; intra_cycle: loop units, and methods that calls in loops reach; inter_cycle: methods in or reached from
    recursion; recursion: methods in it; reachable: methods that main reaches.
    """
    u = program.units.select("unit_id", "method_id")
    edges = stage(callees.join(u.withColumnRenamed("unit_id", "call_unit"), "call_unit").select(F.col("method_id").alias("src"), F.col("callee_id").alias("dst")).distinct())
    body = stage(views.no_exception(program.cfg, program.units))
    loop = stage(dominance.natural_loops(body).select("node").distinct())
    called = callees.join(loop.withColumnRenamed("node", "call_unit"), "call_unit", "left_semi").join(program.units.where("is_call").select(F.col("unit_id").alias("call_unit")), "call_unit", "left_semi").select(F.col("callee_id").alias("node")).distinct()
    # labels go down from the main's call graph alone, as recursion is looked for there
    main_reaches = reach(edges, _node(program, main))
    graph = stage(edges.join(main_reaches.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst"))
    cyclic = stage(true_sccs(graph).select("node").distinct())
    cons = constructor_calls(views.new_units(program.units), program.cfg, constructors(with_declared(program))).where("call_unit IS NOT NULL")
    parts = [
        (loop, "node", "unit", "loop"), (loop, "node", "unit", "intra_cycle"), (reach(edges, called), "node", "method", "intra_cycle"), (reach(graph, cyclic), "node", "method", "inter_cycle"),
        (cyclic, "node", "method", "recursion"), (main_reaches, "node", "method", "reachable"),
        (dominance.branch_units(body).select("node").distinct(), "node", "unit", "branch"), (cons.select("call_unit").distinct(), "call_unit", "unit", "constructor"),
    ]
    out = None
    for df, col, on, tag in parts:
        x = df.select(F.col(col).alias("id"), F.lit(on).alias("on"), F.lit(tag).alias("tag"))
        out = x if out is None else out.unionByName(x)
    return out


def _node(program, main: int) -> DataFrame:
    return program.units.sparkSession.range(1).select(F.lit(main).cast("long").alias("node"))


def tagged(tags: DataFrame, on: str, *tag: str) -> DataFrame:
    """(unit_id) or (method_id) with one of the tags."""
    return tags.where((F.col("on") == on) & F.col("tag").isin(*tag)).select(F.col("id").alias(f"{on}_id")).distinct()


def extension(program, callees: DataFrame, callers: DataFrame, criteria: DataFrame, heads: DataFrame, main: int, no_library: bool = False, tags: DataFrame | None = None) -> DataFrame:
    """(unit, ext_unit): the whole extension relation of criteria units (n) from their heads (n): followed from the heads, library
    units left out if asked, and useless units bypassed."""
    by_method = method_extensions(program, callers)
    if no_library:
        of = program.methods.join(program.classes.where("is_library").select("class_id"), "class_id", "left_semi").select("method_id")
        by_method = exclude_library(by_method, program.units.join(of, "method_id", "left_semi").select("unit_id"))
    edges = stage(from_heads(stage(by_method), program.units, heads))
    tags = stage(labels(program, callees, main)) if tags is None else tags
    nodes = edges.select(F.col("unit").alias("unit_id")).unionByName(edges.select(F.col("ext_unit").alias("unit_id"))).distinct()
    u = stage(nodes.join(program.units.select("unit_id", "method_id"), "unit_id"))
    clinit = program.methods.where("name = '<clinit>'").select(F.col("method_id").alias("callee_id"))
    branch = tagged(tags, "unit", "branch")
    useless = useless_units(u, criteria, main, tagged(tags, "unit", "intra_cycle"), tagged(tags, "method", "intra_cycle", "inter_cycle"), tagged(tags, "method", "reachable"), branch, in_branch_or_virtual(callers, program.units, branch, clinit), views.calling(program.sites(), "class$"))
    return relation(edges, stage(useless))
