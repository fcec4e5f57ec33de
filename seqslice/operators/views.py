"""Views of the two-level graph: filtered, blocked and reversed edges, starts, ends and return sites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from .fixpoint import fixpoint, reach, stage
from .graph import CALL_KINDS, clinit_edges


def allowed_calls(calls: DataFrame, units: DataFrame) -> DataFrame:
    """Call edges of the kinds that are followed, to methods with bodies."""
    body = units.select(F.col("method_id").alias("callee_id")).distinct()
    return calls.where(F.col("kind").isin(CALL_KINDS)).join(body, "callee_id", "left_semi")


def starts(cfg: DataFrame) -> DataFrame:
    return cfg.select("method_id", F.col("src").alias("unit_id")).distinct().join(cfg.select(F.col("dst").alias("unit_id")), "unit_id", "left_anti").select("method_id", "unit_id")


def ends(cfg: DataFrame) -> DataFrame:
    return cfg.select("method_id", F.col("dst").alias("unit_id")).distinct().join(cfg.select(F.col("src").alias("unit_id")), "unit_id", "left_anti").select("method_id", "unit_id")


def return_sites(cfg: DataFrame, units: DataFrame) -> DataFrame:
    calls = units.where("is_call").select(F.col("unit_id").alias("src"))
    return cfg.join(calls, "src", "left_semi").select("dst").distinct()


def reversed_calls(cfg: DataFrame, calls: DataFrame) -> DataFrame:
    """Of the reversed graph: a unit calls what its call predecessors call."""
    return calls.join(cfg.select("src", "dst"), F.col("call_unit") == F.col("src")).select(F.col("dst").alias("call_unit"), "callee_id").distinct()


def non_call_starts(units: DataFrame, cfg: DataFrame) -> DataFrame:
    first = starts(cfg).select("unit_id")
    return units.where("not is_call").join(first, "unit_id", "left_anti").select("unit_id")


def non_call_ends(units: DataFrame, cfg: DataFrame) -> DataFrame:
    """Units that are neither exits nor return sites."""
    sites = return_sites(cfg, units).select(F.col("dst").alias("unit_id"))
    return units.join(ends(cfg).select("unit_id"), "unit_id", "left_anti").join(sites, "unit_id", "left_anti").select("unit_id")


def not_under(d: DataFrame, package: str, prefixes: list[str]) -> DataFrame:
    """Rows whose package stands under none of the prefixes."""
    return d.where(reduce(lambda a, p: a & ~F.startswith(F.col(package), F.lit(p)), prefixes, F.lit(True)))


def application_only(d: DataFrame, classes: DataFrame) -> DataFrame:
    return d.join(classes.where("not is_library").select("class_id"), "class_id", "left_semi")


def tagged(d: DataFrame, labels: DataFrame, tag: str) -> DataFrame:
    return d.join(labels.where(F.col("tag") == tag).select("unit_id"), "unit_id", "left_semi")


def class_lines(units: DataFrame) -> DataFrame:
    """Distinct class:line of units with a line."""
    return units.where("line > 0").select(F.concat_ws(":", "class_name", F.col("line").cast("string")).alias("class_line")).distinct()


def under_package(classes: DataFrame, prefixes: list[str]) -> DataFrame:
    """(class_id) of classes whose package starts with one of the prefixes."""
    return classes.join(not_under(classes, "package", prefixes), "class_id", "left_anti").select("class_id")


def methods_of(methods: DataFrame, classes: DataFrame) -> DataFrame:
    """(callee_id) of all methods of the classes."""
    return methods.join(classes.select("class_id"), "class_id", "left_semi").select(F.col("method_id").alias("callee_id"))


def contains_call(units: DataFrame, method_id: int) -> DataFrame:
    return units.where(F.col("is_call") & (F.col("decl_method_id") == method_id))


def calling(sites: DataFrame, *names: str) -> DataFrame:
    """(unit_id) of calls to methods of the names; sites: as Program.sites()."""
    return sites.where(F.col("is_call") & F.col("callee_name").isin(*names)).select("unit_id")


def new_units(units: DataFrame) -> DataFrame:
    """(unit_id, local, class_id) of allocations."""
    return units.where("new_class_id IS NOT NULL").select("unit_id", F.col("assigned_local").alias("local"), F.col("new_class_id").alias("class_id"))


def catch_units(units: DataFrame) -> DataFrame:
    return units.where("is_catch").select("unit_id")


def reachable_units(units: DataFrame, methods: DataFrame, reachable: DataFrame) -> DataFrame:
    """Units of reachable methods (node) with bodies."""
    body = methods.where("has_body").select("method_id").join(reachable.select(F.col("node").alias("method_id")), "method_id", "left_semi")
    return units.join(body, "method_id", "left_semi")


def successor_kinds(cfg: DataFrame, units: DataFrame) -> DataFrame:
    """(src, dst, kind): 'fall' to the next unit of the body, 'branch' to any other, 'exception' to handlers."""
    o = units.select("unit_id", "method_id", "ord")
    nxt = o.select(F.col("unit_id").alias("src"), F.lead("unit_id").over(Window.partitionBy("method_id").orderBy("ord", "unit_id")).alias("_next"))
    kind = F.when(F.col("is_exceptional"), "exception").when(F.col("dst") == F.col("_next"), "fall").otherwise("branch")
    return cfg.join(nxt, "src", "left").select("src", "dst", kind.alias("kind"))


def no_exception(cfg: DataFrame, units: DataFrame) -> DataFrame:
    """cfg without exceptional edges, as far as heads that are neither catches nor nops reach."""
    e = cfg.where("not is_exceptional").select("method_id", "src", "dst").distinct()
    heads = units.where("not is_catch AND not is_nop").select(F.col("unit_id").alias("node")).join(e.select(F.col("dst").alias("node")), "node", "left_anti")
    seen = reach(e, heads)
    return e.join(seen.select(F.col("node").alias("src")), "src", "left_semi").select("method_id", "src", "dst")


def method_cfg(cfg: DataFrame, method_id: int) -> DataFrame:
    return cfg.where(F.col("method_id") == method_id).select("src", "dst")


def top_down_edges(cfg: DataFrame, live: DataFrame) -> DataFrame:
    """cfg with successors among the bottom-up reachable units (unit_id) alone."""
    return cfg.join(live.select(F.col("unit_id").alias("dst")), "dst", "left_semi").select("src", "dst")


def clinit_attachments(spec_units: DataFrame, units: DataFrame, methods: DataFrame, cfg: DataFrame, calls: DataFrame) -> DataFrame:
    """(call_unit, callee_id): for the class initialiser of each class that holds a criteria call (unit_id), if no call calls it,
    the first call on a way from a unit that does: of the smallest such unit, the smallest."""
    classes = spec_units.join(units.select("unit_id", "method_id"), "unit_id").join(methods.select("method_id", "class_id"), "method_id").select("class_id").distinct()
    init = methods.where("name = '<clinit>'").join(classes, "class_id", "left_semi").groupBy("class_id").agg(F.min("method_id").alias("callee_id")).select("callee_id")
    by = calls.join(init, "callee_id", "left_semi").join(units.select(F.col("unit_id").alias("call_unit"), "is_call"), "call_unit")
    called = by.where("is_call").select("callee_id").distinct()
    odd = stage(by.join(called, "callee_id", "left_anti").select("callee_id", F.col("call_unit").alias("start")).distinct())
    first = clinit_edges(cfg, odd.select("start").distinct(), units.where("is_call"))
    return odd.join(first, "start").groupBy("callee_id").agg(F.min(F.struct("start", "call")).alias("x")).select(F.col("x.call").alias("call_unit"), "callee_id")


def blocked_calls(calls: DataFrame, methods: DataFrame, classes: DataFrame, always: DataFrame | None = None, reflective: bool = False, attached: DataFrame | None = None, cut: DataFrame | None = None, exclude_library: bool = False) -> tuple[DataFrame, DataFrame]:
    """(callees, callers), both (call_unit, callee_id), of the blocked view; the criteria's own rule is the solver's, by group.

    calls are followed ones. Both lose the bodies of reflective calls and what cycle breaking cut (call_unit, callee_id), and gain
    the attached class initialisers. Callees alone lose the always blocked methods (callee_id). Library callees go from both.
    """
    c = calls.select("call_unit", "callee_id").distinct()
    if reflective:
        c = c.join(methods.where(F.col("name").isin("newInstance", "invoke")).select(F.col("method_id").alias("callee_id")), "callee_id", "left_anti").select("call_unit", "callee_id")
    callees = c if always is None else c.join(always, "callee_id", "left_anti").select("call_unit", "callee_id")
    out = []
    for x in (callees, c):
        x = x if cut is None else x.join(cut, ["call_unit", "callee_id"], "left_anti")
        x = x if attached is None else x.unionByName(attached.select("call_unit", "callee_id")).distinct()
        if exclude_library:
            library = methods.join(classes.where("is_library").select("class_id"), "class_id", "left_semi").select(F.col("method_id").alias("callee_id"))
            x = x.join(library, "callee_id", "left_anti").select("call_unit", "callee_id")
        out.append(x)
    return out[0], out[1]


def dispatch(methods: DataFrame, supers: DataFrame) -> DataFrame:
    """(class_id, decl_method_id, target_id): the method of the declared one's name in the class or its nearest superclass;
    of several the one with the smallest number."""
    up = fixpoint(supers.select("class_id", "super_id", F.lit(1).alias("depth")), lambda d, _: d.select("class_id", F.col("super_id").alias("mid"), "depth").join(supers.select(F.col("class_id").alias("mid"), "super_id"), "mid").select("class_id", "super_id", (F.col("depth") + 1).alias("depth")), linear=True)
    own = methods.select("class_id").distinct().select("class_id", F.col("class_id").alias("super_id"), F.lit(0).alias("depth"))
    body = methods.where("has_body AND not is_static").select(F.col("class_id").alias("super_id"), F.col("method_id").alias("target_id"), "name")
    x = up.unionByName(own).join(body, "super_id").groupBy("class_id", "name").agg(F.min(F.struct("depth", "target_id")).alias("x"))
    return x.join(methods.select(F.col("method_id").alias("decl_method_id"), "name"), "name").select("class_id", "decl_method_id", F.col("x.target_id").alias("target_id"))
