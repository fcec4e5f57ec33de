"""A program as tables, from a folder of Parquet files, and the one that the events table stands for."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.fixpoint import stage
from . import events_graph as ev

SCHEMAS = {
    "units": "unit_id long, method_id long, ord int, line int, end_line int, text string, is_call boolean, invoke_kind string, decl_method_id long, base_local long, assigned_local long, first_arg long, is_catch boolean, is_nop boolean, new_class_id long",
    "methods": "method_id long, class_id long, name string, signature string, is_static boolean, is_constructor boolean, has_body boolean",
    "classes": "class_id long, name string, package string, is_interface boolean, is_library boolean",
    "supers": "class_id long, super_id long",
    "implements": "class_id long, iface_id long",
    "cfg": "src long, dst long, method_id long, is_exceptional boolean",
    "calls": "call_unit long, callee_id long, kind string",
    "pts": "local_id long, alloc_kind string, alloc_unit long, alloc_local long, alloc_class long",
}


@dataclass
class Program:
    """Bodies, methods, classes and their hierarchy, control flow, call edges, and what locals may point to: an allocation
    (alloc_kind 'new', alloc_unit) or what newInstance makes of a class (alloc_kind 'class': the class object's local, the class)."""

    units: DataFrame
    methods: DataFrame
    classes: DataFrame
    supers: DataFrame
    implements: DataFrame
    cfg: DataFrame
    calls: DataFrame
    pts: DataFrame

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Program:
        return Program(**{t: spark.read.schema(s).parquet(f"{folder}/{t}") for t, s in SCHEMAS.items()})

    def write(self, folder: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{folder}/{f.name}")

    def staged(self) -> Program:
        """Tables are small jobs, so some are written side by side."""
        with ThreadPoolExecutor(4) as pool:
            tables = pool.map(inheritable_thread_target(self.units.sparkSession)(stage), [getattr(self, f.name) for f in fields(self)])
            return Program(**dict(zip([f.name for f in fields(self)], tables)))

    def sites(self) -> DataFrame:
        """Units with the class and name of their method (class_name, method_name) and of what they call (callee_class,
        callee_name)."""
        m = self.methods.join(self.classes.select("class_id", F.col("name").alias("class_name")), "class_id")
        own = m.select("method_id", "class_id", "class_name", F.col("name").alias("method_name"), "signature")
        of = m.select(F.col("method_id").alias("decl_method_id"), F.col("class_name").alias("callee_class"), F.col("name").alias("callee_name"))
        return self.units.join(own, "method_id").join(of, "decl_method_id", "left")


#: The reflective methods that matter, as (class, name), and their numbers in the events' program.
FOR_NAME, NEW_INSTANCE, INVOKE, CLASS_CALL, PUT = -1, -2, -3, -4, -9
API = "(-1, 'forName'), (-2, 'newInstance'), (-3, 'invoke'), (-4, 'class$'), (-9, 'put')"


def of_events(spark: SparkSession, d: str) -> Program:
    """FX-2 with FX-3 and made-up classes, so that every operator has something to do. Numbers below are residues of users
    (methods), states and slots (a state's number mod 4)."""
    w, o = ev.WIDTH, F.col("unit_id") % ev.WIDTH
    t, j, m = F.floor(o / 4), o % 4, F.col("method_id")
    api = lambda n: F.lit(n).cast("long")
    base = ev.units(spark, d).select("unit_id", "method_id", "is_call")
    followed = ev.calls(spark, d).select("call_unit", "callee_id", "method_id")
    least = followed.groupBy("call_unit").agg(F.min("callee_id").alias("_least")).withColumnRenamed("call_unit", "unit_id")
    u = base.join(least, "unit_id", "left").withColumn("t", F.when(o < 20, t)).withColumn("j", j)
    click, buy, sign = F.col("t") == 0, F.col("t") == 2, F.col("t") == 3
    making, reflecting = buy & (F.col("j") < 2), buy & (F.col("j") == 3)
    decl = F.when(click & (m % 5 == 4), api(INVOKE)).when(click & (m % 5 == 3), api(NEW_INSTANCE)).when(click, F.coalesce("_least", api(PUT)))
    decl = decl.when(making, -100 - m % 5).when(buy & (F.col("j") == 2), F.when(m % 6 == 0, api(FOR_NAME)).when(m % 6 == 1, api(CLASS_CALL)).otherwise(api(PUT)))
    decl = decl.when(reflecting, F.when(m % 2 == 0, api(NEW_INSTANCE)).otherwise(api(INVOKE)))
    slot = lambda k: m * 4 + k
    line = F.when(o >= 20, F.lit(-1)).otherwise(o).cast("int")
    kind = F.when(click, F.element_at(F.array(*map(F.lit, ("static", "virtual", "interface", "special"))), (F.col("j") + 1).cast("int"))).when(buy, F.when(F.col("j") == 2, "static").otherwise("special"))
    units = u.select(
        "unit_id", "method_id", o.cast("int").alias("ord"), line.alias("line"), F.when(o >= 20, -1).otherwise(o + F.col("j")).cast("int").alias("end_line"),
        F.concat(F.lit("u"), F.col("unit_id").cast("string")).alias("text"), "is_call", kind.alias("invoke_kind"), decl.cast("long").alias("decl_method_id"),
        F.when((click & (F.col("j") > 0)) | making, slot(F.col("j"))).when(reflecting, slot(2)).alias("base_local"),
        F.when(sign, slot(F.col("j"))).when((decl == NEW_INSTANCE) & (reflecting | click), slot(3)).alias("assigned_local"),
        F.when(decl == INVOKE, slot(1)).alias("first_arg"), F.coalesce((F.col("t") == 1) & (F.col("j") == 0), F.lit(False)).alias("is_catch"),
        F.coalesce((F.col("t") == 1) & (F.col("j") == 3), F.lit(False)).alias("is_nop"), F.when(sign, m % 5).alias("new_class_id"),
    )
    clinit = F.col("callee_id") % 13 == 7
    calls = followed.select("call_unit", "callee_id", F.when(clinit, "finalize").when(F.col("callee_id") % 10 == 3, "thread").when(F.col("callee_id") % 10 == 9, "finalize").when(F.col("method_id") % 5 == 4, "reflective_method").otherwise("explicit").alias("kind"))
    e, users = ev.state(ev.events(spark, d)), ev.events(spark, d).select("user_id").distinct()
    # class initialisers are called from allocations, which are no calls
    calls = calls.unionByName(e.where("t = 3 AND k % 13 = 7").join(users.select(F.col("user_id").alias("k")), "k", "left_semi").select(F.col("unit").alias("call_unit"), F.col("k").alias("callee_id"), F.lit("clinit").alias("kind")).distinct())
    name = F.when(m == 0, "main").when(m % 13 == 7, "<clinit>").when(m % 11 == 5, "<init>").otherwise(F.concat(F.lit("m"), (m % 3).cast("string")))
    methods = users.select(F.col("user_id").alias("method_id")).select(
        "method_id", (m % 7).alias("class_id"), name.alias("name"), F.format_string("M%05d", "method_id").alias("signature"),
        ((m % 4 == 0) | (m % 13 == 7)).alias("is_static"), ((m % 11 == 5) & (m % 13 != 7)).alias("is_constructor"), F.lit(True).alias("has_body"),
    )
    methods = methods.unionByName(spark.sql(f"SELECT cast(id AS long) AS method_id, -1L AS class_id, name, name AS signature, false AS is_static, false AS is_constructor, false AS has_body FROM VALUES {API} AS t(id, name)"))
    methods = methods.unionByName(spark.range(7).select((-100 - F.col("id")).alias("method_id"), F.col("id").alias("class_id"), F.lit("<init>").alias("name"), F.format_string("init%d", "id").alias("signature"), F.lit(False).alias("is_static"), F.lit(True).alias("is_constructor"), F.lit(False).alias("has_body")))
    classes = spark.range(7).select(F.col("id").alias("class_id"), F.format_string("pkg%d.C%d", "id", "id").alias("name"), F.format_string("pkg%d", "id").alias("package"), (F.col("id") == 6).alias("is_interface"), (F.col("id") >= 5).alias("is_library"))
    classes = classes.unionByName(spark.sql("SELECT -1L AS class_id, 'lang.Api' AS name, 'lang' AS package, false AS is_interface, true AS is_library"))
    supers = spark.range(1, 6).select(F.col("id").alias("class_id"), F.floor((F.col("id") - 1) / 2).alias("super_id"))
    implements = spark.sql("SELECT id AS class_id, 6L AS iface_id FROM VALUES (1L), (4L) AS t(id)")
    c = ev.cfg(spark, d).withColumn("is_exceptional", F.col("dst") % w == 4)
    alloc = units.where("new_class_id IS NOT NULL").select("unit_id", "method_id", (F.col("assigned_local") % 4).alias("slot"))
    pts = alloc.select(F.explode(F.array(m, m - 1)).alias("of"), "slot", F.col("unit_id").alias("alloc_unit")).select((F.col("of") * 4 + F.col("slot")).alias("local_id"), F.lit("new").alias("alloc_kind"), "alloc_unit", F.lit(None).cast("long").alias("alloc_local"), F.lit(None).cast("long").alias("alloc_class"))
    pts = pts.unionByName(users.select((F.col("user_id") * 4 + 1).alias("local_id"), F.lit("class").alias("alloc_kind"), F.lit(None).cast("long").alias("alloc_unit"), (F.col("user_id") * 4 + 2).alias("alloc_local"), (F.col("user_id") % 5).alias("alloc_class")))
    return Program(units, methods, classes, supers, implements, c, calls, pts).staged()
