"""Operator 5, mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

A source's documents fall into blocks of about equal size by their hashes. Its supply is ``most`` passes of all its blocks;
in each pass the blocks are permuted anew, and the source's quota is how many of them, in that order, hold its target of
words (the last one only in part). A tree that halves the set of output shards splits every source's exact quota, each
node by one multivariate-hypergeometric draw; a leaf gets the next of the source's permuted blocks, so shards draw
disjoint blocks. What a document gives is what its blocks' shards draw. In a shard, rows are ordered by a second hash.

Sizes follow the input: a shard holds about ``shard_words`` words, a block a ``BLOCKS``-th of that (more where there would be
over ``most_blocks``, so that a source's order of blocks is no large task). The tree has ``leaves`` leaves at most; with more
shards than that, a leaf's blocks are dealt evenly, in their order, to the shards below it. On the driver is the tree
alone: one quota a source, and as many numbers as leaves that the source reaches.

Nulls: a null text has size 0, a null source is a source of its own (last). Empty texts are never drawn. Repeated rows
are separate documents. An empty table gives an empty result. Extra columns are kept by mix(), whatever their names,
unless they are the one that it adds (``_mix``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import SPACE_WORD, broadcast_if_small, stage, table

BLOCKS = 64


def word_size(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE_WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), ratio: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: sid, source, source_size, target; from rows of (source, size).

    Windows without a partition stand over one row per source only.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("sid") % len(weights)) + 1).cast("int"))
    per = per.withColumn("sid", F.row_number().over(order) - 1).withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    left = ratio * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by), F.lit(0.0))
    per = per.withColumn("level", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(by), F.lit(0.0))))
    free = F.max(F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("level"))).over(every)
    return per.select("sid", "source", "source_size", F.least("cap", F.coalesce(free * F.col("w"), F.col("cap"))).alias("target"))


def splitting_tree(quotas: list[int], shards: int, seed: int) -> list[list[tuple[int, int]]]:
    """quotas[s] blocks of each source among shards: result[s] has (shard, blocks of source s in it), in order, without zeros."""
    import numpy as np

    out: list[list[tuple[int, int]]] = [[] for _ in quotas]

    def split(who, counts, lo: int, hi: int, node: int) -> None:
        if not len(who):
            return
        if hi - lo == 1:
            for s, c in zip(who.tolist(), counts.tolist()):
                out[s].append((lo, c))
            return
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, node]))
        left = rng.multivariate_hypergeometric(counts, int(counts.sum()) * (mid - lo) // (hi - lo), method="marginals")
        for part, at, to, child in ((left, lo, mid, 2 * node), (counts - left, mid, hi, 2 * node + 1)):
            some = part > 0
            split(who[some], part[some], at, to, child)

    q = np.array(quotas, dtype=np.int64)
    split(np.flatnonzero(q), q[q > 0], 0, shards, 1)
    return out


def mix(docs: DataFrame, weights=(5, 2, 1), ratio: float = 1.5, most: float = 2.0, shard_words: int = 4_000_000, leaves: int = 4096, most_blocks: int = 1 << 22, seed: int = 7) -> DataFrame:
    """docs with _mix added: struct of size, source_size, target and draws, an array of (pass, words, shard, order).

    Each draw takes the first ``words`` words of the document. Sources may hold any share of the rows: documents meet
    in blocks, never in whole sources.
    """
    spark, cols = docs.sparkSession, docs.columns
    h = F.xxhash64(*[F.col(c) for c in ("doc_id", "source", "text") if c in cols], F.lit(seed))
    # the rows travel as one struct, so that no name of theirs meets one of these
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col("source"), word_size().alias("size"), h.alias("hash"))
    light = stage(base.select("source", "size", "hash"), "mix-sizes")
    per = source_targets(light, weights, ratio, most).withColumn("words", F.round("target").cast("long"))
    per = stage(per, "mix-targets")
    size, words = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    shards = max(1, -(-words // shard_words))
    unit = max(1, -(-size // min(shards * BLOCKS, most_blocks)))
    per = stage(per.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / unit)).cast("long")), "mix-sources")
    known = broadcast_if_small(per.select(F.col("source").alias("_source"), "sid", "blocks", "source_size", "target"))

    def in_blocks(d: DataFrame) -> DataFrame:
        d = d.join(known, d["source"].eqNullSafe(known["_source"])).drop("_source", "source")
        return d.withColumn("block", F.floor(F.shiftrightunsigned("hash", 11) / float(1 << 53) * F.col("blocks")))

    # the permuted blocks of every pass, with the words before them; a source's window is over its blocks, not its rows
    sums = in_blocks(light).groupBy("sid", "block").agg(F.sum("size").alias("held")).where("held > 0")
    sums = sums.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max(0, -int(-most // 1) - 1)))))
    order = Window.partitionBy("sid").orderBy("pass", F.xxhash64("sid", "block", "pass", F.lit(seed)), "block")
    sums = sums.withColumn("before", F.sum("held").over(order) - F.col("held")).withColumn("place", F.row_number().over(order).cast("long") - 1)
    drawn = sums.join(broadcast_if_small(per.select("sid", "words")), "sid").where("before < words")
    drawn = stage(drawn.select("sid", "block", "pass", "place", F.least("held", F.col("words") - F.col("before")).alias("limit")), "mix-blocks")
    quotas = {r["sid"]: r["n"] for r in drawn.groupBy("sid").agg(F.count("*").alias("n")).collect()}  # one per source
    top = min(shards, leaves)
    below = -(-shards // top)
    rows, ids = [], sorted(quotas)
    for sid, got in zip(ids, splitting_tree([quotas[s] for s in ids], top, seed)):
        at = 0
        for leaf, n in got:
            rows.append((sid, leaf, at, n))
            at += n
    tree = stage(spark.createDataFrame(rows, "sid int, leaf long, first long, n long"), "mix-tree")
    # a leaf's blocks are the places first .. first + n - 1 of its sources; each place finds its leaf as the last first at or before it
    marks = drawn.select("sid", "place", "block", "pass", "limit", F.lit(None).cast("long").alias("leaf"), F.lit(None).cast("long").alias("n"))
    marks = marks.unionByName(tree.select("sid", F.col("first").alias("place"), F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("pass"), F.lit(None).cast("long").alias("limit"), "leaf", "n"))
    last = Window.partitionBy("sid").orderBy("place", F.col("leaf").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("leaf").isNotNull(), F.struct("leaf", "place", "n")), True).over(last)
    plan = marks.withColumn("own", own).where("block IS NOT NULL AND place < own.place + own.n")
    shard = F.least(F.col("own.leaf") * below + F.floor((F.col("place") - F.col("own.place")) * below / F.col("own.n")), F.lit(shards - 1))
    plan = plan.groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "limit", shard.cast("long").alias("shard")))).alias("plan"))
    plan = stage(plan.withColumnRenamed("sid", "_sid").withColumnRenamed("block", "_block"), "mix-plan")

    before = Window.partitionBy("sid", "block").orderBy("hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = in_blocks(base).withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    plan = broadcast_if_small(plan)
    d = d.join(plan, (F.col("sid") == F.col("_sid")) & (F.col("block") == F.col("_block")), "left")

    def draw(x: Column) -> Column:
        some = F.greatest(F.lit(0), F.least(F.col("size"), x["limit"] - F.col("at")))
        return F.struct(x["pass"].alias("pass"), some.cast("long").alias("words"), x["shard"].alias("shard"), F.xxhash64(F.col("hash"), x["pass"], F.lit(seed + 1)).alias("order"))

    none = F.expr("CAST(array() AS array<struct<pass:int,words:bigint,shard:bigint,order:bigint>>)")
    draws = F.coalesce(F.filter(F.transform("plan", draw), lambda x: x["words"] > 0), none)
    return d.select("row", F.struct("size", "source_size", "target", draws.alias("draws")).alias("_mix")).select("row.*", "_mix")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: one row per draw with the words that it takes (a cut text ends after its last taken word).

    Rows of a shard stand together, ordered by the shard's own shuffle; columns as in docs.
    """
    cols = docs.columns
    d = mix(docs, **how).select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.col("_mix.size").alias("size"), F.explode("_mix.draws").alias("d"))
    cut = F.col("d.words") < F.col("size")
    head = F.call_function("regexp_extract", F.col("row.text"), F.concat(F.lit(r"(?s)\A[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){"), F.col("d.words").cast("string"), F.lit("}+")), F.lit(0))
    d = d.withColumn("head", F.when(cut, head).otherwise(F.col("row.text")))
    new = {"text": F.col("head"), "n_chars": F.when(cut, F.length("head").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in cols else None}
    d = d.repartition("d.shard").sortWithinPartitions("d.shard", "d.order")
    return d.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"row.`{c}`") for c in cols])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "_mix.*")
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return d.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
