"""The algebra of statement sequences as Column functions. A fact is (kind, seq): kind 0 zero, 1 sequence, 2 epsilon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ZERO, SEQUENCE, EPSILON = 0, 1, 2


def head(seq: Column) -> Column:
    return F.try_element_at(seq, F.lit(1))


def tail(seq: Column) -> Column:
    return F.try_element_at(seq, F.lit(-1))


def add_head(unit: Column, seq: Column) -> Column:
    return F.concat(F.array(unit), seq)


def rest(seq: Column) -> Column:
    """All but the head; empty for sequences of one or none."""
    return F.when(F.size(seq) > 1, F.slice(seq, F.lit(2), F.greatest(F.size(seq) - 1, F.lit(1)))).otherwise(F.slice(seq, 1, 0))


def kind_without_head(seq: Column) -> Column:
    return F.when(F.size(seq) <= 1, F.lit(EPSILON)).otherwise(F.lit(SEQUENCE))


def can_remove_head(unit: Column, seq: Column) -> Column:
    return F.coalesce(head(seq) == unit, F.lit(False))


def proper_suffix(short: Column, long: Column) -> Column:
    n = F.size(short)
    return F.when((n > 0) & (n < F.size(long)), F.slice(long, F.size(long) - n + 1, F.greatest(n, F.lit(1))) == short).otherwise((n == 0) & (F.size(long) > 0))


def suffixes(seq: Column) -> Column:
    """Every non-empty suffix, the sequence itself included."""
    n = F.size(seq)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.slice(seq, i, n - i + 1))).otherwise(F.array(seq.cast("array<bigint>")))


def joined(seq: Column) -> Column:
    return F.array_join(F.transform(seq, lambda x: x.cast("string")), ",")


def follow_until(sequences: DataFrame, heads: DataFrame) -> DataFrame:
    """(unit_id, suffix) of sequences (seq) as in follow sets, each sequence only up to its first unit that is a head (n)."""
    x = sequences.select("seq", F.posexplode("seq").alias("i", "n"))
    x = x.join(heads.select("n", F.lit(True).alias("_head")).distinct(), "n", "left").groupBy("seq").agg(F.min(F.when(F.col("_head"), F.col("i"))).alias("stop"))
    last = F.least(F.coalesce("stop", F.size("seq")), F.size("seq") - 1)
    s = x.where(last > 0).select(F.explode(F.transform(F.sequence(F.lit(1), last), lambda k: F.struct(F.element_at("seq", k).alias("unit_id"), F.slice("seq", k + 1, F.size("seq") - k).alias("suffix")))).alias("x"))
    return s.select("x.unit_id", "x.suffix").distinct()


def interned(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, set_id): the sets of values by key; equal sets have one number, that of their smallest key."""
    s = rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("_s"))
    return s.select(key, F.min(key).over(Window.partitionBy("_s")).alias("set_id"))
