"""Operator 7, benchmark decontamination by winnowing. DataFrame functions only.

Both sides are cut into words and k-grams of words; in every window of 13 words the smallest k-gram hash is kept, so two
texts that share 13 consecutive words share a kept hash. Training fingerprints are joined with the benchmark's; in the
documents that were hit, every window whose fingerprint is known is compared word by word with the benchmark's windows
(the extension), so a hash collision adds nothing. Items of fewer words than a window are one window of their length;
only the lengths that occur cost anything.

Nulls: a null text has no words and is never hit; null doc_ids are kept; a null item_id counts as no item, though its
windows hit. Repeated rows get equal results. An empty benchmark hits nothing. Extra columns are ignored by
contamination() and kept by clean_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import broadcast_if_small, count_plain, plain_words, row_key, same, stage, table

WINDOW = 13
GRAM = 4
EMPTY = "CAST(array() AS array<bigint>)"


def _shift(a: Column, by: int, n: Column) -> Column:
    """The first n - by elements of a without its first by, beside _head(a, by, n)."""
    return F.slice(a, F.lit(by + 1), F.greatest(n - by, F.lit(0)))


def _head(a: Column, by: int, n: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(n - by, F.lit(0)))


def _grams(h: Column, k: int) -> tuple[Column, int]:
    """Hashes of k consecutive words from the words' hashes, by doubling."""
    if k == 1:
        return h, 1
    half, rest = (k + 1) // 2, k // 2
    a, _ = _grams(h, half)
    b = a if rest == half else _grams(h, rest)[0]
    n = F.size(h) - (k - 1)
    return F.zip_with(F.slice(a, F.lit(1), F.greatest(n, F.lit(0))), F.slice(b, F.lit(half + 1), F.greatest(n, F.lit(0))), lambda x, y: F.xxhash64(x, y)), k


def winnow(df: DataFrame, words: str, window: int = WINDOW, out: str = "fp") -> DataFrame:
    """Adds out: for each window of words its smallest k-gram hash (aligned with the windows' starts)."""
    k = min(GRAM, window)
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("_m", _grams(F.col("_h"), k)[0])
    span = 1
    while span < window - k + 1:
        step = min(span, window - k + 1 - span)
        n = F.size("_m")
        df = df.withColumn("_m", F.zip_with(_head(F.col("_m"), step, n), _shift(F.col("_m"), step, n), lambda x, y: F.least(x, y)))
        span += step
    return df.withColumn(out, F.col("_m")).drop("_h", "_m")


def _words(t: Column) -> Column:
    return F.when(t == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.split(t, " "))


def _windows(words: str, window: int) -> Column:
    """The windows themselves, as texts."""
    n = F.size(words) - window
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, F.lit(window)), " "))).otherwise(F.expr("CAST(array() AS array<string>)"))


def _windows_at(prints: str, known: str, words: str, window: int) -> Column:
    """(i, s): the windows with a known fingerprint, as texts."""
    places = F.filter(F.transform(prints, lambda p, i: F.when(F.array_contains(known, p), i)), lambda i: i.isNotNull())
    return F.transform(places, lambda i: F.struct(i.alias("i"), F.array_join(F.slice(words, i + 1, F.lit(window)), " ").alias("s")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs: doc_id, th (hash of doc_id and text), n_words, n_hit, n_items, items, contaminated."""
    items = stage(benchmark.select("item_id", plain_words(F.col("text")).alias("t")).where(F.col("t") != "").withColumn("n", count_plain(F.col("t"))), "bench-items")
    lengths = sorted({r["n"] for r in items.where(F.col("n") < window).select("n").distinct().collect()})  # 12 at most
    every = [*lengths, window]
    parts = []
    for w in every:
        own = items.where(F.col("n") == w if w < window else F.col("n") >= w).withColumn("w", _words(F.col("t")))
        own = winnow(own, "w", w).withColumn("s", _windows("w", w))
        parts.append(own.select("item_id", F.explode(F.arrays_zip("fp", "s")).alias("x")).select("item_id", "x.fp", "x.s", F.lit(w).alias("len")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    known = stage(union.distinct(), "bench-windows")
    prints = broadcast_if_small(stage(known.select("fp").distinct(), "bench-prints"))

    d = docs.select("doc_id", row_key("doc_id", "text").alias("th"), plain_words(F.col("text")).alias("t"))
    d = d.withColumn("n_words", count_plain(F.col("t"))).withColumn("w", _words(F.col("t")))

    for w in every:
        d = winnow(d, "w", w, f"fp{w}")
    marks = d.select("doc_id", "th", "n_words", F.array_distinct(F.concat(*[F.col(f"fp{w}") for w in every])).alias("fps"))
    d = d.select("doc_id", "th", "t")
    marks = stage(marks, "doc-prints")
    hit = marks.select("doc_id", "th", F.explode("fps").alias("fp")).join(prints, "fp", "left_semi").groupBy("doc_id", "th").agg(F.collect_set("fp").alias("known"))
    hit = broadcast_if_small(stage(hit.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "known"), "doc-hits"))
    some = d.join(hit, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).dropDuplicates(["doc_id", "th"])
    some = stage(some.select("doc_id", "th", "t", "known"), "hit-texts").withColumn("w", _words(F.col("t")))
    found = []
    for w in every:
        # only windows with a known fingerprint are ever written out
        x = winnow(some, "w", w, "fp").select("doc_id", "th", F.explode(_windows_at("fp", "known", "w", w)).alias("x"))
        found.append(x.select("doc_id", "th", "x.i", F.lit(w).alias("len"), "x.s"))
    spans = found[0]
    for x in found[1:]:
        spans = spans.unionByName(x)
    spans = spans.join(broadcast_if_small(known.select("s", "len", "item_id")), ["s", "len"])
    by = spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("i", "len"))).alias("at"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    cover = F.aggregate("at", zero, lambda a, x: F.struct(F.greatest(a["end"], x["i"] + x["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["i"] + x["len"] - F.greatest(a["end"], x["i"]))).alias("n")), lambda a: a["n"])
    by = stage(by.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), cover.cast("long").alias("_hit"), F.col("items").alias("_items")), "doc-spans")
    out = marks.join(by, marks["doc_id"].eqNullSafe(by["_d"]) & (marks["th"] == by["_t"]), "left")
    n_hit = F.coalesce("_hit", F.lit(0).cast("long"))
    its = F.coalesce("_items", F.expr("CAST(array() AS array<string>)"))
    return out.select("doc_id", "th", "n_words", n_hit.alias("n_hit"), F.size(its).cast("long").alias("n_items"), its.alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; rows travel as structs, so that no name of theirs matters."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct()
    bad = broadcast_if_small(stage(bad, "contaminated"))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", row_key("doc_id", "text").alias("th"))
    return d.join(bad, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left_anti").select("row.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
