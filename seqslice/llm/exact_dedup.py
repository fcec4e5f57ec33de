"""Operator 3, suffix-array deduplication: removes the bytes of every 400-byte string that also starts elsewhere.

In each 400-byte window the smallest hash of a 32-byte gram (its upper 32 bits, the leftmost of equals) is the window's
anchor, so equal windows have equal anchors. Consecutive windows of one anchor hash are one segment of text (under 800
bytes, but for periodic text, which stays one segment however long), and segments are grouped by the anchor's hash. Equal
segments repeat wholly and need no comparing. Where an anchor has different segments, one of each kind goes to a shard,
whose suffix array is induced (suffixes.py); permuted common prefixes of at least 400 give the repeated windows. Anchors
with many different segments are split: their windows are dealt by their distance from the anchor in steps of ``STEP`` and
by the hash of the bytes that all windows of a step hold (the core), so that variants of a popular passage spread over
shards. A core that still has more than ``crowd`` segments is cut into segments of one window, and those are equal
or not as wholes, so no task holds a popular core. Removal is judged on the input.

Nulls: a null text is empty. Documents are told apart by doc_id (null is a value) and the hash of their text; repeated rows
repeat each other. Texts under 400 bytes lose nothing. An empty table gives an empty result; extra columns are ignored.
Segments are held equal by 128-bit hashes, all else is compared byte by byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import broadcast_if_small, drop_stage, row_key, small_batches, stage, table

NEED = 400
GRAM = 32
STEP = 16
ANCHORS = "doc_id long, th long, a int, b int, p int, m boolean, h long, k1 long, k2 long"
SEGMENTS = "shard long, doc_id long, th long, start int, s binary"


def _gram_hashes(t):
    """Hashes of the GRAM bytes at each place of t, by doubling."""
    import numpy as np

    h = t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x2545F4914F6CDD1D)
    step = 1
    while step < GRAM:
        h = (h[:-step] ^ (h[:-step] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * step) + h[step:] * np.uint64(0x94D049BB133111EB)
        step *= 2
    return h ^ (h >> np.uint64(31))


def _runs(text: bytes):
    """Arrays a, b, p, hash: the runs of window starts a..b with one anchor, at p."""
    import numpy as np

    n = len(text) - NEED + 1
    h = _gram_hashes(np.frombuffer(text, np.uint8))
    w = NEED - GRAM + 1
    low = np.uint64((1 << 32) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    pad = -len(key) % w
    full = np.concatenate([key, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(full, 1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(right[:n], left[w - 1 : w - 1 + n]) & low
    cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    p = least[cut].astype(np.int64)
    return cut, np.append(cut[1:], n) - 1, p, h[p].astype(np.int64)


def anchors(text: bytes):
    """(a, b, p, more, hash) of each run of window starts a..b with one anchor hash, first at p; more: at other places too."""
    import numpy as np

    if len(text) < NEED:
        return []
    a, b, p, h = _runs(text)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    last = np.append(first[1:], len(h)) - 1
    return list(zip(a[first].tolist(), b[last].tolist(), p[first].tolist(), (last > first).tolist(), h[first].tolist()))


def _arrow(rows, spec: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    f = [x.split() for x in spec.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), f)], names=[n for n, _ in f])


def _keyed(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", row_key("text").alias("th"), "text")


def find_anchors(docs: DataFrame) -> DataFrame:
    def run(batches):
        import xxhash

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = []
                for doc, th, t in zip(*(batch.slice(lo, 500).column(i).to_pylist() for i in range(3))):
                    t = t.encode()
                    for a, b, p, m, h in anchors(t):
                        k = xxhash.xxh3_128_digest(t[a : b + NEED])
                        rows.append((doc, th, a, b, p, m, h, int.from_bytes(k[:8], "little", signed=True), int.from_bytes(k[8:], "little", signed=True)))
                if rows:
                    yield _arrow(rows, ANCHORS)

    return _keyed(docs).mapInArrow(run, ANCHORS)


def _segments(docs: DataFrame, wanted: DataFrame, split: bool) -> DataFrame:
    """Segments of text as rows of SEGMENTS, from wanted: doc_id, th, at: array of (a, b, p, m, h). split: by cores."""

    def run(batches):
        import xxhash

        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                rows = []
                for doc, th, t, at in zip(*(batch.slice(lo, 200).column(i).to_pylist() for i in range(4))):
                    t = t.encode()
                    for x in at:
                        a, b, p = x["a"], x["b"], x["p"]
                        if not split:
                            rows.append((x["h"], doc, th, a, t[a : b + NEED]))
                            continue
                        # segments with several anchor places are periodic; each place is a run of its own here
                        own = [(a, b, p)] if not x["m"] else [(a + i, a + j, a + q) for i, j, q, _ in zip(*(v.tolist() for v in _runs(t[a : b + NEED])))]
                        for a, b, p in own:
                            for r in range((p - b) // STEP, (p - a) // STEP + 1):
                                first, last = max(a, p - STEP * r - STEP + 1), min(b, p - STEP * r)
                                core = t[p - STEP * r : p - STEP * r - STEP + 1 + NEED]
                                rows.append((xxhash.xxh3_64_intdigest(core, seed=r) - 2**63, doc, th, first, t[first : last + NEED]))
                if rows:
                    yield _arrow(rows, SEGMENTS)

    w = wanted.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "at")
    d = _keyed(docs)
    return d.join(w, d["doc_id"].eqNullSafe(w["_d"]) & (d["th"] == w["_t"])).dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "text", "at").mapInArrow(run, SEGMENTS)


def _crowded(segments: DataFrame) -> DataFrame:
    """(doc_id, th, a, b): of segments cut into single windows, those that stand there more than once."""
    one = F.expr("substring(s, i + 1, 400)")
    x = segments.withColumn("i", F.explode(F.sequence(F.lit(0), F.length("s") - NEED))).select("doc_id", "th", (F.col("start") + F.col("i")).alias("a"), F.xxhash64(one).alias("w1"), F.xxhash64(F.lit(1), one).alias("w2"))
    x = stage(x, "crowded-windows")
    often = x.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    return x.join(often, ["w1", "w2"], "left_semi").select("doc_id", "th", "a", F.col("a").alias("b"))


def _in_shards(segments: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """(doc_id, th, a, b): runs of repeated window starts; a shard's text is sorted in pieces that keep its groups whole."""

    def run(batches):
        import numpy as np

        from .suffixes import repeated

        def sort(held):
            size = np.array([len(x[4]) + 1 for x in held])
            mask = repeated(np.frombuffer(b"".join(x[4].replace(b"\0", b"\xff") + b"\0" for x in held), np.uint8).astype(np.int64), NEED)
            at = np.cumsum(size) - size
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            own = np.searchsorted(at, edge[::2], side="right") - 1
            return [(held[k][1], held[k][2], int(held[k][3] + i - at[k]), int(held[k][3] + j - 1 - at[k])) for k, i, j in zip(own, edge[::2], edge[1::2])]

        held, total, last, out = [], 0, None, []
        for batch in batches:
            for x in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if x[0] != last and total > chunk:
                    out += sort(held)
                    held, total = [], 0
                    if out:
                        yield _arrow(out, "doc_id long, th long, a int, b int")
                        out = []
                last = x[0]
                held.append(x)
                total += len(x[4]) + 1
        if held:
            out += sort(held)
        if out:
            yield _arrow(out, "doc_id long, th long, a int, b int")

    return segments.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "doc_id long, th long, a int, b int")


def removals(docs: DataFrame, hot: int = 1000, crowd: int = 4096) -> DataFrame:
    """(doc_id, th, spans): window starts, as runs (a, b), that repeat. hot: segments of an anchor that are split by cores if
    there are more; crowd: segments of a core that are cut into windows if there are more."""
    small_batches(docs.sparkSession)
    every = stage(find_anchors(docs), "anchors")
    kinds = every.groupBy("h", "k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "a", "b", "p", "m")).alias("x"))
    kinds = stage(kinds, "segment-kinds")
    per = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), F.bool_or("x.m").alias("own")).where("total > 1 OR own")
    kinds2 = stage(kinds.join(per, "h"), "repeated-anchors")
    drop_stage(kinds)
    same = kinds2.where("n > 1").select("h", "k1", "k2")
    both = every.join(same, ["h", "k1", "k2"], "left_semi").select("doc_id", "th", "a", "b")
    ship = kinds2.where("kinds > 1 OR x.m").select("x.doc_id", "x.th", F.struct("x.a", "x.b", "x.p", "x.m", "h").alias("s"), (F.col("kinds") > hot).alias("hot"))
    ship = stage(ship.groupBy("doc_id", "th", "hot").agg(F.collect_list("s").alias("at")), "segments-wanted")
    cold = _segments(docs, broadcast_if_small(ship.where("not hot"), 16 << 20), False)
    if not ship.where("hot").isEmpty():
        split = stage(_segments(docs, broadcast_if_small(stage(ship.where("hot"), "hot-segments"), 16 << 20), True), "split-segments")
        many = broadcast_if_small(stage(split.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("shard"), "crowded-cores"))
        cold = cold.unionByName(split.join(many, "shard", "left_anti").select(*split.columns))
        both = both.unionByName(_crowded(split.join(many, "shard", "left_semi")))
    both = both.unionByName(_in_shards(cold))
    return both.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    spec = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches):
        from hashlib import sha256

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = []
                for doc, t, at in zip(*(batch.slice(lo, 500).column(i).to_pylist() for i in range(3))):
                    t = t.encode()
                    kept, end, gone, n = [], 0, 0, 0
                    start = 0
                    for x in at or ():
                        a, b = x["a"], x["b"] + NEED
                        if n and a <= end:
                            gone += max(0, b - end)
                            end = max(end, b)
                        else:
                            kept.append(t[start if n == 0 else end : a])
                            n, gone, end = n + 1, gone + b - a, b
                    kept = b"".join([*kept, t[end:]])
                    rows.append((doc, len(t), gone, n, sha256(kept).hexdigest(), kept))
                if rows:
                    yield _arrow(rows, spec)

    s = spans.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "spans")
    d = _keyed(docs)
    return d.join(s, d["doc_id"].eqNullSafe(s["_d"]) & (d["th"] == s["_t"]), "left").select("doc_id", "text", "spans").mapInArrow(run, spec)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans = broadcast_if_small(stage(removals(docs), "removals"), 16 << 20)
    return cut(docs, spans).drop("kept")
