"""Operator 4, approximate nearest neighbours by cosine over robust-pruned directed graphs, one graph per shard.

Equal vectors are one node, which keeps the smallest ids of its rows (k + 1 of them: more cannot be among a query's k
nearest, as ties go to smaller ids). Nodes are dealt to shards of about ``shard_size`` by hash; a shard's graph is grown in
batches: greedy searches over what stands already propose neighbours, relaxed distance pruning (alpha) keeps diverse
edges, reverse edges are pruned alike. A query is a beam search in every shard: a shard's index goes to one task for every
``per_task`` queries, which stream past it. The shards' answers are merged and scored in double precision on the original
vectors (scaled by powers of two, which is exact, so that very large and very small components have a cosine too).

Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do null ids. Vectors of other
dimensions are other shards. An id that occurs twice is two candidates, and never a neighbour of its own query. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import parts_for, stage, table

INDEX = "dim int, shard int, n int, ids binary, vectors binary, graph binary, entry int"


def search(x, graph, entry: int, q, beam: int, wide: int = 4):
    """Beam searches of all rows of q at once: positions and similarities of what is in the beams, best first."""
    import numpy as np

    b, r = len(q), graph.shape[1]
    rows = np.arange(b)[:, None]
    ids = np.full((b, beam), -1, np.int32)
    sim = np.full((b, beam), -np.inf, np.float32)
    seen = np.ones((b, beam), bool)
    ids[:, 0], sim[:, 0], seen[:, 0] = entry, q @ x[entry], False
    while not seen.all():
        rank = np.argsort(seen, axis=1, kind="stable")[:, :wide]  # the beam is sorted: its first unvisited members
        fresh = ~seen[rows, rank]
        seen[rows, rank] = True
        node = np.where(fresh, ids[rows, rank], -1)
        new = np.where(node[:, :, None] >= 0, graph[node], -1).reshape(b, wide * r)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        ok = (new >= 0) & ~(new[:, :, None] == ids[:, None, :]).any(2)
        s = np.full(new.shape, -np.inf, np.float32)
        i, j = np.nonzero(ok)
        s[i, j] = np.einsum("nd,nd->n", x[new[i, j]], q[i])
        new[~ok] = -1
        ids, sim, seen = np.concatenate([ids, new], 1), np.concatenate([sim, s], 1), np.concatenate([seen, ~ok], 1)
        top = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
        ids, sim, seen = ids[rows, top], sim[rows, top], seen[rows, top]
    return ids, sim


def prune(x, p, cand, degree: int, alpha: float):
    """For each node p its at most degree diverse neighbours among cand (positions, -1 for none)."""
    import numpy as np

    b, c = cand.shape
    cand = np.where(cand == p[:, None], -1, cand)
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    near = np.where(cand >= 0, np.einsum("bcd,bd->bc", x[cand], x[p]), -np.inf)
    order = np.argsort(-near, axis=1, kind="stable")[:, : 4 * degree]
    rows = np.arange(b)[:, None]
    cand, near = cand[rows, order], near[rows, order]
    v = x[cand]
    far = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    own = np.where(cand >= 0, 2 - 2 * near, np.inf)
    alive, out, at = cand >= 0, np.full((b, degree), -1, np.int32), np.arange(b)
    for k in range(degree):
        pick = alive.argmax(1)
        some = alive[at, pick]
        if not some.any():
            break
        out[some, k] = cand[at, pick][some]
        alive &= alpha * alpha * far[at, pick] > own
        alive[at, pick] = False
    return out


def build(x, degree: int = 32, beam: int = 64, alpha: float = 1.1, batch: int = 512):
    """The graph over unit vectors x (n x degree positions, -1 for none) and its entry."""
    import numpy as np

    n = len(x)
    graph = np.full((n, degree), -1, np.int32)
    entry = int((x @ x.mean(0)).argmax())
    order = np.random.default_rng(5).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        p = order[at : at + max(1, min(at, batch))]
        at += len(p)
        found, _ = search(x, graph, entry, x[p], beam)
        # the batch's own members are proposed to each other, as none of them stands in the graph yet
        mates = np.argsort(-(x[p] @ x[p].T), axis=1)[:, 1 : 1 + degree // 2]
        graph[p] = prune(x, p, np.concatenate([found, p[mates].astype(np.int32)], 1), degree, alpha)
        src, k = np.nonzero(graph[p] >= 0)
        to, fro = graph[p][src, k], p[src].astype(np.int32)
        o = np.argsort(to, kind="stable")
        to, fro = to[o], fro[o]
        u, first, size = np.unique(to, return_index=True, return_counts=True)
        for lo in range(0, len(u), 256):
            uu, ss = u[lo : lo + 256], size[lo : lo + 256]
            more = np.full((len(uu), ss.max()), -1, np.int32)
            i = np.repeat(np.arange(len(uu)), ss)
            j = np.arange(ss.sum()) - np.repeat(np.cumsum(ss) - ss, ss)
            more[i, j] = fro[first[lo] : first[lo] + ss.sum()]
            both = np.concatenate([graph[uu], more], 1)
            full = (both >= 0).sum(1) > degree
            if full.any():
                graph[uu[full]] = prune(x, uu[full], both[full], degree, alpha)
            if (~full).any():
                graph[uu[~full]] = -np.sort(-both[~full], axis=1)[:, :degree]
    return graph, entry


def scaled(v):
    """Rows of v times the power of two that brings their largest component to about one."""
    import numpy as np

    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def usable(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    good = (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(good).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("v"))


def build_index(vectors: DataFrame, k: int = 5, shard_size: int = 8192, **how) -> DataFrame:
    """One row of INDEX per shard, written to the shared folder; every usable vector is in it."""
    good = usable(vectors)
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(256))
    least = f"slice(array_sort(flatten(collect_list(ids))), 1, {k + 1})"
    nodes = good.groupBy("v", salt.alias("salt")).agg(F.expr(f"slice(array_sort(collect_list(vec_id)), 1, {k + 1})").alias("ids")).groupBy("v").agg(F.expr(least).alias("ids"))
    nodes = stage(nodes, "ann-nodes")
    shards = parts_for(nodes.count(), shard_size)
    nodes = nodes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "v", "ids")

    def grow(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("ids", key=lambda s: s.map(lambda x: x[0]))
        v = np.array(pdf["v"].tolist(), np.float64)
        v = scaled(v)
        unit = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
        ids = np.array([[*x, *[-1] * (k + 1 - len(x))] for x in pdf["ids"]], np.int64)
        have = np.array([len(x) for x in pdf["ids"]], np.int64)
        graph, entry = build(unit, **how)
        blob = np.concatenate([have[:, None], ids], 1).tobytes()
        return pd.DataFrame([[int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0]), len(v), blob, v.tobytes(), graph.tobytes(), entry]], columns=[c.split()[0] for c in INDEX.split(", ")])

    return stage(nodes.groupBy("dim", "shard").applyInPandas(grow, INDEX), "ann-index")  # a shard is small by its size


def nearest(index: DataFrame, queries: DataFrame, k: int = 5, beam: int = 128, per_task: int = 100_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of queries (vec_id, embedding)."""
    q = stage(usable(queries).select(F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim")), "ann-queries")
    tasks = parts_for(q.count(), per_task)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    shards = index.select(F.col("dim").alias("d2"), "shard")
    asked = q.join(shards, F.col("dim") == F.col("d2")).select("dim", "shard", F.pmod(F.xxhash64("query_id"), F.lit(tasks)).cast("int").alias("part"), F.lit(1).alias("kind"), "query_id", "v", *[none(t, c) for c, t in (x.split() for x in INDEX.split(", ")[2:])])
    held = index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("part"), F.lit(0).alias("kind"), none("long", "query_id"), none("array<double>", "v"), "n", "ids", "vectors", "graph", "entry")

    def answers(r, own, x):
        """(query_id, vec_id, score) arrays of the queries own, with vectors x, in the shard r."""
        import numpy as np
        import pandas as pd

        v, norm, unit, graph, meta, entry = r
        x = scaled(x)
        xn = np.linalg.norm(x, axis=1)
        found, _ = search(unit, graph, entry, (x / xn[:, None]).astype(np.float32), beam)
        keep = found[:, : 4 * k]
        i, j = np.nonzero(keep >= 0)
        node = keep[i, j]
        exact = (v[node] * x[i]).sum(1) / (norm[node] * xn[i])
        ids = meta[node]
        width = ids.shape[1] - 1
        f = pd.DataFrame({"query_id": np.repeat(own[i], width), "vec_id": ids[:, 1:].ravel(), "score": np.repeat(exact, width), "ok": (np.arange(width)[None, :] < ids[:, :1]).ravel()})
        f = f[f.ok & (f.query_id != f.vec_id)].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return f.groupby("query_id").head(k)[["query_id", "vec_id", "score"]]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        now = None
        for batch in batches:
            kind = batch.column(3).to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (kind[1:] == 0) | (kind[:-1] == 0)])).tolist()
            for lo, hi in zip(cut, [*cut[1:], batch.num_rows]):
                b = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    r = b.to_pylist()[0]
                    v = scaled(np.frombuffer(r["vectors"], np.float64).reshape(r["n"], r["dim"]))
                    norm = np.linalg.norm(v, axis=1)
                    now = (v, norm, (v / norm[:, None]).astype(np.float32), np.frombuffer(r["graph"], np.int32).reshape(r["n"], -1), np.frombuffer(r["ids"], np.int64).reshape(r["n"], -1), r["entry"])
                    continue
                for at in range(0, b.num_rows, 256):
                    c = b.slice(at, 256)
                    x = c.column(5).flatten().to_numpy().reshape(c.num_rows, -1)
                    f = answers(now, c.column(4).to_numpy(), x)
                    yield pa.RecordBatch.from_pandas(f, preserve_index=False)

    both = held.unionByName(asked).repartition("dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "kind")
    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(build_index(e), e.where(F.col("vec_id") % 50 == 0))
