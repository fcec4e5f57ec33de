"""The ten operators on a small table with nulls, empty and long texts, ties and repeated rows, against plain Python."""

import pyarrow.parquet as pq
import pytest

from seqslice.llm import ann, chat, decontam, exact_dedup, jaccard, licenses, mixing, pii, quality, token_output

from . import brute as B

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, extra string"


def rows():
    own = [(r["doc_id"], r["text"], r["source"], "x") for r in pq.read_table(f"{D}/documents.parquet").to_pylist()[:60]]
    odd = [None, "", " \n", "a", "CC BY cc by", "all rights reserved", "x@y.z +1 (555) 123-4567 4111 1111 1111 1111 1.2.3.4", "ab " * 20000, "one two three four five six", "One two three four five six"]
    return own + [(10_000 + i, t, None if i % 2 else "zz", "x") for i, t in enumerate(odd)] + own[:3] + [(10_006, odd[6], "zz", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


def dicts():
    return [dict(doc_id=a, text=b, source=c) for a, b, c, _ in rows()]


def same(df, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


def test_pii(docs):
    from pyspark.sql import functions as F

    d = pii.find(docs)
    counts = [F.size(F.filter("base", (lambda k: lambda x: x["kind"] == k)(k))).cast("long") for k in range(4)]
    same(d.select("doc_id", *counts, F.sha2(pii.joined("base"), 256)), B.op2(dicts()))


def test_exact_dedup(docs):
    for how in ({}, {"hot": 1}, {"hot": 1, "crowd": 1}):
        same(exact_dedup.cut(docs, exact_dedup.removals(docs, **how)).drop("kept"), B.op3(dicts()))


def test_exact_dedup_of_hot_passages(spark):
    """Near copies of one passage, periodic texts and a passage at odd places, through every way of splitting."""
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    core = text(120)
    x = [text(r.randint(0, 30)) + core + text(r.randint(0, 30)) for _ in range(30)]
    x += [core[:300] + text(3) + core[300:] for _ in range(10)] + ["z" * 3000, "z" * 900 + core, "yz" * 700, "zy" * 500 + "z" * 500, core[7:450]]
    rows = [dict(doc_id=i, text=t) for i, t in enumerate(x)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(x)], "doc_id long, text string")
    assert len(exact_dedup.anchors(b"z" * 100_000)) == 1
    for how in ({}, {"hot": 1}, {"hot": 1, "crowd": 3}):
        same(exact_dedup.cut(d, exact_dedup.removals(d, **how)).drop("kept"), B.op3(rows))


def test_jaccard(docs):
    for how in ({}, {"block": 60}):
        same(jaccard.groups(docs, **how), B.op6(dicts()))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns


def test_decontamination(spark, docs):
    from pyspark.sql import functions as F

    bench = pq.read_table(f"{D}/benchmark.parquet").to_pylist() + [dict(item_id=900, text="one two three"), dict(item_id=901, text=None), dict(item_id=902, text="a")]
    b = spark.createDataFrame([(r["item_id"], r["text"]) for r in bench], "item_id long, text string")
    d = decontam.contamination(docs, b)
    same(d.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated"), B.op7(dicts(), bench))


def test_licenses(docs):
    from pyspark.sql import functions as F

    d = licenses.scan(docs)
    d = d.select("doc_id", "n_words", F.size("places").cast("long"), F.array_min("places").cast("long"), F.array_max("places").cast("long"), F.array_join("base", ","))
    same(d, B.op9(dicts()))


@pytest.mark.parametrize("how", [{}, {"shard_words": 3000}, {"shard_words": 500, "leaves": 8}, {"most_blocks": 3}])
def test_mixing(docs, how):
    d = mixing.mix(docs, **how).select("doc_id", "source", "_mix.*").collect()
    size, target = B.op5_targets(dicts())
    taken = {s: 0 for s in size}
    for r in d:
        t = sum(x["words"] for x in r["draws"])
        assert t <= 2 * r["size"] and r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert len({x["pass"] for x in r["draws"]}) == len(r["draws"])
        taken[r["source"]] += t
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    in_shards: dict = {}
    for x in (x for r in d for x in r["draws"]):
        in_shards[x["shard"]] = in_shards.get(x["shard"], 0) + x["words"]
    n = max(1, -(-sum(round(t) for t in target.values()) // how.get("shard_words", 4_000_000)))
    assert set(in_shards) <= set(range(n)) and len(in_shards) >= min(n, 3)


def test_splitting_tree():
    q = [1000, 0, 37, 1]
    t = mixing.splitting_tree(q, 6, 7)
    assert [sum(n for _, n in x) for x in t] == q and t == mixing.splitting_tree(q, 6, 7)
    every = [sum(n for x in t for k, n in x if k == s) for s in range(6)]
    assert sum(every) == 1038 and max(every) - min(every) <= 2


def test_mixed_documents(spark, docs):
    """Reruns agree; the rows are the draws' words; clashing names stay; the sources' words are the targets."""
    x = docs.withColumnsRenamed({"extra": "size"}).selectExpr("*", "1 AS hash", "2 AS block", "3 AS _size", "4 AS _before", "5 AS sid", "6 AS plan", "length(text) AS n_chars")
    one, two = (sorted(map(str, mixing.mixed_documents(x, shard_words=3000).collect())) for _ in range(2))
    assert one == two and mixing.mixed_documents(x).columns == x.columns
    got: dict = {}
    for r in mixing.mixed_documents(x, shard_words=3000).collect():
        assert r.n_chars == len(r.text) and (r.hash, r.block, r["_size"], r["_before"], r.sid, r.plan, r["size"]) == (1, 2, 3, 4, 5, 6, "x")
        got[r.source] = got.get(r.source, 0) + len(B.space(r.text))
    _, target = B.op5_targets(dicts())
    assert all(abs(got.get(s, 0) - t) <= 1 for s, t in target.items())


def test_tokens(spark, docs, tmp_path):
    d = docs.where("doc_id >= 10000").dropDuplicates(["doc_id"])
    path = str(tmp_path / "t")
    token_output.write_token_files(d, path, token_output.tokenizer_file(), block_bytes=64, shard_bytes=1 << 16)
    want = B.op1([r.asDict() for r in d.collect()], token_output.tokenizer_file())
    same(token_output.read_token_files(spark, path).drop("ids_bytes"), want)
    assert len(token_output.read_document(spark, path, 10_008)[0]) == next(w[2] for w in want if w[0] == 10_008)


def test_chat(spark):
    ok = "</s>[INST] ok [/INST]"
    x = [(1, i, ("system", "user", "assistant")[min(i, 1 + i % 2)] if i else "system", f"{i} <\\s> [\\INST] " + "word " * (i * 20)) for i in range(14)]
    x += [(2, 0, "user", None), (2, 0, None, ok), (None, None, "assistant", ok), (-7, 0, "user", ok), (-7, 1, "assistant", ok)]
    w = chat.format_windows(spark.createDataFrame(x, "conv_id long, turn long, role string, text string"), token_output.tokenizer_file("byte_bpe_50k.json"), budget=300, history=120)
    assert w.where("conv_id = 1").count() > 2
    back = chat.read_back(w)
    same(back.drop("formatted_chars", "n_windows"), B.op8([dict(zip(("conv_id", "turn", "role", "text"), r)) for r in x]))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_output.tokenizer_file("byte_bpe_50k.json"))
    size = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    rows = w.collect()
    assert {r.conv_id: r.formatted_chars for r in back.collect()} == {c: sum(len(r.formatted) for r in rows if r.conv_id == c) for c in {r.conv_id for r in rows}}
    for r in rows:
        assert r.n_tokens == sum(size(t + "</s>") for t in r.formatted.split("</s>")[:-1]) and (r.n_tokens <= 300 or r.n_turns - r.n_repeated == 1)


@pytest.mark.parametrize("per_task", [100_000, 3])
def test_neighbours(spark, per_task):
    """Recall, ranks, ties, copies and scores, with very large and very small components among them."""
    import numpy as np

    r = np.random.default_rng(1)
    v = r.normal(size=(600, 16))
    v[300:320] = v[0]
    scale = np.ones(600)
    scale[100:110], scale[150:160] = 1e200, 1e-200
    x = [(i, [float(a) for a in row]) for i, row in enumerate(v * scale[:, None])] + [(700, None), (750, [0.0] * 16), (800, [float("nan")] * 16), (850, []), (900, [1.0, float("inf")]), (950, [1.0, None]), (1000, [1.0, 2.0]), (None, [1.0] * 16)]
    e = spark.createDataFrame([(*y, "x") for y in x], "vec_id long, embedding array<double>, shard string")
    got = ann.nearest(ann.build_index(e, shard_size=200), e.where("vec_id % 50 = 0"), per_task=per_task).collect()
    u, hit = v / np.linalg.norm(v, axis=1, keepdims=True), 0
    for q in range(0, 600, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        own = sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)
        hit += len(set(np.lexsort((np.arange(600), -s))[:5].tolist()) & {g.vec_id for g in own})
        assert [g.rank for g in own] == [1, 2, 3, 4, 5] and all(abs(g.score - u[q] @ u[g.vec_id]) < 1e-9 for g in own)
        assert own == sorted(own, key=lambda g: (-g.score, g.vec_id))
    assert [g.vec_id for g in sorted((g for g in got if g.query_id == 0), key=lambda g: g.rank)] == [300, 301, 302, 303, 304]
    assert len(got) == 60 and hit >= 54


def test_quality(spark):
    d = spark.read.parquet(f"{D}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{D}/../sf0.01/labels.parquet")
    s = quality.scored(d.select("doc_id", "text"), quality.train(d, labels)).selectExpr("row.doc_id", "score").join(labels, "doc_id").where(quality.held_out()).collect()
    assert sum((r.score >= quality.THRESHOLD) == r.quality for r in s) >= 0.9 * len(s)


def statistics(t):
    """The statistics of a text in plain Python, in the operator's order."""
    import re

    t = t or ""
    w = re.sub(r"[\x20\x09-\x0D]+", " ", t).strip(" ").split(" ")
    lines, n = t.split("\n"), max(1, len(t))
    share = lambda f: sum(map(f, t)) / n
    return [len(t), len(w), len(t) / len(w), share(lambda c: __import__("unicodedata").category(c) == "Lu"), share(lambda c: c in "0123456789"), share(lambda c: c in "#$%&*+=<>{}\\^~_@/"), share(lambda c: c == "|"), share(lambda c: c in "!?"), share(lambda c: c in ".,;:"), len(set(w)) / len(w), sum(a == b for a, b in zip(w, w[1:])) / len(w), len(set(lines)) / len(lines), len(w) / len(lines), max(map(len, w))]


def test_quality_scores(spark, docs):
    """Scores are the model's rules over statistics that plain Python gives, whatever the columns are called."""
    import math

    import numpy as np

    labels = spark.createDataFrame([(r["doc_id"], int(len(r["text"] or "") % 2)) for r in dicts() if r["doc_id"] is not None], "doc_id long, quality int")
    model = quality.train(docs, labels)
    x = docs.selectExpr("*", "1 AS _w", "2 AS _t", "3 AS _lines", "4 AS x0", "5 AS score", "6 AS row", "7 AS y")
    got = sorted((r.row.doc_id, r.score) for r in quality.scored(x, model).collect())
    stat = np.array([statistics(r["text"]) for r in dicts()])
    z = model.bias + sum(r.weight * r.of(stat) for r in model.rules)
    want = sorted((r["doc_id"], 1 / (1 + math.exp(-max(-30, min(30, v))))) for r, v in zip(dicts(), np.broadcast_to(z, len(stat))))
    assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 1e-9 for g, w in zip(got, want))
    kept = quality.keep_good(x, labels)
    assert kept.columns == x.columns and {r.doc_id for r in kept.collect()} == {g[0] for g in got if g[1] >= quality.THRESHOLD}


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<double>")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    path = str(tmp_path / "t")
    token_output.write_token_files(none, path, token_output.tokenizer_file())
    for d in (pii.find(none), jaccard.groups(none), jaccard.keep_one(none), decontam.contamination(none, bench), decontam.clean_documents(none, bench), licenses.scan(none), mixing.mix(none), mixing.mixed_documents(none), quality.keep_good(none, labels), exact_dedup.cut(none, exact_dedup.removals(none)), ann.nearest(ann.build_index(vectors), vectors), chat.read_back(chat.format_windows(turns, token_output.tokenizer_file("byte_bpe_50k.json"))), token_output.read_token_files(spark, path)):
        assert d.count() == 0
