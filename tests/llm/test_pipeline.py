"""Every stage of the corpus pipeline against plain Python on its own input, and run() against its stages."""

import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from seqslice.llm import quality, token_output  # noqa: E402

from . import brute as B  # noqa: E402
from .test_operators import statistics  # noqa: E402
from .test_whole import held_against  # noqa: E402

COLS = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, score double, hash long"


def rows():
    own = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()[:150]]
    bench = pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist()[0]["text"]
    long = " ".join(f"word{i % 50} and{i}" for i in range(400))
    odd = [(None, None), (None, long), (None, long + " end"), (7, own[10][1]), (7, bench), (7, ""), (8, " \n"), (8, long + " more"), (9, own[20][1]), (9, own[20][1])]
    return [(*r, "a", 1, 0.5, 2) for r in own + [(i, t, None, None if k % 2 else "zz", None if t is None else len(t)) for k, (i, t) in enumerate(odd)]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), COLS).write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    return d


def good(spark, docs, d):
    """Rows that the trained rules keep, the rules worked out in Python."""
    import numpy as np

    m = quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    x = docs.collect()
    stat = np.array([statistics(r.text) for r in x])
    z = m.bias + sum(r.weight * r.of(stat) for r in m.rules)
    return [r for r, v in zip(x, z) if 1 / (1 + np.exp(-np.clip(v, -30, 30))) >= quality.THRESHOLD]


def test_stages(spark, folder):
    docs, inputs = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        out = stage(spark, docs, folder)
        path = f"{folder}/{name}.parquet"
        out.write.parquet(path)
        assert name == "token-ID output" or out.columns == docs.columns
        docs = spark.read.parquet(path)
    inputs.append(docs)
    first, kept, clean, mixed, drawn, tokens = inputs
    count = lambda x: Counter(map(tuple, x if isinstance(x, list) else x.collect()))
    assert count(kept) == count(good(spark, first, folder)) and 100 < kept.count() < first.count()
    held_against([(r.doc_id, r.text) for r in clean.collect()], [tuple(r) for r in kept.collect()])
    assert clean.count() < kept.count() and not count(clean) - count(kept)
    bench = [r.asDict() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    x = clean.collect()
    bad = [r[-1] for r in B.op7([r.asDict() for r in x], bench)]
    assert any(bad) and count(mixed) == count([r for r, b in zip(x, bad) if not b])
    x = [r.asDict() for r in mixed.collect()]
    _, target = B.op5_targets(x)
    words, texts = Counter(), {}
    for r in x:
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    for r in drawn.collect():
        words[r.source] += len(B.space(r.text))
        assert any(t.startswith(r.text) for t in texts[r.doc_id]) and r.n_chars == len(r.text)
    assert all(abs(words[s] - t) <= 1 for s, t in target.items())
    # the token files stand in the order of the mix's files
    from tokenizers import Tokenizer

    tok, at, want = Tokenizer.from_file(token_output.tokenizer_file()), 0, []
    for r in drawn.orderBy("_metadata.file_name", "_metadata.row_index").collect():
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    assert sorted(((r.doc_id is None, r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.collect()), key=lambda r: r[2]) == [(w[0] is None, *w) for w in want]


def test_run(spark, folder):
    a, b = (sorted((r.n_tokens, r.ids_crc32, str(r.doc_id)) for r in corpus_pipeline.run(spark, folder).collect()) for _ in range(2))
    assert a == b == sorted((r.n_tokens, r.ids_crc32, str(r.doc_id)) for r in spark.read.parquet(f"{folder}/token-ID output.parquet").collect())


def test_empty_run(spark, tmp_path):
    d = str(tmp_path)
    for t, cols in (("documents", COLS), ("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], cols).write.parquet(f"{d}/{t}.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
