"""Inputs on which operators once did less than the whole job, against plain Python."""

import math
from collections import Counter

from seqslice.llm import decontam, jaccard, licenses

from . import brute as B

DOCS = "doc_id long, text string, source string, extra string"
NOTICE = {k: next(t for x, t, _ in licenses.TEMPLATES if x == k) for k in ("apache-2.0", "mit", "bsd")}


def licence_scan(texts, least=0.6):
    """(labels of templates, score of templates) per text: every template at every offset."""
    docs = [B.plain(t) for t in texts]
    df = lambda w: sum(w in d for d in docs)
    idf = {w: math.log((len(docs) + 1) / (df(w) + 0.5)) for _, t, _ in licenses.TEMPLATES for w in t.split()}
    out = []
    for d in docs:
        found, top = set(), 0.0
        for label, t, keys in licenses.TEMPLATES:
            ws = t.split()
            if all(f" {k} " in f" {' '.join(d)} " for k in keys):
                total = sum(idf[w] for w in set(ws))
                at = lambda o: {w for p, w in enumerate(ws) if 0 <= o + p < len(d) and d[o + p] == w}
                best = max(sum(idf[w] for w in at(o)) / total for o in range(-len(ws), len(d)))
                if best >= least:
                    found.add(label)
                    top = max(top, best)
        out.append((sorted(found), min(1.0, top)))
    return out


def scanned(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    want = licence_scan(texts)
    assert [r.found for r in rows] == [w[0] for w in want]
    assert all(r.base or abs(r.score - w[1]) < 1e-6 for r, w in zip(rows, want))
    return [r.found for r in rows]


def test_common_licences(spark):
    """A notice is found whatever share of the rows has it."""
    many = [(label, f"a{i} {text} b") for i in range(20) for label, text in NOTICE.items()]
    for rows in (many, [("mit", f"a{i} {NOTICE['mit']} b") for i in range(2)]):
        assert scanned(spark, [t for _, t in rows]) == [[label] for label, _ in rows]


def test_several_licences(spark):
    """All notices of a text are found, however many others stand in it; a cut notice is scored like the brute force."""
    texts = [" then ".join(NOTICE[k] for k in ks) for ks in (("mit", "bsd"), ("apache-2.0", "mit"), ("bsd", "apache-2.0", "mit"))]
    every = " and ".join(t for _, t, _ in licenses.TEMPLATES)
    cut = NOTICE["mit"].split(" obtaining")[0]
    got = scanned(spark, [*texts, every, cut, None, "the work " * 500 + NOTICE["bsd"]])
    assert got[:3] == [["bsd", "mit"], ["apache-2.0", "mit"], ["apache-2.0", "bsd", "mit"]]
    assert got[3] == sorted({x for x, _, _ in licenses.TEMPLATES}) and got[6] == ["bsd"]


def kept_rows(rows):
    """Of rows (doc_id, text, ...): for each group of linked rows, the set of (doc_id, text) of which one may stay; and the unlinked ones."""
    at = {i: r for i, r in enumerate(rows)}
    groups, alone = {}, []
    for i, n, root in B.op6([dict(doc_id=i, text=r[1]) for i, r in at.items()]):
        if n:
            groups.setdefault(root, []).append(at[i][:2])
        else:
            alone.append(at[i][:2])
    least = lambda g: min((d is None, d or 0) for d, _ in g)
    return [{x for x in g if (x[0] is None, x[0] or 0) == least(g)} for g in groups.values()], alone


def held_against(got, rows):
    """got: the (doc_id, text) that keep_one left of rows."""
    groups, alone = kept_rows(rows)
    assert Counter(x for x in got if not B.space(x[1])) == Counter(alone)
    got = [x for x in got if B.space(x[1])]
    assert len(got) == len(groups)
    assert all(sum(x in g for x in got) == 1 for g in groups)


def copies():
    """Rows of DOCS: linked and unlinked texts under null, repeated and own doc_ids, empty texts and repeated rows."""
    long = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    x = [(None, long("a")), (None, long("b")), (None, long("b") + " end"), (None, ""), (None, None), (None, None), (1, long("c")), (1, long("d")), (1, ""), (1, None)]
    x += [(2, long("d") + " end"), (0, long("e")), (2, long("e") + " end"), (2, long("f")), (3, long("f")), (3, long("f")), (None, long("f")), (4, long("g")), (4, long("g"))]
    x += [(5, long("h")), (5, long("h") + " end"), (6, " \n"), (7, "one two"), (8, "One two")]
    return [(*r, ("zz", None, "yy")[i % 3], "x") for i, r in enumerate(x)]


def test_keep_one(spark):
    """Rows go only with their own group, whatever doc_ids they share."""
    got = [(r.doc_id, r.text) for r in jaccard.keep_one(spark.createDataFrame(copies(), DOCS)).collect()]
    held_against(got, copies())


def test_clean_documents(spark):
    """The rows that stay are those that the brute force calls clean, whatever doc_ids they share."""
    items = [dict(item_id=1, text=copies()[1][1]), dict(item_id=2, text="one two"), dict(item_id=3, text=None)]
    bench = spark.createDataFrame([(b["item_id"], b["text"]) for b in items], "item_id long, text string")
    bad = [r[-1] for r in B.op7([dict(doc_id=r[0], text=r[1]) for r in copies()], items)]
    got = decontam.clean_documents(spark.createDataFrame(copies(), DOCS), bench).collect()
    assert any(bad) and Counter(tuple(r) for r in got) == Counter(r for r, b in zip(copies(), bad) if not b)


def test_pii_spans(spark):
    """All base spans stay, added ones overlap nothing, and every planted token is found, in long texts as well."""
    import re

    from seqslice.llm import pii

    x = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    many = " ".join(f"a{i}@b.com, token = {'a1f3c2e7b9d4' * 2}{i:08x}" for i in range(5000))
    x += [(-1, many), (-2, None), (-3, ""), (-4, "078-05-1120 mail (555) 123-4567x"), (-5, "token = a1b2c3@d4e5f6.com0123456789abcdef0123")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(x, "doc_id long, text string")).collect()}
    found = 0
    for i, t in x:
        base, spans = [tuple(v) for v in got[i].base], [tuple(v) for v in got[i].spans]
        assert [(pii.KINDS[k], s, e) for k, s, e in base] == sorted(B.op2_base(t), key=lambda v: (pii.KINDS.index(v[0]), v[1]))
        assert set(base) <= set(spans) and spans == sorted(spans)
        more = sorted(set(spans) - set(base), key=lambda v: v[1])
        assert all(a[2] <= b[1] for a, b in zip(more, more[1:]))
        assert i == -1 or not any(a[1] < b[2] and b[1] < a[2] for a in more for b in base)
        if i > 0:
            tokens = [(6, m.start(1), m.end(1)) for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")]
            found += len(tokens)
            assert set(tokens) <= set(spans)
    assert found > 5 and sum(k == 0 for k, _, _ in got[-1].base) == 5000 and sum(k == 6 for k, _, _ in got[-1].spans) == 5000


def test_reliabilities():
    """Expectation-maximisation tells labelers of different reliability apart, and the classifier follows it."""
    import random

    from seqslice.llm import pii

    r, rows, truth = random.Random(2), Counter(), {}
    right = (0.95, 0.9, 0.7, 0.55)
    for _ in range(20000):
        y = r.random() < 0.3
        votes = tuple((1 if (r.random() < q) == y else -1) for q in right)
        rows[(0, *votes, 1)] += 1
        truth.setdefault((0, *votes, 1), []).append(y)
    patterns = [(*k, n) for k, n in sorted(rows.items())]
    post = pii.reliabilities(patterns)
    share = {k: sum(v) / len(v) for k, v in truth.items()}
    assert sum(abs(post[k] - share[k]) * len(v) for k, v in truth.items()) / 20000 < 0.05
    bias, w = pii.span_classifier(patterns, post)
    score = {k: 1 / (1 + math.exp(-bias - sum(w[f] for f in pii._features(k)))) for k in post}
    assert sum((score[k] > 0.5) == y for k, v in truth.items() for y in v) > 0.93 * 20000
