"""Suffix arrays and repeated windows against plain sorting and counting."""

import random

import numpy as np

from seqslice.llm import suffixes as m


def test_suffix_array():
    r = random.Random(3)
    for _ in range(600):
        k, n = r.choice([1, 2, 3, 10]), r.randint(1, 60)
        t = np.array([r.randint(1, k) for _ in range(n)] + [0], np.int64)
        assert m.suffix_array(t, 10**6, r.choice([0, 2, 1000])).tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())


def test_repeated():
    r = random.Random(4)
    for _ in range(600):
        k, n, need = r.choice([1, 2, 3]), r.randint(1, 80), r.choice([2, 3, 5, 8])
        t = np.array([r.choice([0, *[x for x in range(1, k + 1) for _ in range(4)]]) for _ in range(n)], np.int64)
        seen: dict = {}
        for i in range(n - need + 1):
            if (w := tuple(t[i : i + need])) and 0 not in w:
                seen.setdefault(w, []).append(i)
        want = np.zeros(n, bool)
        for v in seen.values():
            if len(v) > 1:
                want[v] = True
        assert (m.repeated(t, need) == want).all()
