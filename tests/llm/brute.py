"""Plain Python versions of the operators' contracts, from rows as lists of dicts."""

import hashlib
import re
import zlib

sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
plain = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s or ""))
space = lambda s: re.findall(r"[^\x20\x09-\x0D]+", s or "")


def op1(docs, path):
    from tokenizers import Tokenizer

    t, at, out = Tokenizer.from_file(path), 0, []
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = t.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        b = b"".join(i.to_bytes(4, "little") for i in ids)
        out.append((d["doc_id"], at, len(ids), zlib.crc32(b)))
        at += len(ids)
    return out


def op2_base(text):
    text, out = text or "", []
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(s[::-1])) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    ]
    for k, p, ok in kinds:
        out += [(k, m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])]
    return out


def op2(docs):
    out = []
    for d in docs:
        b = op2_base(d["text"])
        out.append((d["doc_id"], *(sum(x[0] == k for x in b) for k in ("email", "ip", "card", "phone")), sha(",".join(f"{k}:{s}:{e}" for k, s, e in b))))
    return out


def op3(docs, n=400):
    from collections import Counter

    texts = [(d["text"] or "").encode() for d in docs]
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for d, t in zip(docs, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append((d["doc_id"], len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(c for c, g in zip(t, gone) if not g))))
    return out


def op5_targets(docs, weights=(5, 2, 1)):
    size = {}
    for d in docs:
        size[d["source"]] = size.get(d["source"], 0) + len(space(d["text"]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(size.values()), set(names), {}
    while free:
        lam = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * lam > 2 * size[s]}
        if not over:
            target.update({s: w[s] * lam for s in free})
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
    return size, target


def shingles(text, n=5):
    w = space(low(text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def op6(docs):
    sets = [shingles(d["text"]) for d in docs]
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                m = len(a & b)
                if 100 * m >= 75 * (len(a) + len(b) - m):
                    x, y = find(i), find(j)
                    up[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(docs):
        r = find(i)
        least[r] = min(least.get(r, d["doc_id"]), d["doc_id"])
    return [(d["doc_id"], len(s), least[find(i)]) for i, (d, s) in enumerate(zip(docs, sets))]


def op7(docs, bench, n=13):
    wins = {}
    for b in bench:
        w = plain(b["text"])
        k = min(n, len(w))
        for i in range(len(w) - k + 1) if w else ():
            wins.setdefault(tuple(w[i : i + k]), set()).add(b["item_id"])
    lens, out = {len(x) for x in wins}, []
    for d in docs:
        w = plain(d["text"])
        hit, items = [0] * len(w), set()
        for k in lens:
            for i in range(len(w) - k + 1):
                if f := wins.get(tuple(w[i : i + k])):
                    items |= f
                    hit[i : i + k] = [1] * k
        ids = sorted(str(i) for i in items if i is not None)
        out.append((d["doc_id"], len(w), sum(hit), len(ids), sha(",".join(ids)), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


def op8(rows):
    out, convs = [], {}
    for r in rows:
        convs.setdefault(r["conv_id"], []).append(r)
    for c, t in convs.items():
        t.sort(key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
        loss = "".join(r["text"] or "" for r in t if r["role"] == "assistant")
        out.append((c, len(t), sha("".join(f"{r['role'] or ''}\n{r['text'] or ''}\n" for r in t)), len(loss), sha(loss)))
    return out


def op9(docs):
    out = []
    for d in docs:
        w, at, labels = plain(d["text"]), [], set()
        for p, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
            q = p.split()
            f = [i for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
            at += f
            labels |= {label} if f else set()
        out.append((d["doc_id"], len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    return out
