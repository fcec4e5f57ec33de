"""Operator 2, personal data by weak supervision. DataFrame functions only.

Patterns propose candidate spans; four labelers (a strict pattern check, gazetteers, context words before the span, and the
characters around it) vote yes, no or nothing on each. Votes are counted per pattern of votes over all
documents (a few hundred rows at most, whatever the input), expectation-maximisation estimates each labeler's reliability
from them, and a logistic span classifier is trained on the estimated labels and compiled into a Column. Candidates that
pass it are added to the base spans, which are found by fixed patterns and always stay.

Nulls: a null text is an empty one. Positions are code points, end exclusive. Candidates that overlap a base span, or an
added one that starts earlier, are not added. Repeated rows get equal results; an empty table gives an empty result;
extra columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import stage, table

KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "secret"]
LOCAL = "A-Za-z0-9._%+-"
#: The base patterns, written so that no start inside a run that was already tried is tried again (linear time).
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Further candidates: obfuscated mail addresses, phone numbers without a country code, account and insurance numbers, and
#: long runs with a digit that may be keys, tokens or passwords.
MORE = [
    ("email", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{2,63}+){1,4}+"),
    ("phone", r"(?<![0-9.+()-])(?<![+0-9() -][ -])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])(?![-.][0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("secret", r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]{0,80}[0-9])[A-Za-z0-9_+/-]{20,}+={0,2}+"),
]
# Gazetteers and context words.
DOMAINS = "com|org|net|edu|gov|io|info|de|fr|es|it|uk|eu|nl|ch|at|us|ca|au|jp|in|br|mx|pl|se|no|dk|fi"
CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-9][0-9]|3[578][0-9]|42[013]|[5689][0-9]{2}"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35"
BANKS = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK|TR"
INVALID = "078-05-1120|219-09-9999|457-55-5462"  # numbers that were published as examples
KEYS = "AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|pk_live_|rk_live_|xox[abprs]-|AIza|ya29|eyJ|npm_|hf_|SG-|dop_v1_"
FOR = r"(?i)\b(?:e-?mail|mail|contact|write|phone|tel|telephone|mobile|call|fax|card|visa|credit|ip|address|host|iban|account|konto|ssn|social security|name|reach|(?:[a-z0-9]+[_-])*(?:token|secret|key|apikey|passw(?:or)?d|pwd|credentials?|bearer|auth))\b"
AGAINST = r"(?i)\b(?:version|release|isbn|issn|order|invoice|item|part|model|section|figure|table|page)\b"


def _scan(arr: Column, state: Column, kind: str, step) -> Column:
    """What step(state, x) -> (state, array of items) gives along arr, as one array<kind>. Long arrays go in blocks of about
    the root of their length, as each appended item copies what stands before it."""
    none, nones = F.expr(f"CAST(array() AS array<{kind}>)"), F.expr(f"CAST(array() AS array<array<{kind}>>)")

    def one(acc: Column, x: Column) -> Column:
        st, items = step(acc["st"], x)
        return F.struct(st.alias("st"), F.concat(acc["a"], items).alias("a"))

    def over(a: Column, each: Column) -> Column:
        def block(acc: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(a, k * each + 1, each), F.struct(acc["st"].alias("st"), none.alias("a")), one)
            return _let(inner, lambda r: F.struct(r["st"].alias("st"), F.concat(acc["a"], F.array(r["a"])).alias("a")))

        short = F.aggregate(a, F.struct(state.alias("st"), none.alias("a")), one, lambda acc: acc["a"])
        long = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / each).cast("int")), F.struct(state.alias("st"), nones.alias("a")), block, lambda acc: F.flatten(acc["a"]))
        return F.when(F.size(a) <= 64, short).otherwise(long)

    return _let(arr, lambda a: _let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a))).cast("int")), lambda each: over(a, each)))


def _let(x: Column, of) -> Column:
    """of(x) with x worked out once."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


MATCHES = "struct<s:int,e:int,m:string,ahead:string,next:string>"


def _positions(text: Column, pattern: str) -> Column:
    """Array of a pattern's matches: start, end, match, up to 32 characters before it (and after the match before), and the
    character behind it. The text is only cut where there are any, and never searched for a position again."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cut = F.split(text, pattern, -1)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + F.length(x["gap"])
        e = s + F.length(x["m"])
        ahead = F.substring(x["gap"], F.greatest(F.length(x["gap"]) - 31, F.lit(1)), F.lit(32))
        return e, F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), ahead.alias("ahead"), F.substring(x["behind"], F.lit(1), F.lit(1)).alias("next")))

    n = F.size(found)
    pairs = F.arrays_zip(found.alias("m"), F.slice(cut, F.lit(1), n).alias("gap"), F.slice(cut, F.lit(2), n).alias("behind"))
    return F.when(n > 0, _scan(pairs, F.lit(0), MATCHES, step)).otherwise(F.expr(f"CAST(array() AS array<{MATCHES}>)"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def value(i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, F.lit(2)).otherwise(F.lit(1))
        return F.when(v > 9, v - 9).otherwise(v)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i))
    return F.when(n.between(16, 19), total % 10 == 0).otherwise(F.lit(False))


def _strict(kind: str, m: Column, base: bool) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"\A{PART}(?:\.{PART}){{3}}\z")
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15) if base else ~_digits(m).rlike(r"\A([0-9])\1*\z")
    if kind == "ssn":
        return ~m.rlike(r"\A(?:000|666|9[0-9]{2})|-00-|-0000\z")
    if kind == "secret":  # letters and digits mixed, and not one run of each
        return m.rlike(r"[0-9][A-Za-z_+/-]+[0-9]") & m.rlike(r"[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= 8)
    return F.length(F.regexp_replace(m, " ", "")).between(15, 34)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        return m.rlike(rf"(?i)\b(?:{DOMAINS})\z")
    if kind == "ip":
        return ~m.rlike(r"\A(?:0|10|127|224|239|255)\.|\A192\.168\.|\A172\.(?:1[6-9]|2[0-9]|3[01])\.")
    if kind == "card":
        return _digits(m).rlike(rf"\A(?:{ISSUERS})")
    if kind == "phone":
        return m.rlike(rf"\A\+(?:{CALLING})|\A\(?[2-9][0-9]{{2}}\)?[-. ]+[2-9]")
    if kind == "iban":
        return m.rlike(rf"\A(?:{BANKS})")
    if kind == "secret":
        return m.rlike(rf"\A(?:{KEYS})|\A(?:[0-9a-f]{{32}}|[0-9a-f]{{40}}|[0-9a-f]{{64}})\z")
    return ~m.rlike(rf"\A(?:{INVALID})\z")


def candidates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, c: array of candidates (kind as index of KINDS, s, e, base, open, strict, gazetteer,
    context, edge, long). base: a base span; open: of a further pattern, so that the classifier may add it. Matches of a base
    pattern that fail its check are neither: they vote, and are dropped."""
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    t = F.col("t")
    base = [("email", EMAIL, F.contains(t, F.lit("@"))), ("ip", IP, F.lit(True)), ("card", CARD, F.lit(True)), ("phone", PHONE, F.contains(t, F.lit("+")))]
    every = [(k, p, True, g) for k, p, g in base] + [(k, p, False, None) for k, p in MORE]
    vote = lambda yes: F.when(yes, F.lit(1)).otherwise(F.lit(-1))
    def labeler(kind: str, is_base: bool):
        def label(x: Column) -> Column:
            around = F.concat(F.right(x["ahead"], F.lit(1)), F.lit(" "), x["next"])
            context = F.when(x["ahead"].rlike(AGAINST), F.lit(-1)).when(x["ahead"].rlike(FOR), F.lit(1)).otherwise(F.lit(0))
            strict = _strict(kind, x["m"], is_base)
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), (F.lit(is_base) & strict).alias("base"), F.lit(not is_base).alias("open"), vote(strict).alias("strict"), vote(_gazetteer(kind, x["m"])).alias("gazetteer"), context.alias("context"), vote(~around.rlike(r"[\p{L}\p{N}_]")).alias("edge"), F.least(F.length(x["m"]) / 8, F.lit(3)).cast("int").alias("long"))

        return label

    names = []
    for i, (kind, pattern, is_base, guard) in enumerate(every):
        at = _positions(t, pattern)
        if guard is not None and is_base:
            at = F.when(guard, at).otherwise(F.expr(f"CAST(array() AS array<{MATCHES}>)"))
        d = d.withColumn(f"_p{i}", at)
        names.append((f"_p{i}", labeler(kind, is_base)))
    return d.select("doc_id", F.concat(*[F.transform(n, f) for n, f in names]).alias("c"))


#: The labelers, and how often each is held to be right before any vote is counted.
VOTES = {"strict": 0.95, "gazetteer": 0.8, "context": 0.8, "edge": 0.7}


def reliabilities(patterns: list[tuple], rounds: int = 50, belief: float = 0.5) -> dict[tuple, float]:
    """P(personal) of each vote pattern (kind, votes..., long, count) by expectation-maximisation over the labelers.

    Every labeler has a probability of each vote in either class, shared by all kinds; every kind has its own prior. The
    beliefs of VOTES weigh as much as ``belief`` of the counted votes, so that a corpus full of one pattern cannot turn
    the classes round; priors are smoothed by one.
    """
    m, right = len(VOTES), list(VOTES.values())
    before = [[{1: 0.8 * (r if c else 1 - r), -1: 0.8 * (1 - r if c else r), 0: 0.2} for r in right] for c in (0, 1)]
    like, weight = before, belief * sum(p[-1] for p in patterns)
    prior = {p[0]: 0.5 for p in patterns}
    post: dict[tuple, float] = {}
    for _ in range(rounds):
        for p in patterns:
            a, b = math.log(1 - prior[p[0]]), math.log(prior[p[0]])
            for j in range(m):
                a, b = a + math.log(like[0][j][p[1 + j]]), b + math.log(like[1][j][p[1 + j]])
            post[p[:-1]] = 1 / (1 + math.exp(max(-50, min(50, a - b))))
        for k in prior:
            own = [p for p in patterns if p[0] == k]
            prior[k] = (1 + sum(p[-1] * post[p[:-1]] for p in own)) / (2 + sum(p[-1] for p in own))
        like = []
        for c in (0, 1):
            of_class = []
            for j in range(m):
                mass = {v: 0.01 + weight * before[c][j][v] for v in (-1, 0, 1)}
                for p in patterns:
                    mass[p[1 + j]] += p[-1] * (post[p[:-1]] if c else 1 - post[p[:-1]])
                of_class.append({v: x / sum(mass.values()) for v, x in mass.items()})
            like.append(of_class)
    return post


def _features(p: tuple) -> list[str]:
    return [f"kind={p[0]}", *[f"{n}={v}" for n, v in zip(VOTES, p[1:5])], f"long={p[5]}"]


def span_classifier(patterns: list[tuple], post: dict[tuple, float], steps: int = 600) -> tuple[float, dict[str, float]]:
    """Bias and weights of a ridge logistic regression on the estimated labels."""
    w: dict[str, float] = {}
    bias, total = 0.0, sum(p[-1] for p in patterns) or 1
    for _ in range(steps):
        g: dict[str, float] = {}
        gb = 0.0
        for p in patterns:
            z = bias + sum(w.get(f, 0.0) for f in _features(p))
            r = p[-1] / total * (post[p[:-1]] - 1 / (1 + math.exp(-max(-30, min(30, z)))))
            gb += r
            for f in _features(p):
                g[f] = g.get(f, 0.0) + r
        bias += 2.0 * gb
        for f, v in g.items():
            w[f] = w.get(f, 0.0) + 2.0 * (v - 1e-4 * w.get(f, 0.0))
    return bias, w


def find(docs: DataFrame, sure: float = 0.9) -> DataFrame:
    """Per row of docs: doc_id, base and spans, arrays of (kind, s, e) ordered by kind and start. sure: what an added span must score."""
    c = stage(candidates(docs), "pii-candidates")
    # a pattern counts once a document, however often it stands there
    seen = F.array_distinct(F.transform("c", lambda x: F.struct(x["kind"].alias("kind"), *[x[v].alias(v) for v in VOTES], x["long"].alias("long"))))
    x = c.select(F.explode(seen).alias("x")).select("x.*").groupBy("kind", *VOTES, "long").agg(F.count("*").alias("n"))
    patterns = sorted(tuple(r) for r in x.collect())  # at most 7 kinds x 3^4 votes x 4 lengths
    bias, w = span_classifier(patterns, reliabilities(patterns))

    def score(x: Column) -> Column:
        z = F.lit(bias)
        for f, v in sorted(w.items()):
            name, _, value = f.partition("=")
            z = z + F.when(x[name] == int(value), F.lit(v)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))

    span = "struct<kind:int,s:int,e:int>"
    mark = "struct<s:int,o:int,kind:int,e:int>"
    plain = lambda a: F.transform(a, lambda x: F.struct(x["kind"], x["s"], x["e"]))
    marked = lambda a, o: F.transform(a, lambda x: F.struct(x["s"].alias("s"), F.lit(o).alias("o"), x["kind"].alias("kind"), x["e"].alias("e")))
    c = c.withColumn("base", F.array_sort(plain(F.filter("c", lambda x: x["base"]))))
    c = c.withColumn("more", F.filter("c", lambda x: x["open"] & (score(x) >= sure)))
    # candidates that overlap no base span: seen from the left by the base's largest end, from the right by its next start
    both = F.array_sort(F.concat(marked(F.col("base"), 0), marked(F.col("more"), 1)))
    if_ = lambda yes, x, kind: F.when(yes, F.array(x)).otherwise(F.expr(f"CAST(array() AS array<{kind}>)"))
    is_base = lambda x: x["o"] == 0
    left = _scan(both, F.lit(0), mark, lambda st, x: (F.when(is_base(x), F.greatest(st, x["e"])).otherwise(st), if_(is_base(x) | (st <= x["s"]), x, mark)))
    c = c.withColumn("free", F.when(F.size("more") > 0, F.reverse(left)))
    c = c.withColumn("free", _scan(F.col("free"), F.lit(2**31 - 1), mark, lambda st, x: (F.when(is_base(x), x["s"]).otherwise(st), if_(~is_base(x) & (st >= x["e"]), x, mark))))
    one = _scan(F.array_sort("free"), F.lit(0), span, lambda st, x: (F.when(st <= x["s"], x["e"]).otherwise(st), if_(st <= x["s"], F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")), span)))
    return c.select("doc_id", "base", F.when(F.size("more") > 0, F.array_sort(F.concat("base", one))).otherwise(F.col("base")).alias("spans"))


def joined(spans: str) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find(table(spark, sf_dir, "documents"))
    of = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return d.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
