"""The SQL that gives the engine's queries' rows in DuckDB."""

from __future__ import annotations

_BASE = """WITH RECURSIVE ev AS (
  SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS t,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord FROM events),
st AS (SELECT *, user_id * 22 + t * 4 + k % 4 AS u FROM ev),
nx AS (SELECT *, lead(u) OVER (PARTITION BY user_id ORDER BY ord) AS nxt FROM st),
cfg AS MATERIALIZED (SELECT DISTINCT user_id AS m, u AS src, coalesce(nxt, user_id * 22 + 21) AS dst FROM nx UNION SELECT DISTINCT user_id, user_id * 22 + 20, u FROM nx WHERE ord = 1),
un AS MATERIALIZED (SELECT DISTINCT u, user_id AS m, t IN (0, 2) AS c FROM st UNION SELECT DISTINCT user_id * 22 + 20, user_id, false FROM st UNION SELECT DISTINCT user_id * 22 + 21, user_id, false FROM st),
ca AS MATERIALIZED (SELECT DISTINCT u AS n, k AS callee, user_id AS m FROM st WHERE t = 0 AND k IN (SELECT user_id FROM st)),
mg AS (SELECT DISTINCT m AS src, callee AS dst FROM ca),
l0 AS (SELECT *, user_id // 2 AS m, (user_id // 2) * 1000 + ord * 10 + t AS n FROM ev WHERE ord <= 8),
l1 AS (SELECT *, lead(n) OVER (PARTITION BY user_id ORDER BY ord) AS nxt FROM l0),
lay AS (SELECT DISTINCT m, n AS src, coalesce(nxt, m * 1000 + 999) AS dst FROM l1 UNION SELECT DISTINCT m, m * 1000, n FROM l1 WHERE ord = 1)
"""
_CLOSURE = ", cl(src, dst) AS (SELECT src, dst FROM mg UNION SELECT cl.src, mg.dst FROM cl JOIN mg ON cl.dst = mg.src)"
_SCC = _CLOSURE + """, nd AS (SELECT src AS n FROM mg UNION SELECT dst FROM mg),
same AS (SELECT a.src AS x, a.dst AS y FROM cl a JOIN cl b ON a.src = b.dst AND a.dst = b.src),
sc AS (SELECT n, greatest(n, coalesce((SELECT max(y) FROM same WHERE x = n), n)) AS root FROM nd)"""


def _dominator_sql(edges: str, a: str, b: str) -> str:
    """d dominates n if n is out of reach from the method's heads once d is taken away."""
    return f""", g AS (SELECT DISTINCT m, {a} AS src, {b} AS dst FROM {edges}),
gn AS (SELECT m, src AS n FROM g UNION SELECT m, dst FROM g),
hd AS (SELECT m, n FROM gn WHERE n NOT IN (SELECT dst FROM g)),
wo(m, d, n) AS (SELECT hd.m, x.n, hd.n FROM hd JOIN gn x ON x.m = hd.m WHERE x.n <> hd.n UNION SELECT wo.m, wo.d, g.dst FROM wo JOIN g ON g.src = wo.n WHERE g.dst <> wo.d),
rc(m, n) AS (SELECT m, n FROM hd UNION SELECT g.m, g.dst FROM rc JOIN g ON g.src = rc.n),
dom AS (SELECT r.m, r.n, x.n AS d FROM rc r JOIN gn x ON x.m = r.m WHERE NOT EXISTS (SELECT 1 FROM wo WHERE wo.m = r.m AND wo.d = x.n AND wo.n = r.n))"""


_LOOP = _dominator_sql("cfg", "src", "dst") + """, bk AS (SELECT g.m, g.src, g.dst FROM g JOIN dom ON dom.n = g.src AND dom.d = g.dst),
lp(m, h, n) AS (SELECT m, dst, src FROM bk UNION SELECT lp.m, lp.h, g.src FROM lp JOIN g ON g.dst = lp.n WHERE lp.n <> lp.h),
lb AS (SELECT m, h, n FROM lp UNION SELECT m, dst, dst FROM bk)"""
_EXIT = _LOOP + """, px AS (SELECT DISTINCT lb.m, lb.h, g.dst AS x FROM lb JOIN g ON g.src = lb.n WHERE NOT EXISTS (SELECT 1 FROM lb o WHERE o.h = lb.h AND o.n = g.dst)),
pd AS (SELECT px.*, dom.d IS NOT NULL AS up FROM px LEFT JOIN dom ON dom.n = px.h AND dom.d = px.x),
ex(m, h, x, up) AS (SELECT m, h, x, up FROM pd UNION SELECT ex.m, ex.h, p.x, EXISTS (SELECT 1 FROM dom WHERE dom.n = p.h AND dom.d = p.x) FROM ex JOIN pd p ON p.h = ex.x WHERE ex.up),
le AS (SELECT DISTINCT m, h, x FROM ex WHERE NOT up)"""
_SEQ = """, sq AS (SELECT user_id, (ord - 1) // 4 AS part, list(CAST(t AS BIGINT) ORDER BY ord) AS seq FROM ev GROUP BY ALL)"""
_CRIT = """, pu AS (SELECT user_id, min(u) AS lo, max(u) AS hi FROM st WHERE t = 2 GROUP BY user_id), mp AS (SELECT lo, hi FROM pu WHERE user_id = 0),
cr AS (SELECT DISTINCT h, lo AS tail FROM (SELECT pu.lo AS h, mp.lo FROM pu, mp WHERE pu.user_id IN (SELECT callee FROM ca WHERE m = 0) UNION SELECT hi, lo FROM mp) WHERE h <> lo)"""


#: The program of sources/program.py: classes, followed calls, units, methods, points-to rows.
_PROG = _BASE + """,
cls(class_id, name, package, is_interface, is_library) AS (SELECT i, 'pkg' || i || '.C' || i, 'pkg' || i, i = 6, i >= 5 FROM range(7) t(i) UNION ALL SELECT -1, 'lang.Api', 'lang', false, true),
sup(c, p) AS (SELECT CAST(c AS BIGINT), CAST(p AS BIGINT) FROM (VALUES (1, 0), (2, 0), (3, 1), (4, 1), (5, 2)) t(c, p)),
imp(c, i) AS (SELECT CAST(c AS BIGINT), CAST(6 AS BIGINT) FROM (VALUES (1), (4)) t(c)),
kc AS (SELECT n AS call_unit, callee AS callee_id, CASE WHEN callee % 13 = 7 THEN 'finalize' WHEN callee % 10 = 3 THEN 'thread' WHEN callee % 10 = 9 THEN 'finalize' WHEN m % 5 = 4 THEN 'reflective_method' ELSE 'explicit' END AS kind FROM ca
  UNION SELECT u, k, 'clinit' FROM st WHERE t = 3 AND k % 13 = 7 AND k IN (SELECT user_id FROM st)),
fc AS MATERIALIZED (SELECT DISTINCT call_unit, callee_id FROM kc WHERE kind <> 'finalize'),
lc AS (SELECT n, min(callee) AS lo FROM ca GROUP BY n),
u0 AS (SELECT un.u, un.m, un.c, un.u % 22 AS o, CASE WHEN un.u % 22 < 20 THEN un.u % 22 // 4 END AS t, un.u % 22 % 4 AS j, lo FROM un LEFT JOIN lc ON lc.n = un.u),
u1 AS (SELECT *, CASE WHEN t = 0 AND m % 5 = 4 THEN -3 WHEN t = 0 AND m % 5 = 3 THEN -2 WHEN t = 0 THEN coalesce(lo, -9) WHEN t = 2 AND j < 2 THEN -100 - m % 5
  WHEN t = 2 AND j = 2 THEN CASE m % 6 WHEN 0 THEN -1 WHEN 1 THEN -4 ELSE -9 END WHEN t = 2 THEN CASE WHEN m % 2 = 0 THEN -2 ELSE -3 END END AS decl FROM u0),
uu AS MATERIALIZED (SELECT u AS unit_id, m AS method_id, o AS ord, CASE WHEN o >= 20 THEN -1 ELSE o END AS line, CASE WHEN o >= 20 THEN -1 ELSE o + j END AS end_line, c AS is_call,
  CASE WHEN t = 0 THEN ['static', 'virtual', 'interface', 'special'][j + 1] WHEN t = 2 THEN CASE WHEN j = 2 THEN 'static' ELSE 'special' END END AS invoke_kind, decl,
  CASE WHEN (t = 0 AND j > 0) OR (t = 2 AND j < 2) THEN m * 4 + j WHEN t = 2 AND j = 3 THEN m * 4 + 2 END AS base_local,
  CASE WHEN t = 3 THEN m * 4 + j WHEN decl = -2 AND (t = 0 OR j = 3) THEN m * 4 + 3 END AS assigned, CASE WHEN decl = -3 THEN m * 4 + 1 END AS first_arg,
  coalesce(t = 1 AND j = 0, false) AS is_catch, coalesce(t = 1 AND j = 3, false) AS is_nop, CASE WHEN t = 3 THEN m % 5 END AS new_class FROM u1),
mm AS MATERIALIZED (SELECT user_id AS method_id, user_id % 7 AS class_id, CASE WHEN user_id = 0 THEN 'main' WHEN user_id % 13 = 7 THEN '<clinit>' WHEN user_id % 11 = 5 THEN '<init>' ELSE 'm' || (user_id % 3) END AS name,
    'M' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS signature, user_id % 4 = 0 OR user_id % 13 = 7 AS is_static, user_id % 11 = 5 AND user_id % 13 <> 7 AS is_constructor, true AS has_body FROM (SELECT DISTINCT user_id FROM ev)
  UNION ALL SELECT i, -1, n, n, false, false, false FROM (VALUES (-1, 'forName'), (-2, 'newInstance'), (-3, 'invoke'), (-4, 'class$'), (-9, 'put')) t(i, n)
  UNION ALL SELECT -100 - i, i, '<init>', 'init' || i, false, true, false FROM range(7) t(i)),
si AS MATERIALIZED (SELECT uu.*, mm.class_id, c.name AS class_name, mm.name AS method_name, mm.signature, d.class_id AS decl_class, d.is_constructor AS decl_cons, dc.name AS callee_class, dc.is_interface AS decl_iface, d.name AS callee_name
  FROM uu JOIN mm ON mm.method_id = uu.method_id JOIN cls c ON c.class_id = mm.class_id LEFT JOIN mm d ON d.method_id = uu.decl LEFT JOIN cls dc ON dc.class_id = d.class_id),
ct AS (SELECT *, class_name || '.' || method_name || '/' || callee_class || '.' || callee_name || '/' || line AS call FROM si WHERE is_call),
bo AS (SELECT min(u) AS a, max(u) AS b FROM un WHERE c AND u % 22 BETWEEN 8 AND 11 GROUP BY m HAVING min(u) <> max(u)),
fg AS (SELECT DISTINCT un.m AS src, fc.callee_id AS dst FROM fc JOIN un ON un.u = fc.call_unit),
rm(n) AS (SELECT CAST(0 AS BIGINT) UNION SELECT dst FROM rm JOIN fg ON fg.src = rm.n),
cx AS (SELECT m, src, dst, dst % 22 = 4 AS exc FROM cfg)"""
_RESOLVE = """, rs AS (SELECT spec, arg_min(unit_id, method_id * 1000 + ord) AS unit_id FROM (
  SELECT sp.spec, s.unit_id, s.method_id, s.ord FROM sp JOIN {sites} s ON s.is_call AND sp.caller = s.class_name || '.' || s.method_name AND sp.callee = s.callee_class || '.' || s.callee_name AND s.line <> -1 AND sp.l BETWEEN s.line AND s.end_line) GROUP BY spec)"""
_NOEX = """, ne AS (SELECT DISTINCT m, src, dst FROM cx WHERE NOT exc),
nr(n) AS (SELECT unit_id FROM uu WHERE NOT is_catch AND NOT is_nop AND unit_id NOT IN (SELECT dst FROM ne) UNION SELECT ne.dst FROM nr JOIN ne ON ne.src = nr.n),
nx2 AS (SELECT m, src, dst FROM ne WHERE src IN (SELECT n FROM nr))"""


def _named(sql: str, suffix: str, *names: str) -> str:
    """sql with the given names of its tables ending in suffix."""
    import re

    return re.sub(r"\b(" + "|".join(names) + r")\b(?!\.?[a-z]*\()", lambda m: m[0] + suffix, sql)


def _branch(edges: str) -> str:
    """Dominators (dom) and post-dominators (pom) of edges, each node's lowest branch (low), and the nodes on one side (br)."""
    post = _dominator_sql(edges, "dst", "src")
    for x in ("gn", "hd", "wo", "rc", "dom", "g"):
        post = __import__("re").sub(rf"\b{x}\b", f"{x}p", post)
    return _dominator_sql(edges, "src", "dst") + post + """, dep AS (SELECT n, count(*) AS k FROM dom GROUP BY n),
low AS (SELECT x.m, x.n, arg_max(x.d, dep.k) AS b FROM dom x JOIN dep ON dep.n = x.d WHERE x.d <> x.n AND NOT EXISTS (SELECT 1 FROM domp y WHERE y.n = x.d AND y.d = x.n) GROUP BY x.m, x.n),
cnt AS (SELECT m, count(*) AS k FROM gn GROUP BY m),
bel AS (SELECT d, count(*) - 1 AS k FROM dom GROUP BY d), abo AS (SELECT d, count(*) - 1 AS k FROM domp GROUP BY d),
sme AS (SELECT gn.m, gn.n FROM gn JOIN cnt ON cnt.m = gn.m LEFT JOIN bel ON bel.d = gn.n LEFT JOIN abo ON abo.d = gn.n WHERE coalesce(bel.k, 0) + coalesce(abo.k, 0) + 1 < cnt.k),
up(m, n, b) AS (SELECT m, n, b FROM low UNION SELECT up.m, up.n, low.b FROM up JOIN low ON low.n = up.b),
br AS MATERIALIZED (SELECT DISTINCT low.m, low.n, low.b FROM low JOIN sme ON sme.n = low.n JOIN up ON up.n = low.n JOIN g ON g.src = up.b
  WHERE g.dst <> low.n AND NOT EXISTS (SELECT 1 FROM dom WHERE dom.n = low.n AND dom.d = g.dst) AND NOT EXISTS (SELECT 1 FROM g e WHERE e.src = low.n AND e.dst = g.dst))"""


_TAILS = _CRIT + """, q(g, h, t) AS MATERIALIZED (SELECT tail, h, tail FROM cr UNION SELECT hi, lo, hi FROM mp WHERE lo <> hi),
qo AS MATERIALIZED (SELECT g, h AS n FROM q UNION SELECT g, t FROM q), qb AS MATERIALIZED (SELECT DISTINCT g, h AS p FROM q WHERE h <> g),
pt(g, r, fin, fout) AS MATERIALIZED (SELECT g, t, '', CAST(t AS VARCHAR) FROM q UNION SELECT g, h, CAST(t AS VARCHAR), h || ',' || t FROM q)"""


def _passes(calls: str = "ca", edges: str = "cfg", back: str | None = None, real: str = "true", ext: str | None = None, seqs: bool = True) -> str:
    """Both passes as relations: bu, td (g, m, d1, n, f), live and sl (g, n). calls (n, callee); back: the callers, where they
    differ; real: which callees stop what passes over a call; ext (unit, ext_unit): the extension relation."""
    back = back or calls
    grown = lambda f, r: f"""UNION ALL SELECT g, m, d1, r, r || ',' || f FROM ret JOIN {ext} x ON x.ext_unit = r AND x.unit = TRY_CAST(split_part(f, ',', 1) AS BIGINT) WHERE f <> ''
      AND NOT list_contains(string_split(f, ','), CAST(r AS VARCHAR)) AND NOT EXISTS (SELECT 1 FROM qo o WHERE o.g = ret.g AND CAST(o.n AS VARCHAR) = split_part(f, ',', 1) AND NOT EXISTS (SELECT 1 FROM q WHERE q.g = o.g AND q.h = o.n))"""  # noqa: E731
    more = grown("f", "r") if ext else ""
    strip = lambda f, n: f"CASE WHEN split_part({f}, ',', 1) = CAST({n} AS VARCHAR) THEN CASE WHEN contains({f}, ',') THEN substr({f}, strpos({f}, ',') + 1) ELSE 'e' END ELSE {f} END"
    down = strip("c.f", "c.n") if ext else "c.f"
    into = strip("p.f", "p.n") if ext else "p.f"
    if ext:
        begin = """SELECT g, f FROM at0 a WHERE NOT EXISTS (SELECT 1 FROM at0 b WHERE b.g = a.g AND ends_with(b.f, ',' || a.f)) AND EXISTS (SELECT 1 FROM q WHERE q.g = a.g AND ends_with(',' || a.f, ',' || q.h || ',' || q.t))"""
    else:
        begin = "SELECT g, f FROM at0 WHERE (g, f) IN (SELECT g, h || ',' || t FROM q)"
    return f""", bc AS MATERIALIZED (SELECT DISTINCT e.dst AS n, c.callee, e.src AS p FROM {edges} e JOIN {calls} c ON c.n = e.src),
bk2 AS MATERIALIZED (SELECT DISTINCT callee, n AS r FROM {back}),
rb AS MATERIALIZED (SELECT DISTINCT x.g, b.n, b.callee, e.src AS r FROM bc b JOIN {edges} e ON e.dst = b.n, (SELECT DISTINCT g FROM q) x WHERE NOT EXISTS (SELECT 1 FROM qb WHERE qb.g = x.g AND qb.p = b.p)),
bu(g, m, d1, n, f) AS (SELECT DISTINCT g, CAST(0 AS BIGINT), '', CAST(21 AS BIGINT), '' FROM q UNION
  SELECT * FROM (SELECT p.g, p.m, p.d1, e.src, p.f FROM bu p JOIN {edges} e ON e.dst = p.n
  UNION ALL SELECT p.g, p.m, p.d1, e.src, x.fout FROM bu p JOIN {edges} e ON e.dst = p.n JOIN pt x ON x.g = p.g AND x.r = e.src AND x.fin = p.f WHERE p.n IN (SELECT y.dst FROM {edges} y JOIN un ON un.u = y.src WHERE un.c)
  UNION ALL SELECT p.g, c.callee, p.f, c.callee * 22 + 21, p.f FROM bu p JOIN bc c ON c.n = p.n WHERE NOT EXISTS (SELECT 1 FROM qb WHERE qb.g = p.g AND qb.p = c.p)
  UNION ALL (WITH ret AS (
    SELECT c.g, c.m, c.d1, b.r, p.f, b.callee FROM bu p JOIN rb b ON b.g = p.g AND b.callee = p.m JOIN recurring.bu c ON concat(c.g, ':', c.n, ':', c.f) = concat(p.g, ':', b.n, ':', p.d1) WHERE p.n = p.m * 22 + 20
    UNION ALL SELECT c.g, c.m, c.d1, b.r, p.f, b.callee FROM bu c JOIN rb b ON b.g = c.g AND b.n = c.n JOIN recurring.bu p ON concat(p.g, ':', p.n, ':', p.d1) = concat(c.g, ':', b.callee * 22 + 20, ':', c.f)),
   kept AS (SELECT * FROM ret WHERE f = '' OR EXISTS (SELECT 1 FROM bk2 WHERE bk2.callee = ret.callee AND bk2.r = ret.r))
   SELECT g, m, d1, r, f FROM kept {more.replace("FROM ret ", "FROM kept ret ")}))),
live AS MATERIALIZED (SELECT DISTINCT g, n FROM bu WHERE f <> ''),
at0 AS MATERIALIZED (SELECT DISTINCT g, f FROM bu WHERE n = 20 AND f <> ''),
be AS MATERIALIZED ({begin}),
bd AS MATERIALIZED (SELECT DISTINCT n FROM {calls} WHERE {real}),
mv AS MATERIALIZED (SELECT l.g, e.src AS n, e.dst AS r, CASE WHEN o.n IS NOT NULL THEN 1 WHEN bd.n IS NOT NULL AND un.c THEN 2 ELSE 0 END AS k FROM {edges} e JOIN live l ON l.n = e.dst JOIN un ON un.u = e.src LEFT JOIN (SELECT DISTINCT g, n FROM qo) o ON o.g = l.g AND o.n = e.src LEFT JOIN bd ON bd.n = e.src),
en AS MATERIALIZED (SELECT x.g, c.n, c.callee FROM {calls} c, (SELECT DISTINCT g FROM q) x WHERE NOT EXISTS (SELECT 1 FROM qb WHERE qb.g = x.g AND qb.p = c.n)),
rt AS MATERIALIZED (SELECT DISTINCT en.g, en.n, en.callee, mv.r FROM en JOIN mv ON mv.g = en.g AND mv.n = en.n),
td(g, m, d1, n, f) AS (SELECT g, CAST(0 AS BIGINT), f, CAST(20 AS BIGINT), f FROM (SELECT g, f FROM be UNION SELECT g, '' FROM be) UNION
  SELECT * FROM (SELECT p.g, p.m, p.d1, mv.r, CASE WHEN mv.k = 1 THEN {strip("p.f", "p.n")} ELSE p.f END FROM td p JOIN mv ON mv.g = p.g AND mv.n = p.n WHERE p.f = '' OR mv.k <> 2
  UNION ALL SELECT p.g, c.callee, {into}, c.callee * 22 + 20, {into} FROM td p JOIN en c ON c.g = p.g AND c.n = p.n
  UNION ALL SELECT c.g, c.m, c.d1, b.r, p.f FROM td p JOIN rt b ON b.g = p.g AND b.callee = p.m JOIN recurring.td c ON concat(c.g, ':', c.n, ':', {down}) = concat(p.g, ':', b.n, ':', p.d1) WHERE p.n = p.m * 22 + 21
  UNION ALL SELECT c.g, c.m, c.d1, b.r, p.f FROM td c JOIN rt b ON b.g = c.g AND b.n = c.n JOIN recurring.td p ON concat(p.g, ':', p.n, ':', p.d1) = concat(c.g, ':', b.callee * 22 + 21, ':', {down}))),
sl AS (SELECT DISTINCT td.g, td.n FROM td JOIN bu ON bu.g = td.g AND bu.n = td.n AND bu.f = td.f WHERE td.f <> '' UNION SELECT DISTINCT td.g, td.n FROM td JOIN live ON live.g = td.g AND live.n = td.n WHERE td.f = 'e')"""


_NONE = ", nc AS MATERIALIZED (SELECT n, callee FROM ca WHERE false)"
_ACYC = ", ac AS MATERIALIZED (SELECT n, callee FROM ca WHERE callee > m)"
_SLICE = " SELECT sl.g AS tail_unit, un.m AS method_id, un.u AS unit_id FROM sl JOIN un ON un.u = sl.n"
_FACTS = " SELECT DISTINCT g AS tail_unit, n AS unit_id, f AS fact FROM {} WHERE f <> ''"

#: Constructor calls (cc), dispatch (dp), and what may stand before a method's units (mx).
_EXT = """, ks AS (SELECT unit_id AS k, base_local AS l, decl_class AS c FROM si WHERE is_call AND decl_cons AND base_local IS NOT NULL),
cw(a, l, n) AS (SELECT unit_id, assigned, unit_id FROM uu WHERE new_class IS NOT NULL UNION SELECT cw.a, cw.l, cfg.dst FROM cw JOIN cfg ON cfg.src = cw.n WHERE NOT EXISTS (SELECT 1 FROM ks WHERE ks.k = cw.n AND ks.l = cw.l)),
cc AS (SELECT cw.a AS new_unit, min(ks.k) AS call_unit FROM cw LEFT JOIN ks ON ks.k = cw.n AND ks.l = cw.l GROUP BY cw.a),
sc2(c, s, d) AS (SELECT DISTINCT class_id, class_id, 0 FROM mm UNION SELECT sc2.c, sup.p, sc2.d + 1 FROM sc2 JOIN sup ON sup.c = sc2.s),
dn AS (SELECT c, name, arg_min(method_id, d * 1000000 + method_id) AS target_id FROM sc2 JOIN mm ON mm.class_id = sc2.s AND has_body AND NOT is_static GROUP BY c, name),
dp AS (SELECT c AS class_id, mm.method_id AS decl_method_id, target_id FROM dn JOIN mm ON mm.name = dn.name),
im AS (SELECT DISTINCT sc2.c, imp.i FROM sc2 JOIN imp ON imp.c = sc2.s),
rv AS (SELECT fc.callee_id, fc.call_unit, si.is_call, coalesce(si.is_call AND invoke_kind <> 'static', false) AS inst, CASE WHEN callee_name = 'invoke' THEN first_arg WHEN callee_name = 'newInstance' THEN assigned ELSE base_local END AS base, invoke_kind, decl, decl_class, decl_iface,
  t.class_id AS tc, t.is_static AS ts, t.is_constructor AS tk FROM fc JOIN si ON si.unit_id = fc.call_unit JOIN mm t ON t.method_id = fc.callee_id),
al AS (SELECT method_id - x AS o, assigned % 4 AS slot, unit_id FROM uu, range(2) r(x) WHERE new_class IS NOT NULL),
po AS (SELECT o * 4 + slot AS local_id, cc.call_unit AS ext_unit, ks.c AS made FROM al JOIN cc ON cc.new_unit = al.unit_id JOIN ks ON ks.k = cc.call_unit
  UNION SELECT x.user_id * 4 + 1, n.u, x.user_id % 5 FROM (SELECT DISTINCT user_id FROM ev) x JOIN (SELECT base_local AS l, max(unit_id) AS u FROM si WHERE is_call AND callee_name = 'newInstance' AND base_local IS NOT NULL AND invoke_kind <> 'static' GROUP BY base_local) n ON n.l = x.user_id * 4 + 2),
mx AS MATERIALIZED (SELECT DISTINCT callee_id AS method_id, call_unit AS ext_unit FROM rv WHERE (ts AND is_call) OR (NOT ts AND NOT inst)
  UNION SELECT rv.callee_id, po.ext_unit FROM rv JOIN po ON po.local_id = rv.base WHERE NOT ts AND inst AND CASE WHEN tk OR invoke_kind = 'special' THEN EXISTS (SELECT 1 FROM sc2 WHERE sc2.c = po.made AND sc2.s = rv.tc)
    ELSE EXISTS (SELECT 1 FROM dp WHERE dp.class_id = po.made AND dp.decl_method_id = rv.decl AND dp.target_id = rv.callee_id)
     AND CASE WHEN decl_iface THEN EXISTS (SELECT 1 FROM im WHERE im.c = po.made AND im.i = rv.decl_class) ELSE EXISTS (SELECT 1 FROM sc2 WHERE sc2.c = po.made AND sc2.s = rv.decl_class) END END)"""
_VIRT = """, pv AS (SELECT fc.call_unit FROM fc JOIN uu ON uu.unit_id = fc.call_unit JOIN mm ON mm.method_id = fc.callee_id WHERE invoke_kind IN ('virtual', 'interface') AND mm.name <> '<clinit>' GROUP BY fc.call_unit HAVING count(DISTINCT fc.callee_id) > 1),
bv(n) AS (SELECT fc.callee_id FROM fc JOIN uu ON uu.unit_id = fc.call_unit WHERE fc.call_unit IN (SELECT call_unit FROM pv) OR (uu.is_call AND fc.call_unit IN ({branch}))
  UNION SELECT fc.callee_id FROM bv JOIN uu ON uu.method_id = bv.n AND uu.is_call JOIN fc ON fc.call_unit = uu.unit_id)"""
_EXT_CC = _EXT[: _EXT.index(",\nsc2(")]
#: Labels (lab) on the view without exceptional flow.
_LABELS = (
    _branch("nx2")
    + _LOOP[_LOOP.index(", bk AS") :]
    + """, mg2 AS (SELECT src, dst FROM fg WHERE src IN (SELECT n FROM rm)),
c2(src, dst) AS (SELECT src, dst FROM mg2 UNION SELECT c2.src, mg2.dst FROM c2 JOIN mg2 ON mg2.src = c2.dst),
lm(n) AS (SELECT fc.callee_id FROM fc JOIN uu ON uu.unit_id = fc.call_unit AND uu.is_call WHERE fc.call_unit IN (SELECT n FROM lb) UNION SELECT fg.dst FROM lm JOIN fg ON fg.src = lm.n),
ks0 AS (SELECT unit_id AS k, base_local AS l FROM si WHERE is_call AND decl_cons AND base_local IS NOT NULL),
cw0(a, l, n) AS (SELECT unit_id, assigned, unit_id FROM uu WHERE new_class IS NOT NULL UNION SELECT cw0.a, cw0.l, cfg.dst FROM cw0 JOIN cfg ON cfg.src = cw0.n WHERE NOT EXISTS (SELECT 1 FROM ks0 WHERE ks0.k = cw0.n AND ks0.l = cw0.l)),
cc0 AS (SELECT min(ks0.k) AS k FROM cw0 JOIN ks0 ON ks0.k = cw0.n AND ks0.l = cw0.l GROUP BY cw0.a),
lab(id, "on", tag) AS MATERIALIZED (SELECT n, 'unit', 'loop' FROM lb UNION SELECT n, 'unit', 'intra_cycle' FROM lb UNION SELECT n, 'method', 'intra_cycle' FROM lm UNION SELECT src, 'method', 'inter_cycle' FROM c2 WHERE src = dst
  UNION SELECT b.dst, 'method', 'inter_cycle' FROM c2 a JOIN c2 b ON b.src = a.src WHERE a.src = a.dst UNION SELECT src, 'method', 'recursion' FROM c2 WHERE src = dst UNION SELECT n, 'method', 'reachable' FROM rm
  UNION SELECT n, 'unit', 'branch' FROM br UNION SELECT k, 'unit', 'constructor' FROM cc0)"""
)


def _relation(units: str, heads: str, base: str) -> str:
    """rel (unit, ext_unit): the relation of base (method_id, ext_unit) from heads, useless units bypassed."""
    return _VIRT.format(branch="SELECT n FROM br") + f""", ex AS (SELECT uu.unit_id AS unit, b.ext_unit FROM {base} b JOIN uu ON uu.method_id = b.method_id WHERE uu.unit_id <> b.ext_unit),
hr(n) AS ({heads} UNION SELECT ex.ext_unit FROM hr JOIN ex ON ex.unit = hr.n),
e2 AS (SELECT * FROM ex WHERE unit IN (SELECT n FROM hr)),
us AS (SELECT uu.unit_id AS n FROM uu WHERE uu.unit_id IN (SELECT unit FROM e2 UNION SELECT ext_unit FROM e2) AND uu.unit_id NOT IN ({units}) AND uu.method_id <> 0 AND (
  uu.unit_id IN (SELECT id FROM lab WHERE "on" = 'unit' AND tag = 'intra_cycle') OR uu.method_id IN (SELECT id FROM lab WHERE "on" = 'method' AND tag IN ('intra_cycle', 'inter_cycle')) OR uu.decl = -4
  OR uu.method_id NOT IN (SELECT n FROM rm) OR (uu.unit_id NOT IN (SELECT n FROM br) AND uu.method_id NOT IN (SELECT n FROM bv)))),
ew(s, n) AS (SELECT unit, ext_unit FROM e2 WHERE unit NOT IN (SELECT n FROM us) UNION SELECT ew.s, e2.ext_unit FROM ew JOIN e2 ON e2.unit = ew.n WHERE ew.n IN (SELECT n FROM us)),
rel AS MATERIALIZED (SELECT DISTINCT s AS unit, n AS ext_unit FROM ew WHERE n NOT IN (SELECT n FROM us) AND s <> n)"""


_RELATION = _relation("SELECT a FROM bo UNION SELECT b FROM bo", "SELECT a FROM bo", "{base}")
_RELATION_TAILS = _relation("SELECT n FROM qo", "SELECT h FROM q", "mx")


def _clinit(spec: str) -> str:
    """att (call_unit, callee_id): the class initialisers of the classes of units (n) that no call calls, at the first call."""
    return f""", ci AS (SELECT min(method_id) AS callee_id FROM mm WHERE name = '<clinit>' AND class_id IN (SELECT class_id FROM si WHERE unit_id IN ({spec})) GROUP BY class_id),
by1 AS (SELECT fc.call_unit, fc.callee_id, uu.is_call FROM fc JOIN ci ON ci.callee_id = fc.callee_id JOIN uu ON uu.unit_id = fc.call_unit),
odd AS (SELECT callee_id, call_unit AS s FROM by1 WHERE callee_id NOT IN (SELECT callee_id FROM by1 WHERE is_call)),
fw(s, n) AS (SELECT DISTINCT s, s FROM odd UNION SELECT fw.s, cfg.dst FROM fw JOIN uu ON uu.unit_id = fw.n AND NOT uu.is_call JOIN cfg ON cfg.src = fw.n),
fi AS (SELECT fw.s, min(fw.n) AS n FROM fw JOIN uu ON uu.unit_id = fw.n AND uu.is_call GROUP BY fw.s),
att AS (SELECT arg_min(fi.n, fi.s) AS call_unit, odd.callee_id FROM odd JOIN fi ON fi.s = odd.s GROUP BY odd.callee_id)"""


_CLINIT = _clinit("SELECT a FROM bo")
#: Call edges of the view of all groups together (ft), and without a package and the library (fb, fk).
_CLINIT_TAILS = _clinit("SELECT p FROM qb") + """, ft AS (SELECT call_unit AS n, callee_id AS callee FROM fc UNION SELECT call_unit, callee_id FROM att),
fb AS MATERIALIZED (SELECT n, callee FROM ft WHERE callee % 7 NOT IN (3, 5, 6) OR (callee % 7 = 3 AND (n, callee) IN (SELECT call_unit, callee_id FROM att))), fk AS MATERIALIZED (SELECT n, callee FROM ft WHERE callee % 7 NOT IN (5, 6))"""

ORACLE = {
    "call_edges_filtered": _PROG + " SELECT call_unit, callee_id FROM fc",
    "callers_of_method": _BASE + "SELECT callee AS callee_id, count(*) AS n_callers, min(n) AS first_caller FROM ca GROUP BY callee",
    "return_sites": _BASE + "SELECT DISTINCT dst AS unit_id FROM cfg WHERE src IN (SELECT u FROM un WHERE c)",
    "start_end_points": _BASE + "SELECT DISTINCT m AS method_id, src AS unit_id, 'start' AS point FROM lay WHERE src NOT IN (SELECT dst FROM lay) UNION ALL SELECT DISTINCT m, dst, 'end' FROM lay WHERE dst NOT IN (SELECT src FROM lay)",
    "reversed_icfg_calls": _BASE + "SELECT DISTINCT cfg.dst AS call_unit, callee AS callee_id FROM ca JOIN cfg ON cfg.src = ca.n",
    "non_call_start_nodes": _BASE + "SELECT u AS unit_id FROM un WHERE NOT c AND u IN (SELECT dst FROM cfg)",
    "method_call_graph": _BASE + "SELECT src, dst FROM mg",
    "reachable_methods": _BASE + ", r(n) AS (SELECT CAST(0 AS BIGINT) UNION SELECT dst FROM r JOIN mg ON src = n) SELECT n AS method_id FROM r",
    "class_closure": "WITH s AS (SELECT CAST(n_nationkey AS BIGINT) AS c, CAST(n_regionkey + 1000 AS BIGINT) AS p FROM nation) SELECT c AS class_id, p AS super_id FROM s UNION SELECT c, c FROM s UNION SELECT p, p FROM s",
    "scc_members": _BASE + _SCC + " SELECT n AS method_id, root AS scc, count(*) OVER (PARTITION BY root) AS n FROM sc",
    "true_sccs": _BASE + _SCC + " SELECT n AS method_id, root AS scc FROM sc WHERE n IN (SELECT src FROM cl WHERE src = dst)",
    "cycle_labels_inter": _BASE + _CLOSURE + ", b AS (SELECT src AS n FROM cl WHERE src = dst) SELECT n AS method_id FROM b UNION SELECT cl.dst FROM cl JOIN b ON cl.src = b.n",
    "dominators": _BASE + _dominator_sql("cfg", "src", "dst") + " SELECT m AS method_id, n AS node, d AS dom FROM dom",
    "post_dominators": _BASE + _dominator_sql("lay", "dst", "src") + " SELECT m AS method_id, n AS node, d AS dom FROM dom",
    "back_edges": _BASE + _LOOP + " SELECT m AS method_id, src, dst FROM bk",
    "natural_loops": _BASE + _LOOP + " SELECT DISTINCT m AS method_id, h AS header, n AS node FROM lb",
    "loop_exits": _BASE + _EXIT + ' SELECT m AS method_id, h AS header, x AS "exit" FROM le',
    "loop_labels": _BASE + _LOOP + ", r(n) AS (SELECT callee FROM ca WHERE ca.n IN (SELECT lb.n FROM lb) UNION SELECT dst FROM r JOIN mg ON src = r.n) SELECT n AS method_id FROM r",
    "cycle_break_intra": _BASE + _EXIT + " SELECT src, dst FROM g WHERE NOT EXISTS (SELECT 1 FROM bk WHERE bk.src = g.src AND bk.dst = g.dst) UNION SELECT bk.src, le.x FROM bk JOIN le ON le.h = bk.dst",
    "blocked_callees": _BASE + _TAILS + " SELECT DISTINCT x.g AS tail_unit, n AS call_unit, callee AS callee_id FROM ca, (SELECT DISTINCT g FROM q) x WHERE NOT EXISTS (SELECT 1 FROM qb WHERE qb.g = x.g AND qb.p = ca.n)",
    "package_prefix_block": _BASE + "SELECT n AS call_unit, callee AS callee_id, 'pkg' || (callee % 7) AS package FROM ca WHERE NOT starts_with('pkg' || (callee % 7), 'pkg5') AND NOT starts_with('pkg' || (callee % 7), 'pkg6')",
    "sc_group_by_tail": _BASE + _SEQ + " SELECT seq[-1] AS tail, count(*) AS n_sequences, count(DISTINCT seq) AS n_distinct, count(DISTINCT seq[1]) AS n_heads FROM sq GROUP BY seq[-1]",
    "follow_sets": _BASE + _SEQ + " SELECT DISTINCT seq[i] AS unit_id, array_to_string(seq[i + 1:], ',') AS suffix FROM (SELECT seq, unnest(generate_series(1, len(seq) - 1)) AS i FROM sq)",
    "maximal_facts": _BASE + _SEQ + ", f AS (SELECT DISTINCT array_to_string(seq[i:], ',') AS f FROM (SELECT seq, unnest(generate_series(1, len(seq))) AS i FROM sq)) SELECT f FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE ends_with(g.f, ',' || f.f)) AND (ends_with(',' || f, ',2') OR ends_with(',' || f, ',0,4'))",
    "spec_resolution": _PROG + ", sp AS (SELECT DISTINCT call AS spec, class_name || '.' || method_name AS caller, callee_class || '.' || callee_name AS callee, line AS l FROM ct)" + _RESOLVE.format(sites="si") + " SELECT spec, unit_id FROM rs",
    "polymorphic_calls": _BASE + "SELECT n AS call_unit, count(DISTINCT callee) AS n_callees FROM ca GROUP BY n HAVING count(DISTINCT callee) > 1",
    "criteria_texts": _PROG + " SELECT a || ',' || b AS units, x.call || ';' || y.call || ';' AS text FROM bo JOIN ct x ON x.unit_id = a JOIN ct y ON y.unit_id = b",
    "criteria_lines": _PROG + """, ln(value) AS (SELECT x.call || ';' || y.call || ';' FROM bo JOIN ct x ON x.unit_id = a JOIN ct y ON y.unit_id = b UNION
  SELECT * FROM (VALUES (';'), ('; ;'), ('a/b/'), ('X.y/P.p/3'), ('X.y/P.p'), ('<pkg0.C0: void main(java.lang.String[])>/<lang.Api: java.lang.Object put(int)>/10;'), ('pkg0.C0.main/lang.Api.put/10 ; ;pkg0.C0.main/lang.Api.put/10'), ('pkg0.C0.main/lang.Api.put/12')) t(v)),
lp AS (SELECT value, trim(c) AS spec, row_number() OVER (PARTITION BY value ORDER BY i) AS pos FROM (SELECT value, unnest(string_split(value, ';')) AS c, generate_subscripts(string_split(value, ';'), 1) AS i FROM ln) WHERE trim(c) <> ''),
sp AS (SELECT spec, CASE WHEN starts_with(spec, '<pkg0') THEN 'pkg0.C0.main' ELSE split_part(spec, '/', 1) END AS caller, CASE WHEN starts_with(spec, '<pkg0') THEN 'lang.Api.put' ELSE split_part(spec, '/', 2) END AS callee, TRY_CAST(split_part(spec, '/', 3) AS BIGINT) AS l FROM (SELECT DISTINCT spec FROM lp)),
rsi AS (SELECT * FROM si WHERE method_id IN (SELECT n FROM rm))""" + _RESOLVE.format(sites="rsi") + """
SELECT ln.value, CASE WHEN bool_and(rs.unit_id IS NOT NULL) THEN string_agg(CAST(rs.unit_id AS VARCHAR), ',' ORDER BY lp.pos) END AS units FROM ln LEFT JOIN lp ON lp.value = ln.value LEFT JOIN rs ON rs.spec = lp.spec GROUP BY ln.value""",
    "file_names": _PROG + " SELECT unit_id AS tail_unit, split_part(class_name, '.', 2) || '.' || method_name || ';' || split_part(callee_class, '.', 2) || '.' || callee_name || ';' || line || '-ext-all-pkg0.C0.output' AS name FROM si WHERE is_call AND ord BETWEEN 8 AND 11",
    "line_numbers": _PROG + " SELECT unit_id, line, line <> -1 AND 10 BETWEEN line AND end_line AS covers_10 FROM uu",
    "names": _PROG + ", c AS (SELECT DISTINCT class_name, method_name FROM si) SELECT unnest([class_name || '.' || method_name, '<' || class_name || ': int ' || method_name || '(int,lang.Api)>']) AS name, class_name, method_name, split_part(class_name, '.', 2) AS short_name FROM c",
    "elapsed": _BASE + "SELECT event_id, (event_id * 977 // 60000) || ' min. ' || (event_id * 977 // 1000 % 60) || ' sec.' AS took FROM ev",
    "reachable_units": _PROG + " SELECT unit_id FROM uu WHERE method_id IN (SELECT n FROM rm)",
    "application_units": _PROG + " SELECT unit_id FROM si JOIN cls c ON c.class_id = si.class_id WHERE NOT c.is_library",
    "class_lines": _PROG + " SELECT DISTINCT class_name || ':' || line AS class_line FROM si WHERE line > 0",
    "tagged_units": _PROG + " SELECT unit_id FROM uu WHERE is_catch",
    "non_call_end_nodes": _BASE + "SELECT u AS unit_id FROM un WHERE u IN (SELECT src FROM cfg) AND u NOT IN (SELECT dst FROM cfg WHERE src IN (SELECT u FROM un WHERE c))",
    "allocation_units": _PROG + " SELECT unit_id, assigned AS local, new_class AS class_id FROM uu WHERE new_class IS NOT NULL",
    "class_calls": _PROG + " SELECT unit_id FROM uu WHERE decl = -4",
    "successor_kinds": _PROG + ", nu AS (SELECT unit_id, lead(unit_id) OVER (PARTITION BY method_id ORDER BY ord) AS nxt FROM uu) SELECT src, dst, CASE WHEN exc THEN 'exception' WHEN dst = nxt THEN 'fall' ELSE 'branch' END AS kind FROM cx LEFT JOIN nu ON nu.unit_id = src",
    "no_exception_view": _PROG + _NOEX + " SELECT m AS method_id, src, dst FROM nx2",
    "method_cfg": _BASE + "SELECT src, dst FROM cfg WHERE m = 0",
    "loops_without_catches": _BASE + _LOOP + " SELECT DISTINCT m AS method_id, h AS header, n AS node FROM lb WHERE h % 22 <> 4",
    "immediate_dominators": _BASE + _dominator_sql("cfg", "src", "dst") + ", dep AS (SELECT n, count(*) AS k FROM dom GROUP BY n) SELECT dom.m AS method_id, dom.n AS node, arg_max(dom.d, dep.k) AS idom FROM dom JOIN dep ON dep.n = dom.d WHERE dom.d <> dom.n GROUP BY dom.m, dom.n",
    "branch_labels": _BASE + _branch("lay") + " SELECT m AS method_id, n AS unit_id, b AS branch FROM br",
    "other_branch_calls": _BASE + _branch("lay") + """, sd AS (SELECT DISTINCT low.b, g.dst AS s FROM low JOIN g ON g.src = low.b),
rg(b, s, x) AS (SELECT b, s, s FROM sd UNION SELECT rg.b, rg.s, g.dst FROM rg JOIN g ON g.src = rg.x WHERE NOT EXISTS (SELECT 1 FROM domp p WHERE p.n = rg.b AND p.d = g.dst AND p.d <> p.n)),
hc AS (SELECT DISTINCT b, s FROM rg WHERE x IN (SELECT src FROM lay WHERE src % 10 = 2))
SELECT DISTINCT low.m AS method_id, low.n AS unit_id, low.b AS branch FROM low JOIN hc ON hc.b = low.b WHERE hc.s <> low.n AND NOT EXISTS (SELECT 1 FROM dom WHERE dom.n = low.n AND dom.d = hc.s)""",
    "follow_cut": _BASE + _SEQ + ", c AS (SELECT DISTINCT seq, coalesce(list_position(seq, 1) - 1, len(seq)) AS stop FROM sq) SELECT DISTINCT seq[i] AS unit_id, array_to_string(seq[i + 1:], ',') AS suffix FROM (SELECT seq, unnest(generate_series(1, least(stop, len(seq) - 1))) AS i FROM c)",
    "interned_sets": _BASE + ", s AS (SELECT n, list(DISTINCT callee ORDER BY callee) AS l FROM ca GROUP BY n) SELECT n AS call_unit, min(n) OVER (PARTITION BY l) AS set_id FROM s",
    "fact_heads": _BASE + _SEQ + """, f AS (SELECT DISTINCT seq[i:] AS l FROM (SELECT seq, unnest(generate_series(1, len(seq))) AS i FROM sq))
SELECT array_to_string(l, ',') AS fact, u AS unit_id, l[1] = u AS removes, array_to_string(l[2:], ',') AS rest, CAST(CASE WHEN len(l) <= 1 THEN 2 ELSE 1 END AS BIGINT) AS kind, u || ',' || array_to_string(l, ',') AS added, len(l) > 1 AND l[-1] = u AS ends FROM f, range(5) t(u)""",
    "can_extend": _BASE + """, su AS (SELECT m, min(u) AS a, max(u) AS b, min(CASE WHEN u % 22 >= 8 THEN u END) AS c FROM un WHERE u % 22 < 20 GROUP BY m),
s3 AS (SELECT m, a, c, b FROM su WHERE c IS NOT NULL AND a <> b AND a <> c AND b <> c),
f(m, g, h, f) AS (SELECT m, b, a, a || ',' || c || ',' || b FROM s3 UNION SELECT m, b, c, c || ',' || b FROM s3 UNION SELECT m, b, b, CAST(b AS VARCHAR) FROM s3)
SELECT f.g AS tail_unit, cfg.dst AS unit_id, cfg.dst || ',' || f.f AS fact FROM f JOIN s3 ON s3.m = f.m JOIN cfg ON cfg.src = f.h WHERE f.h = s3.a AND NOT list_contains(string_split(f.f, ','), CAST(cfg.dst AS VARCHAR))""",
    "polymorphic_virtual": _PROG + " SELECT call_unit, count(DISTINCT callee_id) AS n_callees FROM fc JOIN uu ON uu.unit_id = call_unit JOIN mm ON mm.method_id = callee_id WHERE invoke_kind IN ('virtual', 'interface') AND mm.name <> '<clinit>' GROUP BY call_unit HAVING count(DISTINCT callee_id) > 1",
    "dispatch": _PROG + _EXT + " SELECT class_id, decl_method_id, target_id FROM dp",
    "constructor_calls": _PROG + _EXT + " SELECT new_unit, call_unit FROM cc",
    "allocations": _PROG + " SELECT 'new' AS alloc_kind, unit_id AS alloc_unit, CAST(NULL AS BIGINT) AS alloc_local FROM uu WHERE new_class IS NOT NULL UNION ALL SELECT 'class', max(unit_id), base_local FROM si WHERE is_call AND callee_name = 'newInstance' AND base_local IS NOT NULL AND invoke_kind <> 'static' GROUP BY base_local",
    "method_extensions": _PROG + _EXT + " SELECT method_id, ext_unit FROM mx",
    "labels": _PROG + _NOEX + _LABELS + " SELECT id, \"on\", tag FROM lab",
    "branch_or_virtual": _PROG + _branch("cfg") + _VIRT.format(branch="SELECT n FROM br") + " SELECT n AS method_id FROM bv",
    "extension_relation": _PROG + _NOEX + _LABELS + _EXT + _RELATION.format(base="mx") + " SELECT unit, ext_unit FROM rel",
    "extension_without_library": _PROG + _NOEX + _LABELS + _EXT + ", ml AS (SELECT * FROM mx WHERE method_id NOT IN (SELECT mx.method_id FROM mx JOIN si ON si.unit_id = mx.ext_unit JOIN cls ON cls.class_id = si.class_id WHERE cls.is_library))" + _RELATION.format(base="ml") + " SELECT unit, ext_unit FROM rel",
    "clinit_attachments": _PROG + _CLINIT + " SELECT call_unit, callee_id FROM att",
    "blocked_view_callees": _PROG + _CLINIT + ", bl AS (SELECT method_id FROM mm WHERE class_id IN (3, 4)), ref AS (SELECT method_id FROM mm WHERE name IN ('newInstance', 'invoke')) SELECT call_unit, callee_id FROM fc WHERE callee_id NOT IN (SELECT method_id FROM bl) AND callee_id NOT IN (SELECT method_id FROM ref) UNION SELECT call_unit, callee_id FROM att",
    "blocked_view_callers": _PROG + _CLINIT + " SELECT call_unit, callee_id FROM (SELECT call_unit, callee_id FROM fc UNION SELECT call_unit, callee_id FROM att) WHERE callee_id IN (SELECT method_id FROM mm JOIN cls ON cls.class_id = mm.class_id WHERE NOT is_library)",
    "bu_facts_intra": _BASE + _TAILS + _NONE + _passes("nc") + _FACTS.format("bu"),
    "td_facts_intra": _BASE + _TAILS + _NONE + _passes("nc") + _FACTS.format("td"),
    "bu_facts": _BASE + _TAILS + _passes() + _FACTS.format("bu"),
    "td_facts": _BASE + _TAILS + _passes() + _FACTS.format("td"),
    "bottom_up_reachable": _BASE + _TAILS + _passes() + " SELECT g AS tail_unit, n AS unit_id, bool_or(f <> '') AS live FROM bu GROUP BY g, n",
    "top_down_view": _BASE + _TAILS + _passes() + " SELECT src, dst FROM cfg WHERE dst IN (SELECT n FROM live)",
    "initial_facts": _BASE + _TAILS + _passes() + " SELECT g AS tail_unit, f AS fact FROM be",
    "slice": _BASE + _TAILS + _passes() + _SLICE,
    "slice_acyclic": _BASE + _TAILS + _ACYC + _passes("ac") + _SLICE,
    "slice_infeasible": _BASE.replace("un AS MATERIALIZED (SELECT DISTINCT u, user_id AS m, t IN (0, 2) AS c FROM st UNION SELECT DISTINCT user_id * 22 + 20, user_id, false FROM st UNION SELECT DISTINCT user_id * 22 + 21, user_id, false FROM st)", "un AS MATERIALIZED (SELECT DISTINCT u, user_id AS m, t IN (0, 2) AS c FROM st UNION SELECT DISTINCT user_id * 22 + 20, user_id, false FROM st UNION SELECT DISTINCT user_id * 22 + 21, user_id, user_id = 0 FROM st)") + _TAILS.replace("q(g, h, t) AS MATERIALIZED (", "q0(g, h, t) AS (").replace("qo AS MATERIALIZED (", "q AS MATERIALIZED (SELECT DISTINCT g, CAST(21 AS BIGINT) AS h, g AS t FROM q0), qo AS MATERIALIZED (") + _ACYC + _passes("ac") + _SLICE,
    "slice_report": _PROG + _TAILS + _passes() + """, s AS (SELECT sl.g, si.signature, si.method_id, si.ord, '  u' || si.unit_id || ' {line: ' || si.line || '}' AS line FROM sl JOIN si ON si.unit_id = sl.n),
l AS (SELECT g, signature, method_id, 3 + ord AS k, line FROM s UNION ALL SELECT DISTINCT g, signature, method_id, unnest([0, 1, 2]), unnest([repeat('=', 58), 'Method: ' || signature, 'Units in the tailored program:']) FROM s)
SELECT g AS tail_unit, row_number() OVER (PARTITION BY g ORDER BY signature, method_id, k) AS pos, line FROM l""",
    "fact_dump": _PROG + _TAILS + _passes() + ", f AS (SELECT DISTINCT n, f FROM bu WHERE f <> '') SELECT row_number() OVER (PARTITION BY class_name, signature ORDER BY ord, unit_id, f) AS pos, class_name, signature, unit_id, f AS fact FROM f JOIN si ON si.unit_id = f.n JOIN cls ON cls.class_id = si.class_id WHERE NOT is_library",
    "slice_blocked": _PROG + _TAILS + _CLINIT_TAILS + _passes("fb", back="fk", real="callee NOT IN (SELECT method_id FROM mm WHERE name = '<clinit>')") + _SLICE,
    "slice_program": _PROG + _NOEX + _LABELS + _EXT + _TAILS + _CLINIT_TAILS.replace("fb AS MATERIALIZED (", "fb0 AS (").replace("fk AS MATERIALIZED (", "fk0 AS (") + ", fb AS MATERIALIZED (SELECT n, callee FROM ft), fk AS MATERIALIZED (SELECT n, callee FROM ft)" + _RELATION_TAILS + _passes("fb", back="fk", real="callee NOT IN (SELECT method_id FROM mm WHERE name = '<clinit>')", ext="rel") + _SLICE,
    "extension_contract": _BASE + """, ul AS (SELECT n FROM (SELECT src AS n FROM mg UNION SELECT dst FROM mg) WHERE n % 3 = 1),
w(s, n) AS (SELECT src, dst FROM mg WHERE src NOT IN (SELECT n FROM ul) UNION SELECT w.s, mg.dst FROM w JOIN mg ON mg.src = w.n WHERE w.n IN (SELECT n FROM ul))
SELECT DISTINCT s AS src, n AS dst FROM w WHERE n NOT IN (SELECT n FROM ul) AND s <> n""",
}
