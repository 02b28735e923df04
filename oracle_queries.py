"""DuckDB statements of the registered queries, over the supplied tables.

Written from the definitions, not generated from the Spark plans: order
statistics are picked from sorted lists, grouping is a recursive walk in line
order, and claims are compared with every name.
"""

import dataclasses
import hashlib
import json

from pricebench import MatchConfig
from pricebench.functions import rules
from pricebench.operators.evidence import NOTE
from pricebench.sources.star import SUFFIXES

W, T = "0.6::double", "0.65::double"


def fx(x: str, k: int) -> str:
    """Decimal rounding of the exact binary value, halves away from zero."""
    fmt = "{:." + str(k) + "f}"
    return f"(CASE WHEN (({x})*{2 ** (k + 2)})%1=0 THEN round({x},{k}) ELSE CAST(format('{fmt}',{x}) AS DOUBLE) END + 0.0)"


def esum(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(28,6))) AS DOUBLE)"


def pct(x: str) -> str:
    return f"(CAST(CAST({fx(x, 0)} AS BIGINT) AS VARCHAR)||'%')"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_suffix = " ".join(f"WHEN {i} THEN {q(s)}" for i, s in enumerate(SUFFIXES))
_cat = " ".join(
    f"WHEN {' OR '.join(f'contains(nm,{q(k)})' for k in keys)} THEN {q(c)}" for c, keys in rules.CATEGORY_RULES
)
_grade = " ".join(f"WHEN regexp_matches(nm,{q(p)}) THEN {q(g)}" for g, p in rules.GRADE_TAGS)

LINES = f"""a0 AS (SELECT row_number() OVER (ORDER BY l_orderkey,l_partkey,l_suppkey,l_linenumber,l_shipdate,l_extendedprice,l_quantity)-1 AS seq,
   'B'||l_orderkey AS bill_no, s_name AS supplier, CAST(o_orderdate AS DATE) AS bill_dt, p_brand AS make, p_type AS model,
   upper(p_name)||CASE (l_partkey*3+l_linenumber*5+l_suppkey)%14 {_suffix} END AS part_name,
   'PN-'||l_partkey||'.00 9999' AS part_number, l_quantity AS qty, l_extendedprice AS total,
   CASE WHEN o_orderstatus='P' THEN 'Repair Estimate' ELSE 'Tax Invoice' END AS doc_type
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey),
a1 AS (SELECT *, ' '||lower(part_name)||' ' AS nm, total/qty AS up FROM a0),
a2 AS (SELECT *, CASE {_cat} ELSE 'Other' END AS cat,
   CASE {_grade} ELSE 'Unknown' END AS grade,
   CASE WHEN regexp_matches(nm,{q(rules.SET_TAG)}) THEN 'set' WHEN regexp_matches(nm,{q(rules.PAIR_TAG)}) THEN 'pair' ELSE 'each' END AS unit_basis,
   {fx('up', 2)} AS unit, regexp_replace(regexp_replace(upper(part_number),'\\s*9{{3,}}$',''),'[\\s\\-.]','','g') AS npn FROM a1),
l AS (SELECT CAST(seq AS BIGINT) AS seq, CAST(seq AS VARCHAR) AS id, bill_no, supplier, bill_dt, strftime(bill_dt,'%d/%m/%Y') AS bill_date, make, model,
   part_name, part_number, npn, cat, qty, unit, total,
   CASE WHEN contains(lower(doc_type),'estimate') THEN 'Repair Estimate' WHEN cat='Consumable/Fastener' THEN 'Consumable / Fastener' ELSE 'Supplier Part' END AS ltype,
   doc_type, grade, unit_basis FROM a2)"""


def _list(words) -> str:
    return "[" + ",".join(q(w) for w in words) + "]"


def _axis(name: str, toks: str) -> str:
    (a, aw), (b, bw) = rules.POSITION_AXES[name]
    ha, hb = f"list_has_any({toks},{_list(aw)})", f"list_has_any({toks},{_list(bw)})"
    return f"CASE WHEN {ha} AND NOT {hb} THEN '{a}' WHEN {hb} AND NOT {ha} THEN '{b}' ELSE '' END"


def features(name: str) -> str:
    toks = f"list_filter(string_split_regex(lower({name}),'[^a-z0-9]+'), lambda t: t<>'')"
    return (
        f"array_to_string(list_filter({toks}, lambda t: NOT list_contains({_list(rules.STOPWORDS)},t)),' ') AS nn, "
        + ", ".join(f"{_axis(x, toks)} AS p_{x}" for x in ("side", "end", "vert", "depth"))
    )


def clash(x: str, y: str) -> str:
    return "(" + " OR ".join(f"({x}.p_{a}<>'' AND {y}.p_{a}<>'' AND {x}.p_{a}<>{y}.p_{a})" for a in ("end", "vert", "depth")) + ")"


def sim(x: str, y: str, w: str = W) -> str:
    j = f"coalesce(len(list_intersect({x}.tk,{y}.tk))::double/nullif(len(list_distinct(list_concat({x}.tk,{y}.tk))),0),0)"
    lv = (f"CASE WHEN {x}.nn='' OR {y}.nn='' THEN 0.0::double ELSE 1-levenshtein({x}.nn,{y}.nn)::double/greatest(len({x}.nn),len({y}.nn)) END")
    return f"({w}*{j} + (1-{w})*({lv}))"


TOKENS = "list_distinct(list_filter(string_split(nn,' '), lambda t: t<>'')) AS tk"
USABLE = "u AS (SELECT * FROM l WHERE ltype='Supplier Part')"

# What a walk in order needs: vertices ``v`` (ord, make, grade, unit_basis, positions, nn).
WALK = f"""n AS (SELECT *, row_number() OVER (PARTITION BY make ORDER BY ord) AS i, {TOKENS} FROM v),
e AS (SELECT y.make, y.i, x.i AS lo FROM n x JOIN n y ON x.make=y.make AND x.unit_basis=y.unit_basis AND x.i<y.i
   AND NOT (x.grade<>'Unknown' AND y.grade<>'Unknown' AND x.grade<>y.grade) AND NOT {clash('x', 'y')}
   WHERE {sim('x', 'y')} >= {T}),
lw AS (SELECT n.make, n.i, n.ord, coalesce(list(e.lo) FILTER (e.lo IS NOT NULL),[]::BIGINT[]) AS los
   FROM n LEFT JOIN e ON e.make=n.make AND e.i=n.i GROUP BY ALL),
r AS (SELECT make, 0::BIGINT AS i, []::BIGINT[] AS ld FROM (SELECT DISTINCT make FROM n) UNION ALL
   SELECT r.make, r.i+1, CASE WHEN list_has_any(lw.los,r.ld) THEN r.ld ELSE list_append(r.ld,lw.i) END
   FROM r JOIN lw ON lw.make=r.make AND lw.i=r.i+1),
f AS (SELECT make, max_by(ld,i) AS ld FROM r GROUP BY make),
o AS (SELECT lw.ord, lw.make, CASE WHEN list_contains(f.ld,lw.i) THEN lw.i ELSE list_min(list_intersect(lw.los,f.ld)) END AS oi
   FROM lw JOIN f USING (make)),
own AS (SELECT o.ord, lead.ord AS owner FROM o JOIN lw AS lead ON lead.make=o.make AND lead.i=o.oi)"""

FUZZY = f"""{LINES}, {USABLE},
uf AS (SELECT *, {features('part_name')} FROM u),
v AS (SELECT make, grade, unit_basis, p_end, p_vert, p_depth, nn, min(seq) AS ord FROM uf GROUP BY ALL),
{WALK},
g AS (SELECT uf.*, own.owner AS cluster_id, uf.seq AS mr, own.owner AS cord FROM uf
   JOIN v ON v.make=uf.make AND v.grade=uf.grade AND v.unit_basis=uf.unit_basis AND v.p_end=uf.p_end AND v.p_vert=uf.p_vert
     AND v.p_depth=uf.p_depth AND v.nn=uf.nn JOIN own ON own.ord=v.ord)"""

BRIDGE = f"""{LINES}, {USABLE},
pg AS (SELECT npn, min(seq) AS ord, arg_min(make,seq) AS make, arg_min(grade,seq) AS grade, arg_min(unit_basis,seq) AS unit_basis,
   arg_min(part_name,seq) AS part_name FROM u GROUP BY npn),
v AS (SELECT *, {features('part_name')} FROM pg),
{WALK},
g AS (SELECT u.*, own.owner AS cluster_id, (pg.ord, u.seq) AS mr, own.owner AS cord FROM u JOIN pg USING (npn) JOIN own ON own.ord=pg.ord)"""


def plain(key: str) -> str:
    return f"{LINES}, {USABLE}, g AS (SELECT *, {key} AS cluster_id, seq AS mr, seq AS cord FROM u)"


EXACT = plain("npn")


def _rank(p: float) -> str:
    lo, hi = f"CAST(floor({p}*(n-1)) AS BIGINT)+1", f"CAST(ceil({p}*(n-1)) AS BIGINT)+1"
    return f"(us[{lo}] + ({p}*(n-1)-floor({p}*(n-1)))*(us[{hi}]-us[{lo}]))"


def stats(source: str, key: str) -> str:
    """``source`` grouped by ``key`` with the price summary, as the body of a CTE chain ending in ``s2``."""
    med = "((us[(n-1)//2+1]+us[n//2+1])/2)"
    return f"""s0 AS (SELECT {key}, count(*) AS n, list_sort(list(unit)) AS us, {esum('unit')}/count(*) AS mean, stddev_samp(unit) AS dev FROM {source} GROUP BY {key}),
s1 AS (SELECT *, {_rank(0.25)} AS q1r, {_rank(0.75)} AS q3r FROM s0),
s2 AS (SELECT {key}, n, us[1] AS min_unit, {fx(med, 2)} AS med, {fx('mean', 2)} AS avg, us[n] AS max_unit, {fx('(us[n]-us[1])', 2)} AS spread,
   {fx('q1r', 2)} AS q1, {fx('q3r', 2)} AS q3, {fx('(q3r-q1r)', 2)} AS iqr, {fx('dev', 2)} AS sd,
   CASE WHEN mean>0 THEN {fx('(dev/mean*100)', 1)} END AS cv, {fx('(q1r-(q3r-q1r)*1.5)', 2)} AS lower_fence,
   {fx('(q3r+(q3r-q1r)*1.5)', 2)} AS upper_fence, n>=4 AS reliable FROM s1)"""


CLUSTERS = f"""{stats('g', 'cluster_id')},
h AS (SELECT cluster_id, min(cord) AS cord, arg_min(make,mr) AS make, arg_min(model,mr) AS model, arg_min(cat,mr) AS cat,
   arg_min(unit_basis,mr) AS unit_basis, arg_min(part_name,mr) AS label, arg_min(npn,mr) AS first_pn,
   count(DISTINCT part_name) AS n_names, count(DISTINCT npn) AS n_pns, count(DISTINCT supplier) AS n_suppliers, count(DISTINCT model) AS n_models,
   count(DISTINCT grade) FILTER (grade<>'Unknown') AS kg, max(grade) FILTER (grade<>'Unknown') AS g1,
   min(bill_dt) AS first_date, max(bill_dt) AS last_date, count(bill_dt) AS n_dated FROM g GROUP BY cluster_id),
c AS (SELECT h.cluster_id, cord, first_pn||'|'||make AS key, label, make, model, cat, unit_basis,
   CASE WHEN kg=1 THEN g1 WHEN kg>1 THEN 'Mixed' ELSE 'Unknown' END AS grade, kg>1 AS grade_mixed, n_models>1 AS model_mixed, n_pns>1 AS bridged,
   n_names, n_pns, n_suppliers, n_models, s2.* EXCLUDE (cluster_id), first_date, last_date, n_dated FROM h JOIN s2 USING (cluster_id))"""

CLUSTER_COLUMNS = (
    "key, label, make, model, cat, unit_basis, grade, grade_mixed, model_mixed, bridged, n_names, n_pns, n_suppliers, n_models, "
    "n, min_unit, med, avg, max_unit, spread, q1, q3, iqr, sd, cv, lower_fence, upper_fence, reliable, first_date, last_date, n_dated"
)
LABEL = "CASE WHEN n_models>1 THEN model||' +'||(n_models-1) ELSE model END"
BAND = "CASE WHEN cv IS NULL THEN '—' WHEN cv<10 THEN 'tight' WHEN cv<25 THEN 'moderate' ELSE 'wide' END"


def table(chain: str) -> str:
    return f"WITH RECURSIVE {chain}, {CLUSTERS} SELECT CAST(cluster_id AS VARCHAR) AS cluster_id, {CLUSTER_COLUMNS} FROM c"


CLAIMS = """cl AS (SELECT bill_no AS claim_ref, seq AS line_no, CASE WHEN seq%20<10 THEN part_number ELSE '' END AS part_no,
   CASE WHEN seq%70<10 THEN 'UNLISTED '||string_split(part_name,' ')[2]||' THING' ELSE part_name END AS name,
   unit AS quoted, CASE WHEN seq%30<20 THEN make ELSE '' END AS make,
   regexp_replace(regexp_replace(upper(CASE WHEN seq%20<10 THEN part_number ELSE '' END),'\\s*9{3,}$',''),'[\\s\\-.]','','g') AS npn
 FROM l WHERE ltype='Repair Estimate')"""

ASSESS = f"""{CLAIMS},
pns AS (SELECT npn, arg_min(cluster_id,(-n,cord)) AS pc FROM (SELECT DISTINCT npn, cluster_id FROM g) JOIN c USING (cluster_id) GROUP BY npn),
asks AS (SELECT *, {TOKENS} FROM (SELECT DISTINCT name, lower(make) AS mk, {features('name')} FROM cl LEFT JOIN pns USING (npn) WHERE pc IS NULL)),
lab AS (SELECT cluster_id, cord, n, make, {features('label')} FROM c),
nam AS (SELECT *, {TOKENS} FROM (SELECT DISTINCT cluster_id, {features('part_name').split(', CASE')[0]} FROM (SELECT DISTINCT cluster_id, part_name FROM g))),
ps AS MATERIALIZED (SELECT x.nn AS an, y.nn AS bn, {sim('x', 'y')} AS sc FROM (SELECT DISTINCT nn, tk FROM asks) x, (SELECT DISTINCT nn, tk FROM nam) y),
cand AS (SELECT asks.name, asks.mk, lab.cluster_id, lab.n, lab.cord, max(ps.sc) AS sc
   FROM asks JOIN lab ON (asks.mk='' OR lab.make='Unknown' OR lower(lab.make)=asks.mk) AND NOT {clash('asks', 'lab')}
   JOIN nam ON nam.cluster_id=lab.cluster_id JOIN ps ON ps.an=asks.nn AND ps.bn=nam.nn GROUP BY ALL),
best AS (SELECT name, mk, arg_min(cluster_id,(-sc,-n,cord)) AS nc, max(sc) AS ns FROM cand WHERE sc>0 GROUP BY name, mk),
m AS (SELECT cl.*, pc, nc, ns, coalesce(pc, CASE WHEN ns>={T} THEN nc END) AS cid FROM cl LEFT JOIN pns USING (npn)
   LEFT JOIN best ON pc IS NULL AND best.name=cl.name AND best.mk=lower(cl.make)),
ass AS (SELECT m.claim_ref, m.line_no, CASE WHEN part_no='' THEN '—' ELSE part_no END AS pn, m.name, m.make AS claim_make, quoted, c.med AS bench,
   {fx('(quoted-nullif(c.med,0))', 2)} AS over, {fx('((quoted-nullif(c.med,0))/nullif(c.med,0)*100)', 0)} AS over_pct,
   CASE WHEN pc IS NOT NULL THEN 'part number' WHEN cid IS NOT NULL THEN 'name' ELSE 'no match' END AS how,
   CASE WHEN pc IS NOT NULL THEN 1.0::double WHEN cid IS NOT NULL THEN {fx('ns', 2)} ELSE 0.0::double END AS score,
   nr.label AS near_label, nr.make AS near_make, CASE WHEN cid IS NULL THEN {fx('ns', 2)} END AS near_score,
   coalesce(c.n,0) AS n, CASE WHEN c.reliable THEN c.upper_fence END AS upper_bound, m.cid, c.label
   FROM m LEFT JOIN c ON c.cluster_id=m.cid LEFT JOIN c AS nr ON m.cid IS NULL AND nr.cluster_id=m.nc),
fin AS (SELECT *, coalesce(over_pct>=30,false) AS flagged, coalesce(quoted>upper_bound,false) AS above_bound FROM ass)"""

PAIRS = f"""pr AS (SELECT x.part_name AS part_name_a, y.part_name AS part_name_b, x.npn=y.npn OR x.nm2=y.nm2 AS truth
   FROM (SELECT *, string_split(part_name,' ')[1:2] AS nm2, row_number() OVER (PARTITION BY bill_no ORDER BY seq) AS k FROM l) x
   JOIN (SELECT *, string_split(part_name,' ')[1:2] AS nm2, row_number() OVER (PARTITION BY bill_no ORDER BY seq) AS k FROM l) y
   ON x.bill_no=y.bill_no AND y.k=x.k+1)"""


def oracles() -> dict[str, str]:
    clusters = f"WITH RECURSIVE {FUZZY}, {CLUSTERS}"
    exact = f"WITH {EXACT}, {CLUSTERS}"
    lines = f"WITH {LINES}"
    part = "ltype='Supplier Part'"
    out = {
        "e_enrich": f"{lines} SELECT *, 'excel' AS src, 'unknown' AS gst, false AS review, '' AS review_reason FROM l",
        "e_features": f"{lines} SELECT part_name, nn, p_side AS side, p_end AS \"end\", p_vert AS vert, p_depth AS depth, "
                      f"len(list_distinct(list_filter(string_split(nn,' '), lambda t: t<>''))) AS n_tokens "
                      f"FROM (SELECT DISTINCT part_name, {features('part_name')} FROM l)",
        "c1_exact_pn": table(EXACT),
        "c2_category": table(plain("make||' · '||cat")),
        "q9_snapshots": table(plain("make||' · '||cat")),
        "c3_fuzzy": table(FUZZY),
        "c4_hybrid": table(EXACT),
        "c5_bridge": table(BRIDGE),
        "a4_reconcile": f"{lines}, b AS (SELECT bill_no, count(*) AS n, {fx(esum('total'), 2)} AS s FROM l GROUP BY bill_no), "
                        f"p AS (SELECT 'B'||o_orderkey AS bill_no, o_totalprice AS t FROM orders), "
                        f"d AS (SELECT b.*, t, CASE WHEN t<>0 THEN {fx('(s-t)', 2)} ELSE 0.0::double END AS diff FROM b JOIN p USING (bill_no)) "
                        "SELECT bill_no, n, s AS sum, t AS stated, diff, CASE WHEN t=0 THEN 'none' ELSE 'invoice total' END AS basis, "
                        "CASE WHEN t<>0 THEN abs(diff)<=greatest(1.0::double, t*0.005::double) END AS ok FROM d",
        "a5_kpis": f"{clusters} SELECT (SELECT count(DISTINCT bill_no) FROM l) AS invoices, (SELECT count(*) FROM l) AS lines, "
                   f"(SELECT count(*) FROM l WHERE {part}) AS usable, (SELECT count(DISTINCT make) FROM l WHERE {part}) AS makes, "
                   "0::BIGINT AS review, count(*) AS clusters, count(*) FILTER (n>1) AS ready FROM c",
        "a6_bills": f"{lines} SELECT bill_no AS bill, arg_min(supplier,seq) AS supplier, arg_min(bill_date,seq) AS date, arg_min(make,seq) AS make, "
                    f"arg_min(doc_type,seq) AS doc, count(*) AS n, {fx(esum('total'), 2)} AS total FROM l GROUP BY bill_no",
        "a7_types": f"{lines}, t AS (SELECT ltype, count(*) AS n FROM l GROUP BY ltype) SELECT ltype, n, "
                    f"{pct('(n/(SELECT sum(n) FROM t)*100)')} AS share FROM t",
        "a8_categories": f"{lines} SELECT cat, count(*) AS n, count(DISTINCT npn) AS part_numbers FROM l WHERE {part} GROUP BY cat",
        "a9_bands": f"{clusters} SELECT CASE WHEN n>=4 THEN '4+ quotes' WHEN n=1 THEN '1 quote' ELSE n||' quotes' END AS size, count(*) AS n FROM c GROUP BY 1",
        "a10_makes": f"{clusters} SELECT make, (SELECT count(*) FROM l WHERE {part} AND l.make=c.make) AS parts, count(*) AS clusters, "
                     "count(*) FILTER (n>1) AS ready FROM c GROUP BY make",
        "a12_confidence": f"{clusters}, k AS (SELECT *, CAST(floor((0.4::double*least(1.0::double,(n-1)/4)+0.35::double*least(1.0::double,(n_suppliers-1)/3)"
                          "+0.25::double*(1.0::double-least(1.0::double,(DATE '2001-08-02'-last_date)/1095.0::double)))*100+0.5) AS BIGINT) AS score FROM c WHERE n>1) "
                          f"SELECT CAST(cluster_id AS VARCHAR) AS cluster_id, label, make, {LABEL} AS model, n, n_suppliers AS suppliers, score, cv, {BAND} AS spread, "
                          "CASE WHEN score>=60 THEN 'High' WHEN score>=30 THEN 'Medium' ELSE 'Low' END AS band FROM k",
        "a13_dispersion": f"{clusters}, x AS (SELECT cluster_id, arg_min(supplier,(unit,mr)) AS cheapest, min(unit) AS cheapest_unit, arg_min(bill_no,(unit,mr)) AS cheapest_bill, "
                          "arg_min(supplier,(-unit,mr)) AS dearest, max(unit) AS dearest_unit, arg_min(bill_no,(-unit,mr)) AS dearest_bill FROM g GROUP BY cluster_id) "
                          f"SELECT CAST(cluster_id AS VARCHAR) AS cluster_id, label, make, {LABEL} AS model, spread, q1, q3, iqr, sd, cv, {BAND} AS cv_band, "
                          f"CASE WHEN med<>0 THEN {pct('(spread/med*100)')} ELSE '—' END AS of_median, x.* EXCLUDE (cluster_id), grade_mixed AS grades_differ, reliable "
                          "FROM c JOIN x USING (cluster_id) WHERE n>1 AND spread>0",
        "a14_agreement": f"{clusters}, s AS (SELECT cluster_id, string_agg(supplier,', ' ORDER BY f) AS suppliers FROM (SELECT cluster_id, supplier, min(mr) AS f FROM g GROUP BY ALL) GROUP BY cluster_id) "
                         f"SELECT CAST(cluster_id AS VARCHAR) AS cluster_id, label, make, {LABEL} AS model, suppliers, med, spread, {pct('(spread/med*100)')} AS tolerance, "
                         "CASE WHEN spread/med<=0.1::double THEN 'Agree (≤10%)' ELSE 'Diverge' END AS verdict FROM c JOIN s USING (cluster_id) WHERE n_suppliers>1",
        "a15_list_net": f"{lines}, t AS (SELECT bill_no AS bill, arg_min(supplier,seq) AS supplier, count(*) AS n, {esum('unit')} AS li, {esum('total')} AS ne FROM l "
                        f"WHERE contains(lower(doc_type),'estimate') AND unit<>0 AND total<>0 AND unit<>total GROUP BY bill_no) "
                        f"SELECT bill, supplier, n, {fx('li', 0)} AS list, {fx('ne', 0)} AS net, {pct('((li-ne)/li*100)')} AS discount FROM t",
        "a16_same_pn": f"{lines} SELECT npn, arg_min(part_name,seq) AS part_name, arg_min(part_number,seq) AS part_number, count(*) AS n, count(DISTINCT bill_no) AS n_bills, "
                       "min(unit)=max(unit) AS identical_price FROM l GROUP BY npn HAVING count(DISTINCT bill_no)>1",
        "a17_trend": f"{lines}, d AS (SELECT * FROM l WHERE {part}), {stats('d', 'cat')}, m AS (SELECT cat, us, n FROM s0) "
                     f"SELECT cat, s2.n, min_unit, max_unit, {fx('((us[(m.n-1)//2+1]+us[m.n//2+1])/2)', 0)} AS med FROM s2 JOIN m USING (cat) WHERE s2.n>=3 ORDER BY s2.n DESC LIMIT 6",
        "w4_trend_points": f"{lines}, d AS (SELECT * FROM l WHERE {part}), r AS (SELECT min(bill_dt) AS a, max(bill_dt) AS b FROM d), k AS (SELECT cat, min(unit) AS lo, max(unit) AS hi FROM d GROUP BY cat HAVING count(*)>=3 ORDER BY count(*) DESC LIMIT 6) "
                           "SELECT id, cat, bill_dt, unit, round(((bill_dt-a)/(b-a)*96+2)::double,6) AS x, round((90.0::double-(unit-lo)/(hi-lo)*80)::double,6) AS y FROM d JOIN k USING (cat), r",
        "a18_normalised": f"{clusters}, t AS (SELECT * FROM c WHERE n_names>1 OR n_pns>1 ORDER BY n DESC, cord LIMIT 30), "
                          "a AS (SELECT cluster_id, string_agg(part_name,'  |  ' ORDER BY f) AS names FROM (SELECT cluster_id, part_name, min(mr) AS f FROM g GROUP BY ALL) GROUP BY cluster_id), "
                          "b AS (SELECT cluster_id, string_agg(npn,'  |  ' ORDER BY f) AS pns FROM (SELECT cluster_id, npn, min(mr) AS f FROM g GROUP BY ALL) GROUP BY cluster_id) "
                          f"SELECT label, make, {LABEL} AS model, n_names, n_pns, names, pns, bridged FROM t JOIN a USING (cluster_id) JOIN b USING (cluster_id)",
        "a19_coverage": f"{lines}, k AS (SELECT CAST(i AS INTEGER) AS position, 'Brand#'||(i*2+1) AS make FROM range(17) t(i)) SELECT position, k.make, count(l.seq) AS parts, count(l.seq)=0 AS gap "
                        f"FROM k LEFT JOIN l ON l.make=k.make AND {part} GROUP BY ALL",
        "f2_ledger": f"{lines} SELECT id, make, ltype, part_name, supplier FROM l WHERE make='Brand#7' AND {part} AND contains(lower(part_name||part_number||supplier),'ring')",
        "f3_lookup": f"{clusters} SELECT CAST(cluster_id AS VARCHAR) AS cluster_id, label, make, n, med FROM c WHERE (contains(lower(label),'gear') OR "
                     "cluster_id IN (SELECT cluster_id FROM g WHERE contains(lower(part_name),'gear'))) AND cluster_id IN (SELECT cluster_id FROM g WHERE model IN ('ECONOMY','PROMO')) "
                     "AND cluster_id IN (SELECT cluster_id FROM g WHERE contains(npn,'N1')) "
                     "AND (contains(lower(label||' '||make||' '||model||' '||cat||' '||grade),'brand#1') OR cluster_id IN (SELECT cluster_id FROM g WHERE contains(lower(part_name||' '||npn||' '||part_number||' '||model),'brand#1')))",
        "f6_inflation": f"{clusters} SELECT id, part_name, c.make, {LABEL.replace('model', 'c.model').replace('n_c.models', 'n_models')} AS model, supplier, bill_no, bill_date, unit AS quoted, med, c.n AS quotes, "
                        f"'+'||{pct('((unit-med)/med*100)')} AS over FROM g JOIN c USING (cluster_id) WHERE c.n>1 AND (unit-med)/med*100>=30",
        "j6_bill_context": f"{lines} SELECT id, bill_no, count(*) OVER (PARTITION BY bill_no) AS bill_lines, {fx('t', 2)} AS bill_total FROM l JOIN (SELECT bill_no, {esum('total')} AS t FROM l GROUP BY bill_no) USING (bill_no)",
        "j8_worklist": f"{clusters}, w AS (SELECT label||'' AS label, key, min(cluster_id) OVER () AS z, row_number() OVER (PARTITION BY key ORDER BY n DESC, cord) AS rn, cluster_id, n, med, avg, make FROM c WHERE make='Brand#3') "
                       "SELECT CAST(cluster_id AS VARCHAR) AS cluster_id, label AS part, make, n AS quotes, med AS median, avg AS mean FROM w WHERE rn=1",
        "k1_assess": f"{clusters}, {ASSESS} SELECT * EXCLUDE (cid,label), CAST(cid AS VARCHAR) AS cluster_id FROM fin",
        "a20_totals": f"{clusters}, {ASSESS} SELECT claim_ref, count(*) AS lines, count(bench) AS matched, "
                      f"{fx('coalesce(' + esum('CASE WHEN bench IS NOT NULL THEN quoted END') + ',0)', 2)} AS quoted_total, {fx('coalesce(' + esum('bench') + ',0)', 2)} AS benchmark_total, "
                      f"{fx('coalesce(' + esum('CASE WHEN over>0 THEN over END') + ',0)', 2)} AS over_claim, count(*) FILTER (flagged) AS flagged, count(*) FILTER (above_bound) AS above_bound FROM fin GROUP BY claim_ref",
        "k3_evidence": f"{clusters}, {ASSESS} SELECT claim_ref, line_no AS line, fin.name AS estimate_part, g.part_name AS evidence_part, g.part_number, g.make, g.model, supplier, bill_no, bill_date, grade, unit_basis, "
                       "unit AS unit_price, 'Excel import' AS source FROM fin JOIN g ON g.cluster_id=fin.cid",
        "v2_sweep": f"{lines}, {PAIRS}, pf AS (SELECT truth, a.nn AS an, b.nn AS bn, a.tk AS ta, b.tk AS tb, {clash('a', 'b')} AS veto FROM pr "
                    f"JOIN (SELECT *, {TOKENS} FROM (SELECT DISTINCT part_name, {features('part_name')} FROM l)) a ON a.part_name=part_name_a "
                    f"JOIN (SELECT *, {TOKENS} FROM (SELECT DISTINCT part_name, {features('part_name')} FROM l)) b ON b.part_name=part_name_b), "
                    "sc AS (SELECT truth, veto, coalesce(len(list_intersect(ta,tb))::double/nullif(len(list_distinct(list_concat(ta,tb))),0),0) AS j, "
                    "CASE WHEN an='' OR bn='' THEN 0.0::double ELSE 1-levenshtein(an,bn)::double/greatest(len(an),len(bn)) END AS lv FROM pf), "
                    "gr AS (SELECT * FROM (VALUES (0.4::double),(0.6::double),(0.8::double)) w(token_weight), "
                    "(VALUES " + ",".join(f"({t}::double)" for t in (0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)) + ") t(threshold)), "
                    "ce AS (SELECT token_weight, threshold, truth, (CASE WHEN veto THEN -1.0::double ELSE token_weight*j+(1-token_weight)*lv END)>=threshold AS said FROM sc, gr), "
                    "k AS (SELECT token_weight, threshold, count(*) FILTER (said AND truth) AS tp, count(*) FILTER (said AND NOT truth) AS fp, count(*) FILTER (NOT said AND truth) AS fn, "
                    "count(*) FILTER (NOT said AND NOT truth) AS tn FROM ce GROUP BY ALL), p AS (SELECT *, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 1 END AS pp, CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END AS rr FROM k) "
                    f"SELECT token_weight, threshold, tp, fp, fn, tn, {fx('pp', 4)} AS precision, {fx('rr', 4)} AS recall, {fx('(CASE WHEN pp+rr>0 THEN 2*pp*rr/(pp+rr) ELSE 0 END)', 4)} AS f1 FROM p",
        "s8_activity": "SELECT event_id AS id, ts, event_type AS kind, CAST(trunc(value) AS BIGINT) AS count, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
        "s9_retention": "SELECT event_id AS id, event_type AS source FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn<=500",
        "s7_upsert": "SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id%3=0 THEN 'warn' ELSE 'ok' END AS status FROM events",
    }
    ingest = (
        f"{lines}, d AS (SELECT CAST(substr(bill_no,2) AS BIGINT) AS k, count(*) AS n, {esum('total')} AS t FROM l GROUP BY bill_no), "
        "e AS (SELECT *, lpad(CAST(k AS VARCHAR),12,'0') AS file_name, k%17<>0 AS good, 'Supplier '||(k%2) AS sup, CASE WHEN k%11=0 THEN '' ELSE 'b'||(k//3) END AS bn, "
        "CASE WHEN k%5=0 THEN 0.0::double WHEN k%4=0 THEN t+5000 ELSE t END AS st FROM d), "
        f"f AS (SELECT *, min(k) OVER (PARTITION BY good, sup, bn) AS fk, {fx('t', 2)} AS s FROM e), "
        f"j AS (SELECT *, CASE WHEN NOT good THEN 'failed' WHEN bn<>'' AND k>fk THEN 'duplicate' "
        f"WHEN st<>0 AND abs({fx('(s-st)', 2)})>greatest(1.0::double, st*0.005::double) THEN 'review' ELSE 'done' END AS status FROM f)"
    )
    out |= {
        "q2_ingest": ingest + " SELECT file_name, status, CASE WHEN good THEN sup END AS supplier, CASE WHEN good THEN bn END AS bill_no, CASE WHEN good THEN n ELSE 0 END AS lines, "
                     "CASE WHEN status IN ('review','done') THEN s END AS rec_sum, CASE WHEN status IN ('review','done') THEN st END AS rec_stated FROM j",
        "t1_ingest": ingest + " SELECT file_name, status, CASE WHEN good THEN sup END AS supplier, CASE WHEN good THEN bn END AS bill_no, CASE WHEN good THEN n ELSE 0 END AS lines, "
                     "CASE WHEN status IN ('review','done') AND bn<>'' THEN n END AS stored_lines FROM j",
        "t2_events": "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, event_type AS source, "
                     "CASE WHEN event_id%5=0 THEN 'done' WHEN event_id%2=1 OR event_id%3=0 THEN 'warn' ELSE 'ok' END AS status FROM events",
        "a22_run_report": ingest + " SELECT count(*) AS files_total, count(*) FILTER (status='done') AS done, count(*) FILTER (status='review') AS review, "
                          "count(*) FILTER (status='duplicate') AS duplicate, count(*) FILTER (status='failed') AS failed, "
                          "CAST(sum(n) FILTER (status IN ('done','review')) AS BIGINT) AS part_rows_exported, 0::BIGINT AS input_tokens, 0::BIGINT AS output_tokens, CAST(NULL AS DOUBLE) AS estimated_cost FROM j",
        "l4_benchmark": f"{clusters} SELECT CAST(cluster_id AS VARCHAR) AS cluster_id, label, make, n, med, avg FROM c WHERE n>1",
        "a23_batches": f"{lines} SELECT doc_type AS batch, count(*) AS lines, count(DISTINCT supplier) AS suppliers, count(DISTINCT make) AS makes, count(DISTINCT bill_no) AS bills FROM l GROUP BY doc_type",
    }
    numtxt = lambda x: f"(CASE WHEN ({x})%1=0 THEN CAST(CAST({x} AS DECIMAL(38,0)) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"
    fields = ("supplier", "bill_no", "npn", "part_name", "unit", "qty", "grade", "unit_basis")
    row = "concat_ws(chr(1)," + ",".join(f"CAST({c} AS VARCHAR)" for c in fields) + ",'unknown','false')"
    config = hashlib.sha256(json.dumps({k: v for k, v in dataclasses.asdict(MatchConfig()).items() if v is not None}, sort_keys=True).encode()).hexdigest()[:8]
    snapshot = (f"sn AS (SELECT 'BENCH-'||substr(sha256(count(*)||':'||CAST(sum(CAST(('0x'||substr(sha256({row}),1,15)) AS BIGINT)) AS VARCHAR)),1,8)||'-{config}' AS snapshot_id FROM l)")
    models = ("ml AS (SELECT cluster_id, string_agg(model,' | ' ORDER BY f) AS models FROM (SELECT cluster_id, model, min(mr) AS f FROM g WHERE model NOT IN ('','—') GROUP BY ALL) GROUP BY cluster_id)")
    held = (" SELECT bn AS bill_no, arg_min(sup,k) AS supplier, arg_min('extracted lines sum S$'||" + numtxt("s") + "||' but printed parts subtotal is S$'||" + numtxt("st")
            + "||' (diff S$'||" + numtxt(fx("(s-st)", 2)) + "||') — lines may be missing or misread',k) AS reason, CAST(sum(n) AS BIGINT) AS n FROM j WHERE status='review' GROUP BY bn")
    again = (ingest.replace("THEN 'duplicate' ", "OR (bn<>'' AND EXISTS (SELECT 1 FROM e e2 WHERE e2.k%7=0 AND e2.k%11<>0 AND e2.sup=f.sup AND 'b'||(e2.k//3)=f.bn)) THEN 'duplicate' "))
    pts = ("r AS (SELECT min(bill_dt) AS a, max(bill_dt) AS b FROM d), k AS (SELECT cat, min(unit) AS lo, max(unit) AS hi FROM d GROUP BY cat HAVING count(*)>=3) "
           "SELECT id, cat, bill_dt, unit, round(((bill_dt-a)/(b-a)*96+2)::double,6) AS x, round((90.0::double-(unit-lo)/(hi-lo)*80)::double,6) AS y FROM d JOIN k USING (cat), r")
    facts = [("Claim reference", "claim_ref"), ("Generated", "'2001-08-02'"), ("Generated by", "'pricebench'"), ("Benchmark snapshot", "(SELECT snapshot_id FROM sn)"),
             ("Reference dataset", f"(SELECT count(DISTINCT bill_no)||' invoices · '||count(*) FILTER ({part})||' usable supplier-part lines' FROM l)"),
             ("Matching mode", q(MatchConfig().mode_label())), ("Similarity threshold", "'0.65'"), ("Token weight", "'0.6'"), ("Same make required", "'yes'"), ("Same model required", "'no'"),
             ("Grades kept separate", "'yes'"), ("Front/rear kept separate", "'yes (always)'"), ("LH/RH kept separate", "'no'"), ("Min quotes for reliable spread", "'4'"),
             ("Inflation flag threshold", "'+30% over median'"), ("Lines assessed", "CAST(lines AS VARCHAR)"), ("Lines matched to a benchmark", "CAST(matched AS VARCHAR)"),
             ("Quoted total (matched lines), S$", numtxt("quoted_total")), ("Benchmark total (matched lines), S$", numtxt("benchmark_total")), ("Potential over-claim, S$", numtxt("over_claim")),
             ("Lines flagged", "CAST(flagged AS VARCHAR)"), ("Lines above statistical bound (Q3 + 1.5·IQR)", "CAST(above_bound AS VARCHAR)"), ("Note", q(NOTE))]
    claim_totals = out["a20_totals"].split("SELECT claim_ref, count(*) AS lines", 1)
    listed = ", ".join("{'position':" + str(i + 1) + ",'field':" + q(f) + ",'value':" + v + "}" for i, (f, v) in enumerate(facts))
    out |= {
        "s3_invoice_lines": ingest + " SELECT bn AS bill_no, part_name, npn, qty, unit, total, status='review' AS review FROM j JOIN l ON CAST(substr(l.bill_no,2) AS BIGINT)=k WHERE status IN ('done','review')",
        "a11_review": ingest + held,
        "q6_fingerprint": f"{lines}, {snapshot} SELECT snapshot_id FROM sn",
        "k2_lines": f"{clusters}, {ASSESS}, {models} SELECT claim_ref, line_no AS line, pn AS part_no, fin.name AS description, quoted, how AS matched_via, CASE WHEN how<>'no match' THEN score END AS match_score, "
                    "coalesce(c.label,'no match') AS benchmark, c.make, CASE WHEN c.model_mixed THEN models ELSE c.model END AS model, "
                    "CASE WHEN cid IS NOT NULL THEN CASE WHEN c.bridged THEN 'name-bridged (≈)' ELSE 'part number' END END AS cluster_basis, c.grade, c.unit_basis, CASE WHEN cid IS NOT NULL THEN fin.n END AS quotes, "
                    f"c.n_suppliers AS suppliers, bench AS median, CASE WHEN cid IS NOT NULL THEN {numtxt('c.q1')}||'-'||{numtxt('c.q3')} END AS iqr_band, upper_bound, CASE WHEN above_bound THEN 'YES' END AS above_bound, "
                    "c.min_unit AS evidence_min, c.max_unit AS evidence_max, CASE WHEN cid IS NOT NULL THEN CASE WHEN c.n_dated=0 THEN '—' WHEN c.n_dated=1 THEN strftime(c.first_date,'%d/%m/%Y') "
                    "ELSE strftime(c.first_date,'%d/%m/%Y')||' – '||strftime(c.last_date,'%d/%m/%Y') END END AS evidence_dates, over AS variance, over_pct AS variance_pct, CASE WHEN flagged THEN 'YES' END AS flagged "
                    "FROM fin LEFT JOIN c ON c.cluster_id=cid LEFT JOIN ml ON ml.cluster_id=cid",
        "a24_summary": f"{claim_totals[0]}, {snapshot}, tt AS (SELECT claim_ref, count(*) AS lines{claim_totals[1]}), un AS (SELECT claim_ref, unnest([{listed}]) AS x FROM tt) "
                       "SELECT claim_ref, x.position AS position, x.field AS field, x.value AS value FROM un",
        # The list is full of pairs of 0.9 and more on any of the given tables, so the statement looks no lower.
        "v1_pairs": f"{lines}, p AS (SELECT * FROM l WHERE {part}), nn AS (SELECT *, {TOKENS} FROM (SELECT DISTINCT part_name, {features('part_name').split(', CASE')[0]} FROM p)), "
                    "pn AS (SELECT p.*, nn.nn, nn.tk FROM p JOIN nn USING (part_name)), nd AS (SELECT DISTINCT make, nn, tk FROM pn WHERE nn<>''), "
                    f"sc AS (SELECT x.make, x.nn AS an, y.nn AS bn, {sim('x', 'y')} AS s FROM nd x JOIN nd y ON x.make=y.make WHERE {sim('x', 'y')}>=0.9::double), "
                    "pr AS (SELECT s, a.seq AS i, b.seq AS j, a.npn<>'' AND a.npn=b.npn AS twin FROM sc JOIN pn a ON a.make=sc.make AND a.nn=sc.an JOIN pn b ON b.make=sc.make AND b.nn=sc.bn AND a.seq<b.seq), "
                    "top AS (SELECT *, row_number() OVER (ORDER BY s DESC, i, j) AS pair_id FROM pr QUALIFY pair_id<=600) "
                    f"SELECT CAST(pair_id AS INTEGER) AS pair_id, {fx('s', 4)} AS similarity, CASE WHEN twin THEN 'y (auto)' ELSE '' END AS label, a.part_name AS part_name_a, a.part_number AS part_number_a, a.supplier AS supplier_a, a.unit AS unit_a, "
                    "b.part_name AS part_name_b, b.part_number AS part_number_b, b.supplier AS supplier_b, b.unit AS unit_b, a.make, a.cat AS category_a, b.cat AS category_b FROM top JOIN l a ON a.seq=i JOIN l b ON b.seq=j",
        "w4_points_all": f"{lines}, d AS (SELECT * FROM l WHERE {part}), " + pts,
        "a17_trend_all": out["a17_trend"].replace(" LIMIT 6", ""),
        "a18_values_all": f"{clusters}, w AS (SELECT cluster_id, 'name' AS kind, part_name AS value FROM g UNION ALL SELECT cluster_id, 'pn', npn FROM g WHERE npn<>'') "
                          "SELECT label, make, c.n AS quotes, kind, value, count(*) AS n FROM c JOIN w USING (cluster_id) WHERE n_names>1 OR n_pns>1 GROUP BY c.cluster_id, label, make, c.n, kind, value",
        "l4_benchmark_all": f"{clusters} SELECT CAST(cluster_id AS VARCHAR) AS cluster_id, label, make, n, med, avg FROM c",
        "e_written": """WITH k AS (SELECT p_partkey, p_type, ['toyota ','MERC','vw','B.M.W.','Unknown','','Mercedes Benz','kia','Acme'][p_partkey%9+1] AS w,
             ['MBN','HY','8K','VN9','M93','MK1','T12345','513','ZZ'][p_partkey%7+p_partkey%3+1]||p_partkey AS raw FROM part),
             n AS (SELECT *, regexp_replace(raw,'9{3,}$','') AS npn FROM k),
             c AS (SELECT *, CASE trim(w) WHEN 'toyota' THEN 'Toyota' WHEN 'MERC' THEN 'Mercedes-Benz' WHEN 'vw' THEN 'Volkswagen' WHEN 'B.M.W.' THEN 'BMW' WHEN 'Unknown' THEN 'Unknown'
               WHEN '' THEN 'Unknown' WHEN 'Mercedes Benz' THEN 'Mercedes-Benz' WHEN 'kia' THEN 'Kia' ELSE 'Acme' END AS canonical FROM n)
             SELECT p_partkey, npn, canonical, CASE WHEN canonical<>'Unknown' THEN canonical WHEN npn LIKE 'MBN%' THEN 'Mercedes-Benz' WHEN npn LIKE 'HY%' THEN 'Hyundai' WHEN npn LIKE '8K%' THEN 'Audi'
               WHEN npn LIKE 'VN9%' THEN 'Volkswagen' WHEN npn LIKE '513%' THEN 'BMW' WHEN npn LIKE 'M93%' THEN 'Chevrolet' WHEN npn LIKE 'MK1%' THEN 'Mitsubishi Fuso' WHEN npn LIKE 'T12345%' THEN 'Toyota' ELSE 'Unknown' END AS make,
             CASE p_partkey%4 WHEN 0 THEN 'incl' WHEN 1 THEN 'excl' ELSE 'unknown' END AS gst, lower(p_type) AS model, p_partkey*1.5::double AS amount,
             CASE p_partkey%3 WHEN 0 THEN DATE '2021-03-03' WHEN 1 THEN make_date(2021,2,p_partkey%28+1) END AS bill_dt,
             CASE p_partkey%3 WHEN 0 THEN 'Labour' WHEN 1 THEN 'Repair Estimate' ELSE 'Supplier Part' END AS ltype FROM c""",
        "e22_claim_lines": f"{lines}, {CLAIMS} SELECT claim_ref, line_no, CASE WHEN line_no%2=0 THEN '' WHEN part_no='' THEN 'none' ELSE part_no END AS part_no, "
                           "name, round(quoted,2) AS quoted, CASE WHEN line_no%2=0 THEN '' ELSE make END AS make FROM cl",
        "s16_upgraded": f"{lines} SELECT id, CASE WHEN seq%2=0 THEN make ELSE 'Unknown' END AS make, npn, cat, ltype, qty, unit, total, grade, unit_basis, 'unknown' AS gst, false AS review FROM l",
        "q4_accepted": f"{lines}, h AS (SELECT *, CAST(substr(bill_no,2) AS BIGINT) AS k FROM l) SELECT id, k%7=1 AND k<>1 AS review, CASE WHEN k%7=1 AND k<>1 THEN 'check' ELSE '' END AS review_reason FROM h",
        "q5_discarded": f"{lines}, h AS (SELECT *, CAST(substr(bill_no,2) AS BIGINT) AS k FROM l) SELECT id, k%7=1 AS review FROM h WHERE k<>1",
        "f1_usable_held": f"{lines} SELECT id, ltype FROM l WHERE {part} AND CAST(substr(bill_no,2) AS BIGINT)%7<>1",
        "f5_by_kind": "SELECT event_id AS id, event_type AS kind, CAST(trunc(value) AS BIGINT) AS count FROM events WHERE event_type='click'",
        "u1_appended": f"{lines} SELECT id, make, total FROM l UNION ALL SELECT id, NULL, total FROM l WHERE seq%2=0",
        "u3_options": f"{lines} SELECT DISTINCT model FROM l WHERE make='Brand#7'",
        "v3_points": f"WITH cells AS ({out['v2_sweep']}) SELECT * FROM (SELECT 'best f1' AS point, * FROM cells ORDER BY f1 DESC, token_weight, threshold LIMIT 1) "
                     "UNION ALL SELECT * FROM (SELECT 'precision >= 0.5' AS point, * FROM cells WHERE precision>=0.5 ORDER BY recall DESC, token_weight, threshold LIMIT 1)",
        "f11_to_read": ingest + ", x AS (SELECT *, CASE WHEN good THEN k%3=0 AND k%2=1 ELSE (SELECT count(*)>0 FROM e WHERE NOT good AND k%3=0 AND k%2=1) END AS known FROM j) "
                       "SELECT file_name, CASE WHEN k%2000>1000 THEN 'failed' ELSE 'read' END AS verdict FROM x WHERE k%2000>1000 OR NOT known",
        "q1_findings": ingest + " SELECT file_name, 'error' AS kind, 'response is not a JSON object' AS text FROM j WHERE NOT good "
                       "UNION ALL SELECT file_name, 'warning', 'bill_no is empty — duplicate detection is impossible for this bill' FROM j WHERE good AND bn='' "
                       "UNION ALL SELECT file_name, 'warning', 'doc_type \"Receipt\" is not in the schema — coerced to \"Tax Invoice\"' FROM j WHERE good AND k%13=0",
        "s1_sheets": f"{lines} SELECT part_name, part_number, npn, supplier, bill_no, total, qty, unit FROM l",
        "s5_store": f"{lines} SELECT id, CASE WHEN seq%10=0 THEN 'second' WHEN seq%5=0 THEN 'again' ELSE supplier END AS supplier, true AS own_place FROM l WHERE seq%3<>0 OR seq%5=0",
        "q2_ingest_stored": again + " SELECT '/in/'||file_name AS path, status, CAST(CASE WHEN good THEN 0 ELSE 1 END AS INTEGER) AS n_errors, "
                            "CAST(CASE WHEN NOT good THEN 0 ELSE (bn='')::INT + (k%13=0)::INT END AS INTEGER) AS n_warnings FROM j",
    }
    return out
