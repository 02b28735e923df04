"""Queries of recency, scorecards, index, vehicles, outcomes and tax, with their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from oracle_queries import EXACT, LINES, USABLE, _rank, esum, fx, q, stats
from pricebench import MatchConfig
from pricebench.functions import tax, vehicles
from pricebench.operators import outcomes as O, price_index, recency, scorecard
from pricebench.operators.clusters import price_summary
from pricebench.sources.star import read_table

AS_OF = "1998-08-02"
WEIGHTED = MatchConfig(mode="exact-pn", as_of=AS_OF, half_life_months=24)
WINDOW = MatchConfig(mode="exact-pn", as_of=AS_OF, window_months=24)
#: Bills are moved so many years on, into the time of the tax rates.
LATER = 27


def _some_undated(rows: DataFrame) -> DataFrame:
    """Every eleventh line has no date, and one part in seventeen none at all."""
    part = F.substring("npn", 3, 20).cast("long")
    return rows.withColumn("bill_dt", F.when((F.col("seq") % 11 == 0) | (part % 17 == 0), None).otherwise(F.col("bill_dt")))


def _taxed(lines: DataFrame) -> DataFrame:
    """Lines of later years, of which most include tax; some undated, some from before the first rate."""
    seq = F.col("seq")
    years = F.when(seq % 19 == 0, 5).otherwise(LATER)
    return lines.withColumns({
        "gst": F.element_at(F.array(*[F.lit(x) for x in ("incl", "incl", "excl", "unknown")]), (seq % 4 + 1).cast("int")),
        "bill_dt": F.when(seq % 13 == 0, None).otherwise(F.add_months("bill_dt", years * 12))})


def _chassis(spark: SparkSession, folder: str) -> DataFrame:
    """Chassis texts of every part: right and wrong check characters, other ways of writing, plates, short numbers, unknown makers."""
    k = F.col("p_partkey").cast("long")
    codes = [*sorted(vehicles.MAKER_CODES), "1G1", "ZFA"]
    code = F.element_at(F.array(*[F.lit(c if len(c) == 3 else c + "D") for c in codes]), (k % len(codes) + 1).cast("int"))
    body = F.concat(code, F.lpad((k * 7919 % 99991).cast("string"), 5, "B"))
    number = F.concat(body, F.lit("0"), F.lit("X"), F.lpad((k * 31).cast("string"), 7, "0"))
    right = F.concat(body, vehicles.check_digit(number), F.substring(number, 10, 8))
    written = (F.when(k % 7 == 0, F.concat(F.lit("SGX"), k.cast("string"))).when(k % 7 == 1, F.lower(right)).when(k % 7 == 2, F.concat(F.substring(right, 1, 3), F.lit("-"), F.substring(right, 4, 14)))
               .when(k % 7 == 3, number).when(k % 7 == 4, F.substring(right, 1, 16)).when(k % 7 == 5, F.lit("")).otherwise(right))
    number = F.when(k % 5 == 0, F.lit("HY12")).otherwise(F.lit("ZZ9"))
    return read_table(spark, folder, "part").select(k.alias("part"), written.alias("chassis"), F.when(k % 3 == 0, "toyota").otherwise("").alias("bill_make"), number.alias("npn"), "p_type")


def _vehicles(spark: SparkSession, folder: str) -> DataFrame:
    rows = _chassis(spark, folder).withColumn("vin", vehicles.vin(F.col("chassis")))
    return rows.select("part", "vin", F.coalesce(vehicles.check_ok(F.col("vin")), F.lit(False)).alias("check_ok"), vehicles.make_of_vin(F.col("vin")).alias("vin_make"),
                       vehicles.make_of_line(F.col("npn"), F.col("bill_make"), F.col("chassis")).alias("make"), vehicles.chassis_model_key(F.col("chassis"), F.col("p_type")).alias("model_key"))


KINDS = ("saved", "offered", "negotiated", "paid", "disputed", "reopened", "noise")


def _events(lines: DataFrame) -> DataFrame:
    """Up to nine events of each estimate line, out of order, with equal times and repeated ids."""
    seq, i = F.col("seq"), F.col("i")
    rows = lines.where("ltype = 'Repair Estimate'").withColumn("i", F.explode(F.sequence(F.lit(0), (seq % 9).cast("int"))))
    kind = F.when(i == 3, "saved").otherwise(F.element_at(F.array(*[F.lit(x) for x in KINDS]), ((seq * 3 + i * 5 + i * i) % 7 + 1).cast("int")))
    return rows.select(
        F.col("bill_no").alias("claim_ref"), seq.alias("line_no"), F.concat(F.lit("e"), i % 7).alias("event_id"),
        F.date_add(F.lit("2001-01-01").cast("date"), ((seq * 31 + i * 17) % 50).cast("int")).cast("timestamp").alias("at"), kind.alias("kind"),
        F.when(i % 2 == 0, F.col("unit") * (F.lit(80.0) + i) / 100.0).alias("amount"))


def _assessed(lines: DataFrame) -> DataFrame:
    """Estimate lines beside the benchmark of their part number."""
    bench = price_summary(lines.where("ltype = 'Supplier Part'"), ["npn"], "unit").select("npn", F.col("med").alias("bench"), F.when(F.col("reliable"), F.col("upper_fence")).alias("bound"))
    rows = lines.where("ltype = 'Repair Estimate'").join(bench, "npn", "left")
    return rows.select(F.col("bill_no").alias("claim_ref"), F.col("seq").alias("line_no"), F.col("unit").alias("quoted"), "bench", (F.col("unit") > F.col("bound")).alias("above_bound"))


def queries(lines: Callable, grouped: Callable) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    parts = lambda s, d: grouped(s, d, MatchConfig(mode="exact-pn"))
    history = lambda s, d: O.histories(_events(lines(s, d)))
    return {
        "r_weighted_median": lambda s, d: recency.recency_benchmark(_some_undated(parts(s, d)), WEIGHTED),
        "r_window": lambda s, d: recency.recency_benchmark(_some_undated(parts(s, d)), WINDOW),
        "r_scorecard": lambda s, d: scorecard.scorecards(parts(s, d)),
        "r_scorecard_evidence": lambda s, d: scorecard.evidence(parts(s, d)),
        "r_index": lambda s, d: price_index.chained_index(parts(s, d), ("make", "grade")),
        "r_vin": _vehicles,
        "r_outcomes": lambda s, d: O.outcomes(history(s, d)),
        "r_outcome_intervals": lambda s, d: O.intervals(history(s, d)),
        "r_case_report": lambda s, d: O.case_report(_assessed(lines(s, d)), O.outcomes(history(s, d))),
        "r_portfolio": lambda s, d: O.portfolio(_assessed(lines(s, d)), O.outcomes(history(s, d))),
        "r_ex_gst": lambda s, d: tax.with_tax_columns(_taxed(lines(s, d))).select("id", "unit_ex", "gst_flag"),
        "r_ex_gst_flags": lambda s, d: tax.flag_counts(_taxed(lines(s, d))),
        "r_ex_gst_benchmark": lambda s, d: price_summary(tax.priced(_taxed(lines(s, d)).where("ltype = 'Supplier Part'"), True), ["npn"], "unit").select("npn", "n", "med", "iqr"),
    }


_AGE = f"CASE WHEN bd IS NOT NULL THEN greatest((year(DATE '{AS_OF}')-year(bd))*12+month(DATE '{AS_OF}')-month(bd)-(day(DATE '{AS_OF}')<day(bd))::INT,0) END"
_MED = "(us[(len(us)-1)//2+1]+us[len(us)//2+1])/2"


def _recency_sql(used: str, weight: str) -> str:
    return f"""WITH {EXACT},
d AS (SELECT cluster_id, unit, CASE WHEN seq%11=0 OR substr(npn,3)::BIGINT%17=0 THEN NULL ELSE bill_dt END AS bd FROM g),
ag AS (SELECT *, {_AGE} AS age FROM d),
us0 AS (SELECT *, {used} AS used FROM ag),
w0 AS (SELECT *, CASE WHEN used AND bd IS NOT NULL THEN {weight} END AS w1 FROM us0),
w AS (SELECT *, CASE WHEN NOT used THEN NULL ELSE coalesce(w1, min(w1) OVER (PARTITION BY cluster_id), 1000000000) END AS wt FROM w0),
c AS (SELECT *, sum(wt) OVER (PARTITION BY cluster_id ORDER BY unit) AS cum, sum(wt) OVER (PARTITION BY cluster_id) AS total FROM w WHERE used),
m AS (SELECT cluster_id, min(unit) FILTER (2*cum>=total) AS low, min(unit) FILTER (2*cum>total) AS high, max(total)::BIGINT AS weight, list_sort(list(unit)) AS us FROM c GROUP BY 1),
n AS (SELECT cluster_id, count(*) AS n, count(*) FILTER (used) AS n_used, count(*) FILTER (bd IS NULL) AS n_undated, min(age) FILTER (used) AS newest_months, max(age) FILTER (used) AS oldest_months,
  list_sort(list(unit)) AS all_us FROM w GROUP BY 1)
SELECT cluster_id, n, n_used, n_undated, newest_months, oldest_months, weight, {fx('low', 2)} AS med_low, {fx('((low+high)/2)', 2)} AS med, {fx(f'({_MED})', 2)} AS med_raw,
  {fx('((all_us[(n-1)//2+1]+all_us[n//2+1])/2)', 2)} AS med_all FROM n LEFT JOIN m USING (cluster_id)"""


_OTHERS = f"""WITH {EXACT},
cs AS (SELECT cluster_id, supplier FROM g GROUP BY ALL),
cn AS (SELECT cluster_id, count(*) AS cnt, count(DISTINCT supplier) AS k FROM g GROUP BY 1),
o AS (SELECT cs.cluster_id, cs.supplier, list_sort(list(g.unit)) AS us FROM cs JOIN cn USING (cluster_id) JOIN g ON g.cluster_id=cs.cluster_id AND g.supplier<>cs.supplier WHERE cnt>=4 AND k>1 GROUP BY ALL),
om AS (SELECT cluster_id, supplier, {_MED} AS others FROM o),
cmp AS (SELECT g.*, others, (unit-others)/others*100 AS dev FROM g JOIN om USING (cluster_id, supplier) WHERE others<>0)"""

_CHAIN = f"""WITH RECURSIVE {EXACT},
qm0 AS (SELECT make, grade, cluster_id, year(bill_dt)*4+quarter(bill_dt)-1 AS quarter, list_sort(list(unit)) AS us FROM g GROUP BY ALL),
qm AS (SELECT make, grade, cluster_id, quarter, {_MED} AS med FROM qm0 WHERE {_MED}>0),
ra AS (SELECT y.make, y.grade, y.quarter, list_sort(list(y.med/x.med)) AS us FROM qm y JOIN qm x ON x.make=y.make AND x.grade=y.grade AND x.cluster_id=y.cluster_id AND x.quarter=y.quarter-1 GROUP BY ALL),
st AS (SELECT make, grade, quarter, len(us) AS matched, {_MED} AS step FROM ra),
sp AS (SELECT make, grade, min(quarter)-1 AS first FROM st WHERE matched>=3 GROUP BY ALL),
la AS (SELECT make, grade, max(quarter) AS last FROM qm GROUP BY ALL),
ix(make, grade, quarter, last, idx, step, matched, thin) AS (SELECT make, grade, first, last, 100.0::DOUBLE, NULL::DOUBLE, NULL::BIGINT, false FROM sp JOIN la USING (make, grade) UNION ALL
  SELECT ix.make, ix.grade, ix.quarter+1, last, ix.idx*coalesce(CASE WHEN st.matched>=3 THEN st.step END,1.0), CASE WHEN st.matched>=3 THEN st.step END, coalesce(st.matched,0), NOT coalesce(st.matched>=3,false)
  FROM ix LEFT JOIN st ON st.make=ix.make AND st.grade=ix.grade AND st.quarter=ix.quarter+1 WHERE ix.quarter<last)
SELECT make, grade, quarter, (quarter//4)||'-Q'||(quarter%4+1) AS label, {fx('idx', 4)} AS index, step, matched, thin FROM ix"""

_CODES = [*sorted(vehicles.MAKER_CODES), "1G1", "ZFA"]
_LIST = "[" + ",".join(q(c if len(c) == 3 else c + "D") for c in _CODES) + "]"
_VALUE = " ".join(f"WHEN '{a}' THEN {v}" for a, v in zip(vehicles.VIN_LETTERS, vehicles.VIN_VALUES))


def _check(number: str) -> str:
    at = "+".join(f"(CASE substr({number},{i + 1},1) {_VALUE} ELSE substr({number},{i + 1},1)::INT END)*{w}" for i, w in enumerate(vehicles.VIN_WEIGHTS) if w)
    return f"CASE ({at})%11 WHEN 10 THEN 'X' ELSE (({at})%11)::VARCHAR END"


_VIN = f"""WITH p AS (SELECT p_partkey::BIGINT AS k, p_type, {_LIST}[(p_partkey%{len(_CODES)}+1)::INT] || lpad((p_partkey*7919%99991)::VARCHAR,5,'B') AS body FROM part),
n AS (SELECT *, body||'0X'||lpad((k*31)::VARCHAR,7,'0') AS number FROM p),
r AS (SELECT *, body||{_check('number')}||substr(number,10,8) AS good FROM n),
c AS (SELECT *, CASE k%7 WHEN 0 THEN 'SGX'||k WHEN 1 THEN lower(good) WHEN 2 THEN substr(good,1,3)||'-'||substr(good,4,14) WHEN 3 THEN number WHEN 4 THEN substr(good,1,16) WHEN 5 THEN '' ELSE good END AS chassis FROM r),
v AS (SELECT *, CASE WHEN regexp_full_match(replace(upper(chassis),'-',''),'[A-HJ-NPR-Z0-9]{{17}}') THEN replace(upper(chassis),'-','') END AS vin FROM c),
m AS (SELECT *, CASE {' '.join(f"WHEN starts_with(vin,'{c}') THEN '{m}'" for c, m in sorted(vehicles.MAKER_CODES.items(), key=lambda x: -len(x[0])))} END AS vin_make FROM v)
SELECT k AS part, vin, coalesce(substr(vin,9,1)=({_check('vin')}),false) AS check_ok, vin_make, CASE WHEN k%3=0 THEN 'Toyota' ELSE coalesce(vin_make, CASE WHEN k%5=0 THEN 'Hyundai' ELSE 'Unknown' END) END AS make,
  coalesce(substr(vin,1,8),p_type) AS model_key FROM m"""

_STEP = " ".join(f"WHEN r.state={q(a)} AND e.kind={q(k)} THEN {q(b)}" for k, t in O.TRANSITIONS.items() for a, b in t.items())
_HISTORY = f"""WITH RECURSIVE {LINES},
ev AS (SELECT bill_no AS claim_ref, seq AS line_no, 'e'||(i%7) AS event_id, (DATE '2001-01-01'+((seq*31+i*17)%50)::INT)::TIMESTAMP AS ts,
  CASE WHEN i=3 THEN 'saved' ELSE {'[' + ','.join(map(q, KINDS)) + ']'}[((seq*3+i*5+i*i)%7+1)::INT] END AS kind, CASE WHEN i%2=0 THEN unit*(80.0::DOUBLE+i)/100.0::DOUBLE END AS amount
  FROM (SELECT *, unnest(range(seq%9+1)) AS i FROM l WHERE ltype='Repair Estimate')),
on1 AS (SELECT *, row_number() OVER (PARTITION BY claim_ref, line_no, event_id ORDER BY ts, kind, amount NULLS FIRST) AS k FROM ev),
e AS (SELECT *, row_number() OVER (PARTITION BY claim_ref, line_no ORDER BY ts, event_id) AS nth FROM on1 WHERE k=1),
r(claim_ref, line_no, nth, ts, amount, state, accepted) AS (SELECT DISTINCT claim_ref, line_no, 0::BIGINT, NULL::TIMESTAMP, NULL::DOUBLE, 'none', false FROM e UNION ALL
  SELECT e.claim_ref, e.line_no, e.nth, e.ts, e.amount, CASE {_STEP} ELSE r.state END, (CASE {_STEP} END) IS NOT NULL FROM r JOIN e ON e.claim_ref=r.claim_ref AND e.line_no=r.line_no AND e.nth=r.nth+1),
fin AS (SELECT claim_ref, line_no, coalesce(arg_max(state,nth) FILTER (accepted),'none') AS state, max(ts) FILTER (accepted) AS since, arg_max(amount,nth) FILTER (accepted AND amount IS NOT NULL) AS amount,
  count(*) FILTER (accepted) AS events, count(*) FILTER (NOT accepted AND nth>0) AS passed_over FROM r GROUP BY ALL)"""
_CLOSED = f"""{_HISTORY}, {USABLE}, {stats('u', 'npn')},
asd AS (SELECT bill_no AS claim_ref, seq AS line_no, l.unit AS quoted, s2.med AS bench, coalesce(l.unit>CASE WHEN reliable THEN upper_fence END,false) AS above FROM l LEFT JOIN s2 USING (npn) WHERE ltype='Repair Estimate'),
cl AS (SELECT asd.*, coalesce(amount, CASE WHEN state='paid as quoted' THEN quoted END) AS final FROM asd JOIN fin USING (claim_ref, line_no) WHERE state IN ('negotiated','paid as quoted'))"""

_TAXED = f"""t AS (SELECT * EXCLUDE (bill_dt), ['incl','incl','excl','unknown'][(seq%4+1)::INT] AS gst,
  CASE WHEN seq%13=0 THEN NULL ELSE (bill_dt+to_years(CASE WHEN seq%19=0 THEN 5 ELSE {LATER} END::INT))::DATE END AS bill_dt FROM l),
x AS (SELECT *, CASE WHEN gst='incl' THEN unit/(1.0::DOUBLE+(CASE WHEN bill_dt>=DATE '2007-07-01' AND bill_dt<DATE '2023-01-01' THEN 7 WHEN bill_dt>=DATE '2023-01-01' AND bill_dt<DATE '2024-01-01' THEN 8 ELSE 9 END)::DOUBLE/100.0::DOUBLE) ELSE unit END AS unit_ex,
  CASE WHEN gst='unknown' THEN 'unknown' WHEN gst='incl' AND bill_dt IS NULL THEN 'undated' WHEN gst='incl' AND bill_dt<DATE '2007-07-01' THEN 'before rates' ELSE '' END AS gst_flag FROM t)"""


def oracles() -> dict[str, str]:
    n_us = "(SELECT *, len(us) AS n FROM sq)"
    return {
        "r_weighted_median": _recency_sql("true", "greatest(1, round(pow(0.5::DOUBLE, age/24.0::DOUBLE)*1000000000))::BIGINT"),
        "r_window": _recency_sql("coalesce(age<24,false)", "1000000000::BIGINT"),
        "r_scorecard": f"""{_OTHERS},
sq AS (SELECT supplier, count(*) AS lines, count(DISTINCT cluster_id) AS clusters, count(DISTINCT make) AS makes, count(DISTINCT cat) AS cats, count(*) FILTER (grade<>'Unknown') AS known_grades, list_sort(list(dev)) AS us FROM cmp GROUP BY 1),
al AS (SELECT supplier, count(*) AS quotes FROM g GROUP BY 1),
sc AS (SELECT *, {_rank(0.25)} AS q1, {_MED} AS med, {_rank(0.75)} AS q3 FROM {n_us})
SELECT supplier, lines, clusters, makes, cats, known_grades, lines/quotes AS coverage, {fx('med', 2)} AS premium_pct, {fx('(q3-q1)', 2)} AS premium_iqr,
  CASE WHEN med>15 THEN 'red' WHEN med>5 THEN 'amber' WHEN med< -5 THEN 'below' ELSE 'neutral' END AS band, lines<5 AS advisory FROM sc JOIN al USING (supplier)""",
        "r_scorecard_evidence": f"""{_OTHERS}, ev AS (SELECT supplier, cluster_id, count(*) AS lines, any_value(others) AS oth, list_sort(list(unit)) AS us FROM cmp GROUP BY ALL)
SELECT supplier, cluster_id, lines, {fx(f'({_MED})', 2)} AS own, {fx('oth', 2)} AS others, {fx(f'((({_MED})-oth)/oth*100)', 2)} AS deviation FROM ev""",
        "r_index": _CHAIN,
        "r_vin": _VIN,
        "r_outcomes": f"{_HISTORY} SELECT * FROM fin",
        "r_outcome_intervals": f"{_HISTORY} SELECT claim_ref, line_no, state, ts AS since, lead(ts) OVER (PARTITION BY claim_ref, line_no ORDER BY nth) AS until FROM r WHERE accepted",
        "r_case_report": f"""{_CLOSED} SELECT claim_ref, count(*) AS closed, count(*) FILTER (final IS NULL) AS unpriced, {esum('CASE WHEN final IS NOT NULL THEN quoted END')} AS estimate, {esum('bench')} AS benchmark,
  {esum('final')} AS final, {esum('greatest(quoted-final, 0.0*final)')} AS realised, {esum('CASE WHEN final IS NOT NULL THEN abs(bench-final) END')}*100/nullif({esum('CASE WHEN bench IS NOT NULL THEN final END')},0) AS benchmark_error FROM cl GROUP BY 1""",
        "r_portfolio": f"""{_CLOSED}, cs AS (SELECT claim_ref, count(*) AS lines, count(*) FILTER (above) AS fl, count(*) FILTER (above AND final<quoted) AS fld, count(*) FILTER (NOT above) AS ot, count(*) FILTER (NOT above AND final<quoted) AS otd,
  {esum('quoted')} AS estimate, {esum('final')} AS final, {esum('greatest(quoted-final,0.0)')} AS realised, {esum('greatest(quoted-bench,0.0)')} AS potential FROM cl WHERE final IS NOT NULL GROUP BY 1),
tt AS (SELECT count(*) AS cases, coalesce(sum(lines),0)::BIGINT AS lines, {esum('estimate')} AS estimate, {esum('final')} AS final, {esum('realised')} AS realised, {esum('potential')} AS potential,
  coalesce(sum(fl),0)::BIGINT AS flagged, sum(fld) AS fld, sum(ot) AS ot, sum(otd) AS otd FROM cs)
SELECT cases, lines, estimate, final, realised, potential, (estimate-final)*100/final AS inflation, flagged, fld/nullif(flagged,0) AS flagged_down, otd/nullif(ot,0) AS others_down, cases<10 AS advisory FROM tt""",
        "r_ex_gst": f"WITH {LINES}, {_TAXED} SELECT id, unit_ex, gst_flag FROM x",
        "r_ex_gst_flags": f"WITH {LINES}, {_TAXED} SELECT gst, gst_flag, count(*) AS lines FROM x GROUP BY ALL",
        "r_ex_gst_benchmark": f"WITH {LINES}, {_TAXED}, u AS (SELECT npn, unit_ex AS unit FROM x WHERE ltype='Supplier Part'), {stats('u', 'npn')} SELECT npn, n, med, iqr FROM s2",
    }
