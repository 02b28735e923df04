import datetime as dt
import random
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from pricebench import MatchConfig
from pricebench.functions import tax, vehicles
from pricebench.operators import outcomes as O, price_index, recency, scorecard
from pricebench.operators.fingerprint import snapshot_id


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_ages_and_weights(spark):
    as_of = dt.date(2026, 7, 15)
    days = [("2026-07-15", 0), ("2026-06-16", 0), ("2026-06-15", 1), ("2024-07-15", 24), ("2025-12-31", 6), ("2027-01-01", 0), (None, None)]
    df = spark.createDataFrame([(d and dt.date.fromisoformat(d), a) for d, a in days], "d date, want int")
    rows = df.select("want", recency.age_months(F.col("d"), as_of).alias("age")).withColumn("w", recency.recency_weight(F.col("age"), 24)).collect()
    assert [r.age for r in rows] == [r.want for r in rows]
    assert rows[0].w == 10**9 and rows[3].w == 5 * 10**8 and rows[-1].w is None
    assert one(spark, recency.recency_weight(F.lit(10_000), 1)) == (1,)  # never nothing


def by_hand(pairs):
    pairs, total, cum, low, high = sorted(pairs), sum(w for _, w in pairs), 0, None, None
    for v, w in pairs:
        cum += w
        low = v if low is None and 2 * cum >= total else low
        high = v if high is None and 2 * cum > total else high
    return low, high, (low + high) / 2, total


def test_weighted_medians_agree_with_walking_the_sorted_quotes(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([0.0, -3.5, 1.0, 1.01, 1.02, 250.0, rng.uniform(1, 900)]), rng.choice([1, 1, 2, 7, 10**9])) for g in range(40) for _ in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows + [(1, None, 5), (2, 4.0, None)], "g long, v double, w long").repartition(5)
    groups = defaultdict(list)
    for g, v, w in rows:
        groups[g].append((v, w))
    got = {r.g: tuple(r)[1:] for r in recency.weighted_medians(df, ["g"], "v", "w").collect()}
    assert got == {g: by_hand(p) for g, p in groups.items()}
    equal = {r.g: r for r in recency.weighted_medians(df.withColumn("w", F.lit(3)), ["g"], "v", "w").where("g <> 2").collect()}
    for g, p in groups.items():
        if g != 2:
            values = sorted(v for v, _ in p)
            assert equal[g].low == values[(len(values) - 1) // 2] and equal[g].median == median(values)


LINES = "cluster_id string, supplier string, unit double, bill_dt date, make string, cat string, grade string"


def quotes(spark, rows):
    return spark.createDataFrame([(c, s, u, d and dt.date.fromisoformat(d), "Kia", "Grille", g) for c, s, u, d, g in rows], LINES).repartition(3)


def test_recency_benchmark(spark):
    rows = [("a", "s", 100.0, "2020-01-01", "OES"), ("a", "s", 110.0, "2020-01-01", "OES"), ("a", "s", 200.0, "2026-01-01", "OES"), ("a", "s", 300.0, None, "OES"),
            ("b", "s", 5.0, None, "OES"), ("b", "s", 7.0, None, "OES"), ("c", "s", 9.0, "2019-01-01", "OES")]
    lines = quotes(spark, rows)
    weighted = {r.cluster_id: r for r in recency.recency_benchmark(lines, MatchConfig(as_of="2026-01-01", half_life_months=12)).collect()}
    # 2020 quotes weigh 1/64 each, and so does the undated one.
    assert (weighted["a"].med, weighted["a"].med_raw, weighted["a"].n_undated, weighted["a"].weight) == (200.0, 155.0, 1, 10**9 + 3 * 10**9 // 64)
    assert weighted["b"].med == weighted["b"].med_raw == 6.0 and weighted["c"].med == 9.0
    window = {r.cluster_id: r for r in recency.recency_benchmark(lines, MatchConfig(as_of="2026-01-01", window_months=24)).collect()}
    assert (window["a"].n, window["a"].n_used, window["a"].med, window["a"].med_all) == (4, 1, 200.0, 155.0)
    assert window["b"].med is None and window["b"].n_undated == 2 and window["c"].n_used == 0
    both = recency.with_weights(lines, MatchConfig(as_of="2026-01-01", window_months=24, half_life_months=12)).where("weight IS NOT NULL")
    assert both.count() == 1


def test_recency_settings_enter_the_snapshot_id(spark, demo):
    plain, ids = MatchConfig(), set()
    changes = [{}, {"as_of": "2026-01-01", "half_life_months": 24}, {"as_of": "2026-02-01", "half_life_months": 24}, {"as_of": "2026-01-01", "window_months": 24}, {"ex_gst": True}]
    for change in changes:
        ids.add(snapshot_id(demo, plain.with_(**change)).first()[0])
    assert len(ids) == len(changes)
    for bad in ({"half_life_months": 24}, {"as_of": "2026-01-01", "window_months": 0}, {"as_of": "July"}):
        with pytest.raises(ValueError):
            MatchConfig(**bad)


def test_scorecards_agree_with_leaving_out_each_supplier(spark, monkeypatch):
    monkeypatch.setattr(scorecard, "_BLOCK", 4)
    rng = random.Random(6)
    rows = [(f"c{rng.randint(0, 12)}", rng.choice(["x", "y", "z", "big", "big", "big", None]), rng.choice([10.0, 10.0, 11.0, 0.0, rng.uniform(5, 400)]), "2025-01-01", rng.choice(["OES", "Unknown"])) for _ in range(260)]
    rows += [("alone", "x", 5.0, "2025-01-01", "OES")] * 6 + [("few", "x", 5.0, "2025-01-01", "OES"), ("few", "y", 6.0, "2025-01-01", "OES")] + [("zero", s, 0.0, "2025-01-01", "OES") for s in "xyxy"]
    parts, devs, want = defaultdict(list), defaultdict(list), {}
    for c, s, u, *_ in rows:
        parts[c].append((s or "", u))
    for c, q in parts.items():
        for s in {s for s, _ in q}:
            others = [u for t, u in q if t != s]
            if len(q) >= 4 and others:
                want[c, s] = median(others)
                if median(others):
                    devs[s] += [(u - median(others)) / median(others) * 100 for t, u in q if t == s]
    lines = quotes(spark, rows)
    medians = scorecard.others_medians(lines.select("cluster_id", F.coalesce("supplier", F.lit("")).alias("supplier"), "unit")).where("n >= 4").collect()
    assert {(r.cluster_id, r.supplier): r.others for r in medians} == want
    cards = {r.supplier: r for r in scorecard.scorecards(lines).collect()}
    assert set(cards) == set(devs)
    for s, d in devs.items():
        assert cards[s].lines == len(d) and cards[s].premium_pct == pytest.approx(median(d), abs=0.006) and not cards[s].advisory
    assert one(spark, *[scorecard.band(F.lit(x)) for x in (-5.1, -5.0, 5.0, 5.1, 15.1)]) == ("below", "neutral", "neutral", "amber", "red")
    assert scorecard.evidence(lines).where("cluster_id IN ('alone', 'few', 'zero')").count() == 0


def test_index_does_not_read_a_change_of_mix_as_a_change_of_price(spark):
    days = {1: "2024-01-10", 2: "2024-05-10", 3: "2024-08-10", 4: "2024-12-10", 6: "2025-05-10", 7: "2025-08-10"}
    rows = []
    for c in range(4):
        for quarter, price in ((1, 100), (2, 110), (3, 110), (6, 132), (7, 132)):
            rows.append((f"c{c}", "s", float(price * (c + 1)), days[quarter], "OES"))
    rows += [(f"cheap{c}", "s", 1.0, days[3], "OES") for c in range(20)]  # enter late: no deflation
    rows += [("c0", "s", 999.0, days[4], "OES"), ("c0", "s", 5.0, None, "OES")]  # one part alone is thin
    rows += [("lonely", "s", 5.0, days[q], "Aftermarket") for q in (1, 2, 3)]
    out = price_index.chained_index(quotes(spark, rows), min_matched=3).orderBy("quarter").collect()
    assert {r.grade for r in out} == {"OES"}  # the other segment never has three parts
    assert [(r.label, r["index"], r.matched, r.thin) for r in out] == [
        ("2024-Q1", 100.0, None, False), ("2024-Q2", 110.0, 4, False), ("2024-Q3", 110.0, 4, False), ("2024-Q4", 110.0, 1, True),
        ("2025-Q1", 110.0, 0, True), ("2025-Q2", 110.0, 0, True), ("2025-Q3", 110.0, 4, False)]
    assert price_index.chained_index(quotes(spark, rows[:0] or [("c", "s", 1.0, None, "OES")])).count() == 0


def test_vehicle_numbers(spark):
    good = ["1M8GDM9AXKP042788", "11111111111111111", "5GZCZ43D13S812715"]
    assert one(spark, *[vehicles.check_ok(vehicles.vin(F.lit(v))) for v in good]) == (True, True, True)
    assert one(spark, *[vehicles.check_ok(vehicles.vin(F.lit(v))) for v in ("1M8GDM9A1KP042788", "SGX1234A", None)]) == (False, None, None)
    assert one(spark, *[vehicles.vin(F.lit(v)) for v in (" wdb-203 0461A123456", "WDBI030461A123456", "")]) == ("WDB2030461A123456", None, None)
    make = lambda npn, given, chassis: vehicles.make_of_line(F.lit(npn), F.lit(given), F.lit(chassis))
    assert one(spark, make("HY1", "kia", "WDB2030461A123456"), make("HY1", "", "WDB2030461A123456"), make("HY1", "", "SGX1234A"), make("ZZ", None, "XXX2030461A123456"),
               make("ZZ", "Unknown", "JTDBR32E720123456")) == ("Kia", "Mercedes-Benz", "Hyundai", "Unknown", "Toyota")
    # The longest code counts, and codes are an argument.
    codes = {"W": "One", "WD": "Two", "WDB": "Three"}
    assert one(spark, *[vehicles.make_of_vin(F.lit(v), codes) for v in ("WDB1", "WDX1", "WXX1", "X")]) == ("Three", "Two", "One", None)
    assert one(spark, vehicles.chassis_model_key(F.lit("WDB2030461A123456"), F.lit("C 180")), vehicles.chassis_model_key(F.lit("SGX1"), F.lit("C 180"))) == ("WDB20304", "C 180")


def test_prices_without_tax(spark):
    rows = [("2022-12-31", "incl", 107.0, 100.0, ""), ("2023-01-01", "incl", 108.0, 100.0, ""), ("2023-12-31", "incl", 108.0, 100.0, ""), ("2024-01-01", "incl", 109.0, 100.0, ""),
            ("2024-01-01", "excl", 109.0, 109.0, ""), ("2024-01-01", "unknown", 109.0, 109.0, "unknown"), (None, "incl", 109.0, 100.0, "undated"), (None, "excl", 5.0, 5.0, ""),
            ("2001-01-01", "incl", 109.0, 100.0, "before rates"), ("2024-01-01", None, 7.0, 7.0, "unknown")]
    df = spark.createDataFrame([(d and dt.date.fromisoformat(d), *x) for d, *x in rows], "bill_dt date, gst string, unit double, want double, flag string")
    for r in tax.with_tax_columns(df).collect():
        assert r.unit_ex == pytest.approx(r.want) and r.gst_flag == r.flag
    assert tax.priced(df, None) is df and tax.priced(df, True).agg(F.sum("unit")).first()[0] < 850
    assert {(r.gst, r.gst_flag): r.lines for r in tax.flag_counts(df).collect()}["incl", ""] == 4


def told_in_order(events):
    lines = defaultdict(dict)
    for c, l, e, at, kind, amount in events:
        key = (at, kind, amount is not None, amount or 0, amount)
        lines[c, l][e] = min(lines[c, l].get(e, key), key)
    out = {}
    for line, own in lines.items():
        state, since, amount, n, passed = "none", None, None, 0, 0
        for e, (at, kind, _, _, a) in sorted(own.items(), key=lambda x: (x[1][0], x[0])):
            to = O.TRANSITIONS.get(kind, {}).get(state)
            if to is None:
                passed += 1
                continue
            state, since, n = to, at, n + 1
            amount = amount if a is None else a
        out[line] = (state, since, amount, n, passed)
    return out


@pytest.mark.parametrize("block", [3, 256])
def test_outcomes_agree_with_telling_events_in_order(spark, monkeypatch, block):
    monkeypatch.setattr(O, "_BLOCK", block)
    rng = random.Random(block)
    at = [dt.datetime(2026, 1, d) for d in range(1, 20)]
    events = [(f"c{rng.randint(0, 5)}", rng.randint(0, 2), f"e{rng.randint(0, 25)}", rng.choice(at), rng.choice([*O.TRANSITIONS, "noise"]), rng.choice([None, 5.0, 7.5])) for _ in range(700)]
    schema = "claim_ref string, line_no long, event_id string, at timestamp, kind string, amount double"
    df = spark.createDataFrame(events + events[:50] + [(None, 1, "e", at[0], "saved", 1.0), ("c0", 1, None, at[0], "saved", 1.0), ("c9", 1, "e", None, "saved", 1.0)], schema).repartition(4)
    history = O.histories(df).cache()
    assert {(r.claim_ref, r.line_no): tuple(r)[2:] for r in O.outcomes(history).collect()} == told_in_order(events)
    held = O.intervals(history).collect()
    assert len(held) == history.where("accepted").count() and all(r.until is None or r.until >= r.since for r in held)
    assert O.outcomes(O.histories(df.where("claim_ref = 'nobody'"))).count() == 0


def test_reports_of_closed_lines(spark):
    assessed = spark.createDataFrame([("a", 1, 100.0, 80.0, True), ("a", 2, 50.0, None, None), ("b", 1, 10.0, 9.0, False), ("b", 2, 10.0, 9.0, False), ("c", 1, 1.0, 1.0, False)],
                                     "claim_ref string, line_no long, quoted double, bench double, above_bound boolean")
    settled = spark.createDataFrame([("a", 1, "negotiated", 90.0), ("a", 2, "paid as quoted", None), ("b", 1, "negotiated", None), ("b", 2, "negotiated", 12.0), ("c", 1, "offered", 1.0)],
                                    "claim_ref string, line_no long, state string, amount double")
    a, b = O.case_report(assessed, settled).orderBy("claim_ref").collect()
    assert (a.closed, a.unpriced, a.estimate, a.benchmark, a.final, a.realised) == (2, 0, 150.0, 80.0, 140.0, 10.0) and a.benchmark_error == pytest.approx(100 / 9)
    assert (b.closed, b.unpriced, b.estimate, b.final, b.realised) == (2, 1, 10.0, 12.0, 0.0)
    p = O.portfolio(assessed, settled).first()
    assert (p.cases, p.lines, p.flagged, p.flagged_down, p.others_down, p.realised, p.potential, p.advisory) == (2, 3, 1, 1.0, 0.0, 10.0, 21.0, True)
    assert O.portfolio(assessed, settled.where("false")).first().lines == 0


def test_events_are_dealt_out_once(spark):
    df = spark.createDataFrame([("c", 1, "e1", dt.datetime(2026, 1, 1), "saved", 1.0)], "claim_ref string, line_no int, event_id string, at timestamp, kind string, amount double")
    settled = O.outcomes(O.histories(df))
    assert settled._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert settled.first().state == "open"
