import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import raw_frame, read_fixture
from pricebench.functions import parts as P, similarity as S
from pricebench.functions.numeric import round_half_up, text_number, to_fixed
from pricebench.operators.enrich import enrich_lines, upgrade_lines


def one(spark, column, *values):
    """Evaluate ``column(F.col('x'))`` on each value."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_part_numbers(spark):
    got = one(spark, P.normal_part_number, "mba213 906-67.01 9999", "T81130-06590 (LH)/X", " a.b-c ", None, "12999",
              "ab c")
    assert got == ["MBA2139066701", "T8113006590", "ABC", "", "12", "ABC"]


def test_makes_fold(spark):
    given_ = ["Mercedes", "MERCEDES BENZ", "mercedes-benz", "Merc", "Benz", "VW", "Chevy", "toyota", "Mitsubishi",
              "Mitsubishi Fuso", "Perodua", "", "Unknown", None]
    want = ["Mercedes-Benz"] * 5 + ["Volkswagen", "Chevrolet", "Toyota", "Mitsubishi", "Mitsubishi Fuso", "Perodua",
                                    "Unknown", "Unknown", "Unknown"]
    assert one(spark, P.canonical_make, *given_) == want


def test_make_from_part_number(spark):
    got = one(spark, lambda x: P.make_of(x, F.lit("")), "MBA2139066701", "KA565402H000", "8R2998002", "T8111002M40",
              "MK1234", "513X", "ZZZ")
    assert got == ["Mercedes-Benz", "Hyundai", "Audi", "Toyota", "Mitsubishi Fuso", "BMW", "Unknown"]


def test_dates(spark):
    got = one(spark, P.bill_date_of, "15/1/26", "2026-01-15", "no date here", "31/02/2018", "dated 2020-12-31 ok",
              "1/13/2020", "", None)
    assert got == [dt.date(2026, 1, 15), dt.date(2026, 1, 15), None, dt.date(2018, 3, 3), dt.date(2020, 12, 31),
                   dt.date(2021, 1, 1), None, None]


def test_grades_and_bases(spark):
    assert one(spark, lambda x: P.grade_of(x, F.lit("")), "HEADLAMP (ORIGINAL)", "LAMP GEN", "X OES", "COVER APM",
               "COVER (TW)", "RECON PUMP", "LAMP", "GENERAL") == [
        "OEM Genuine", "OEM Genuine", "OES", "Aftermarket", "Aftermarket", "Used/Recon", "Unknown", "Unknown"]
    assert one(spark, lambda x: P.basis_of(x, F.lit("")), "BRAKE SET", "BALL JOINT ASSY-INR L/R", "LAMP LH/RH",
               "MIRROR PAIR", "LAMP", "OFFSET") == ["set", "pair", "pair", "pair", "each", "each"]


def test_positions(spark):
    names = ["COVER FR", "COVER RR", "HEADLAMP LH", "HEADLAMP RH", "MIRROR LH/RH PAIR", "BUMPER COVER",
             "CHASSIS FRAME", "T81110-FR2", "ARM UPR", "BALL JOINT OTR"]
    got = [(p.side, p.end, p.vert, p.depth) for p in one(spark, S.position, *names)]
    assert got == [("", "F", "", ""), ("", "B", "", ""), ("L", "", "", ""), ("R", "", "", ""), ("", "", "", ""),
                   ("", "", "", ""), ("", "", "", ""), ("", "", "", ""), ("", "", "U", ""), ("", "", "", "O")]


def test_position_conflicts(spark):
    pairs = [("COVER FR", "COVER RR", False, True), ("HEADLAMP LH", "HEADLAMP RH", False, False),
             ("HEADLAMP LH", "HEADLAMP RH", True, True), ("COVER FR", "COVER", False, False),
             ("BUMPER FRT", "BUMPER FRONT", False, False), ("ARM UPR", "ARM LOWER", False, True),
             ("BALL JOINT INR", "BALL JOINT OTR", False, True), ("DOOR PANEL FRONT", "DOOR PANEL REAR", False, True)]
    for a, b, sides, want in pairs:
        row = spark.range(1).select(
            S.position_conflict(S.position(F.lit(a)), S.position(F.lit(b)), sides).alias("c")).first()
        assert row.c is want, (a, b)


def test_similarity_matches_published_pairs(spark):
    rows = [(r["part_name_a"], r["part_name_b"], r["similarity"]) for r in read_fixture("candidate_pairs.csv")]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    df = S.with_name_features(S.with_name_features(df, "a", "a_"), "b", "b_")
    sim = S.similarity(F.col("a_nn"), F.col("a_tk"), F.col("b_nn"), F.col("b_tk"), 0.6)
    bad = df.where(F.call_function("format_number", sim, F.lit("0.0000")) != F.col("want"))
    assert df.count() == 138 and bad.count() == 0


def test_text_numbers(spark):
    got = one(spark, text_number, "12", " 3.5 ", "", "abc", "1,000", "1d", "NaN", "-2e3", None)
    assert [None if g is None else (g if g == g else "nan") for g in got] == [
        12.0, 3.5, 0.0, "nan", "nan", "nan", "nan", -2000.0, None]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-1e7, 1e7).map(lambda v: round(v, 4)), min_size=1, max_size=200))
def test_to_fixed_is_exact(spark, values):
    values = values + [2.675, 0.125, 1.005, -0.125, 2.5, 0.5, 1e-9, -1e-9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", *[to_fixed(F.col("x"), k).alias(f"k{k}") for k in (0, 1, 2)], round_half_up(F.col("x")).alias("r"))
    for row in got.collect():
        for k in (0, 1, 2):
            want = float(Decimal(row.x).quantize(Decimal(1).scaleb(-k), ROUND_HALF_UP))
            assert row[f"k{k}"] == want


def test_money_sort_key(spark):
    assert one(spark, P.money, "S$1,234.50", "+45%", "≈ 12", "abc", "-3", "≈S$7", None, "") == [
        1234.5, 45.0, 12.0, None, -3.0, 7.0, None, None]


def test_enrich_defaults(spark):
    rows = [
        dict(part_name="FR BUMPER COVER", part_number="T52119-02M50", qty=2, total_cost=400, doc_type="Tax Invoice"),
        dict(part_name="THING", part_number="P1", qty=1),
        dict(part_name="HEADLAMP", part_number="X", make="Mercedes", unit_cost=7, qty=3),
        dict(part_name="A", part_number="B", total_cost=10, qty=3),
    ]
    got = enrich_lines(raw_frame(spark, rows)).orderBy("seq").collect()
    assert (got[0].unit, got[0].grade, got[0].unit_basis, got[0].make) == (200, "Unknown", "each", "Toyota")
    assert (got[1].unit, got[1].total, got[1].doc_type, got[1].model) == (0, 0, "Tax Invoice", "—")
    assert (got[2].make, got[2].total) == ("Mercedes-Benz", 21)
    assert got[3].unit == 3.33


def test_demo_line_types(demo):
    counts = {r.ltype: r["count"] for r in demo.groupBy("ltype").count().collect()}
    assert counts == {"Supplier Part": 118, "Repair Estimate": 44, "Consumable / Fastener": 12}


def test_upgrade(spark):
    stale = dict(id="abc", bill_no="8049120", supplier="S", bill_date="28/12/2016", make="Hyundai", model="Tucson",
                 part_name="BALL JOINT ASSY-INR L/R", part_number="KA56540 2H 000", npn="KA565402H000",
                 cat="Suspension/Steering Arm", qty=1.0, unit=42.0, total=42.0, ltype="Supplier Part",
                 doc_type="Tax Invoice", src="excel")
    up = upgrade_lines(spark.createDataFrame([stale])).first()
    assert (up.grade, up.unit_basis, up.gst, up.review) == ("Unknown", "pair", "unknown", False)
    assert (up.id, up.npn, up.unit) == ("abc", "KA565402H000", 42)
    modern = stale | dict(grade="OES", unit_basis="each", gst="incl", review=True, review_reason="x")
    up = upgrade_lines(spark.createDataFrame([modern])).first()
    assert (up.grade, up.unit_basis, up.gst, up.review) == ("OES", "each", "incl", True)
    bare = {k: v for k, v in stale.items() if k not in ("npn", "ltype")} | dict(part_name="BALL JOINT ASSY",
                                                                                make="MERCEDES BENZ")
    up = upgrade_lines(spark.createDataFrame([bare])).first()
    assert (up.unit_basis, up.npn, up.ltype, up.make) == ("each", "KA565402H000", "Supplier Part", "Mercedes-Benz")


def test_category_reads_a_name_once(spark):
    table = (("Fog", ("fog lamp", "fog", "a.b(c")), ("Nut", (" nut", "fo", "é")), ("Door", ("door", "oor", "fog")))
    names = ["FOG LAMP", "a doorFOG", "Nut", "walnut", "poor", "axb(c", "A.B(C", "éa", "", None, "fo", "x\ndoor"]

    def by_rule(name, rules_):
        padded = f" {(name or '').lower()} "
        return next((cat for cat, keys in rules_ if any(k in padded for k in keys)), "Other")

    for rules_ in (table, table[:2] + (("All", ("",)),) + table[2:], P.rules.CATEGORY_RULES):
        assert one(spark, lambda c: P.category(c, rules_), *names) == [by_rule(n, rules_) for n in names]
    keys = [k + " x" for _, keys in P.rules.CATEGORY_RULES for k in keys]
    assert one(spark, P.category, *keys) == [by_rule(k, P.rules.CATEGORY_RULES) for k in keys]
    plan = spark.range(1).select(P.category(F.lit("x").substr(F.col("id").cast("int"), F.lit(1))).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert "Contains(" not in plan and plan.lower().count("contains(") == 0


def _plan(spark, column):
    return spark.createDataFrame([("x",)], "x string").select(column(F.col("x")).alias("y"))._jdf.queryExecution().analyzed().toString()


def test_tags_are_read_only_in_names_that_can_hold_them(spark):
    import re

    said = ["used", "recon", "reconditioned", "secondhand", "s/h", "2nd hand", "(original)", "original", "genuine", "gen", "oes", "aftermarket", "after market",
            "apm", "replacement", "(tw)", "taiwan", "copy", "imitation", "set", "(pair)", "pair", "lh/rh", "rh/lh", "rhs/lhs", "lhs/rhs", "rh & lh", "lh & rh", "l/r"]
    names = [t.format(s) for s in said for t in ("{}", "DOOR {} x", "a{}", "{}b", "gen {}", "{} COPY")] + ["", None, "DOOR", "é"]

    def first(name, cases, otherwise):
        padded = f" {(name or '').lower()} "
        return next((v for v, p in cases if re.search(p, padded, re.ASCII)), otherwise)

    grades = [first(n, P.rules.GRADE_TAGS, "Unknown") for n in names]
    bases = [first(n, (("set", P.rules.SET_TAG), ("pair", P.rules.PAIR_TAG)), "each") for n in names]
    assert one(spark, lambda c: P.grade_of(c, F.lit("")), *names) == grades
    assert one(spark, lambda c: P.basis_of(c, F.lit("")), *names) == bases
    # A pattern costs most of what reading a name does: none runs without its texts.
    for column in (lambda c: P.grade_of(c, F.lit("")), lambda c: P.basis_of(c, F.lit(""))):
        assert "contains(" in _plan(spark, column).lower()


def test_a_date_is_split_once(spark):
    assert one(spark, P.bill_date_of, "x 1/2/21", "2021-02-31", "31-12-2020 9/8/2020", "", None) == [
        dt.date(2021, 2, 1), dt.date(2021, 3, 3), dt.date(2020, 8, 9), None, None]
    assert _plan(spark, P.bill_date_of).count("split(") == 2
