import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from conftest import raw_frame
from pricebench import MatchConfig
from pricebench.operators.clusters import build_clusters, cluster_variants, price_summary, variant_list
from pricebench.operators.enrich import enrich_lines
from pricebench.operators.grouping import assign_clusters
from pricebench.operators.quantiles import grouped_quantiles


def r7(values, p):
    s = sorted(values)
    rank = p * (len(s) - 1)
    lo = math.floor(rank)
    return s[lo] if rank == lo else s[lo] + (rank - lo) * (s[lo + 1] - s[lo])


def frame(spark, groups):
    return spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")


def test_quantiles_match_the_definition(spark):
    rng = random.Random(1)
    groups = {"ten": range(1, 11), "one": [42], "neg": [-3, -3, 0, 0, 5e-4, 7], "hot": [
        round(rng.lognormvariate(4, 2), 2) for _ in range(4000)]}
    got = grouped_quantiles(frame(spark, groups), ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.75, "z": 1.0, "o": 0.0})
    rows = {r.k: r for r in got.collect()}
    assert (rows["ten"].a, rows["ten"].b, rows["ten"].c) == (3.25, 5.5, 7.75)
    for k, values in groups.items():
        values = [float(v) for v in values]
        assert rows[k].a == r7(values, 0.25) and rows[k].c == r7(values, 0.75)
        assert rows[k].b == statistics.median(values)
        assert (rows[k].o, rows[k].z) == (min(values), max(values))


@pytest.mark.parametrize("values,q1,q3,iqr,low,high,reliable", [
    ([100, 100, 100, 200, 300], 100, 200, 100, -50, 350, True),
    ([100, 120, 140], 110, 130, 20, 80, 160, False),
    ([250], 250, 250, 0, 250, 250, False),
])
def test_dispersion(spark, values, q1, q3, iqr, low, high, reliable):
    r = price_summary(frame(spark, {"a": values}), ["k"], "v").first()
    assert (r.q1, r.q3, r.iqr, r.lower_fence, r.upper_fence, r.reliable) == (q1, q3, iqr, low, high, reliable)
    assert (r.sd is None) == (len(values) == 1) and (r.cv is None) == (len(values) == 1)


def test_deviation_is_the_sample_one(spark):
    r = price_summary(frame(spark, {"a": [2, 4, 4, 4, 5, 5, 7, 9]}), ["k"], "v").first()
    assert r.sd == 2.14 and r.n == 8 and r.med == 4.5 and r.spread == 7


@pytest.mark.parametrize("n,floor,reliable", [(3, 4, False), (3, 3, True), (4, 5, False), (4, 4, True)])
def test_reliability_floor(spark, n, floor, reliable):
    rows = [dict(part_name="HEADLAMP RH", part_number="AA-1", qty=1, unit_cost=u, total_cost=u, doc_type="Tax Invoice",
                 supplier=f"S{u}", bill_no=f"B{u}") for u in [100, 140, 120, 130][:n]]
    cfg = MatchConfig(mode="exact-pn", min_quotes=floor)
    r = build_clusters(assign_clusters(enrich_lines(raw_frame(spark, rows)), cfg), cfg).first()
    assert (r.n, r.reliable, r.n_suppliers) == (n, reliable, n)


def test_identity_follows_member_order(spark):
    rows = [
        dict(part_name="LAMP X", part_number="", model="", supplier="B", unit_cost=1, grade="OES", make="Kia"),
        dict(part_name="LAMP X", part_number="p-2", model="Rio", supplier="A", unit_cost=3, make="Kia"),
        dict(part_name="X LAMP", part_number="p-1", model="Soul", supplier="B", unit_cost=2, make="Kia"),
    ]
    cfg = MatchConfig()
    grouped = assign_clusters(enrich_lines(raw_frame(spark, rows)), cfg)
    r = build_clusters(grouped, cfg).first()
    assert (r.label, r.key, r.model, r.grade, r.bridged, r.model_mixed) == ("LAMP X", "P2|Kia", "—", "OES", True, True)
    assert (r.n_names, r.n_pns, r.n_suppliers, r.n_models) == (2, 2, 2, 2)
    names = variant_list(cluster_variants(grouped), "supplier", "suppliers").first()
    assert names.suppliers == ["B", "A"]


def test_bridged_order(spark):
    """Members of a bridged part follow their part-number groups; integer part numbers come first."""
    rows = [
        dict(part_name="LAMP LH", part_number="AB", unit_cost=1, make="Kia"),
        dict(part_name="LAMP", part_number="77", unit_cost=2, make="Kia"),
        dict(part_name="LAMP OTHER THING", part_number="AB", unit_cost=5, make="Kia"),
    ]
    cfg = MatchConfig(mode="hybrid", bridge=True)
    r = build_clusters(assign_clusters(enrich_lines(raw_frame(spark, rows)), cfg), cfg).first()
    assert (r.n, r.label, r.key) == (3, "LAMP", "77|Kia")
