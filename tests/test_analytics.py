import pytest
from pyspark.sql import functions as F

from pricebench import MatchConfig
from pricebench.operators.clusters import build_clusters, cluster_variants
from pricebench.operators.grouping import assign_clusters
from pricebench.plans import analytics as A


@pytest.fixture(scope="module")
def bench(demo):
    cfg = MatchConfig(mode="exact-pn")
    grouped = assign_clusters(demo, cfg)
    variants = cluster_variants(grouped).cache()
    return grouped, variants, build_clusters(grouped, cfg, variants).cache()


def test_overview(demo, bench):
    clusters = bench[2]
    k = A.kpis(demo, clusters).first()
    assert (k.invoices, k.lines, k.usable, k.makes, k.review) == (31, 174, 118, 8, 0)
    assert A.usable_by_category(demo).count() == 26
    held = demo.withColumn("review", F.col("seq") < 20)
    assert A.kpis(held, clusters).first().usable == 118
    assert A.kpis(held, clusters, exclude_review=True).first().usable < 118
    c = A.coverage_summary(demo, clusters).first()
    assert c.makes_listed == 17 and c.categories == 26
    gaps = A.coverage(demo)
    assert gaps.count() == 17 and gaps.where("gap").count() == 17 - c.makes_hit


def test_line_details(demo, bench):
    grouped, _, clusters = bench
    rows = A.line_details(demo, grouped, clusters)
    assert rows.count() == 174 and rows.where("bench_n IS NOT NULL").count() == 118
    assert rows.where("bill_lines < 1").count() == 0


def test_any_column_order(spark):
    values = ["10", "S$9", "b2", "b10", "A", "+45%", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    up = [r.v for r in A.order_by_any(df, "v").collect()]
    assert up == ["S$9", "10", "+45%", None, "A", "b2", "b10"]
    assert [r.v for r in A.order_by_any(df, "v", descending=True).collect()] == up[::-1]


def test_benchmark_view_falls_back_to_single_quotes(bench):
    clusters = bench[2]
    single = clusters.where("n = 1")
    assert A.benchmark_view(single).count() == min(25, single.count())
    both = A.benchmark_view(clusters)
    assert both.where("n < 2").count() == (0 if clusters.where("n > 1").count() else min(25, clusters.count()))


def test_bills_work_out_only_their_columns(spark, sf_dir, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_kept", {})
    rows = entry.queries()["a6_bills"](spark, sf_dir)
    assert not entry._kept  # no line is enriched in full and stored
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # what finds a category
    assert sorted(rows.collect()) == sorted(A.bills(entry.lines(spark, sf_dir)).collect())
    entry.queries()["a6_bills"](spark, sf_dir)
    assert [k[2] for k in entry._kept] == ["lines"]
