import pytest
from pyspark.sql import functions as F

from pricebench import MatchConfig
from pricebench.operators import snapshots as S
from pricebench.operators.clusters import build_clusters
from pricebench.operators.grouping import assign_clusters


def as_rows(df):
    return sorted(map(str, (r.asDict(True) for r in df.select(*sorted(df.columns)).collect())))


def files(root):
    return {p: p.stat().st_mtime_ns for p in (root / "blocks").rglob("*.parquet")}


def test_only_changed_blocks_are_worked_out(spark, demo, tmp_path):
    root, cfg = str(tmp_path), MatchConfig()
    first, todo = S.save_snapshot(demo, cfg, root)
    makes = [r.make for r in demo.select("make").distinct().collect()]
    assert len(todo) == demo.select(S.block_of(F.col("make"))).distinct().count()
    whole = build_clusters(assign_clusters(demo, cfg), cfg)
    assert as_rows(S.load_snapshot(spark, root, first)) == as_rows(whole)
    before = files(tmp_path)
    assert S.save_snapshot(demo, cfg, root) == (first, []) and files(tmp_path) == before

    dearer = demo.withColumn("unit", F.when(F.col("make") == "Hyundai", F.col("unit") + 1).otherwise(F.col("unit")))
    second, todo = S.save_snapshot(dearer, cfg, root)
    assert "Hyundai" in makes and len(todo) == 1 and second != first
    assert all(files(tmp_path)[p] == t for p, t in before.items())  # nothing is written again
    full = build_clusters(assign_clusters(dearer, cfg), cfg)
    assert as_rows(S.load_snapshot(spark, root, second)) == as_rows(full)
    assert as_rows(S.load_snapshot(spark, root, first)) == as_rows(whole)
    moved = S.changes(S.load_snapshot(spark, root, first), S.load_snapshot(spark, root, second)).collect()
    assert moved and all("Hyundai" in r.key and r.med_after == pytest.approx(r.med_before + 1) for r in moved)

    # Back to the first state: nothing to work out.  Other settings are blocks of their own.
    assert S.save_snapshot(demo, cfg, root) == (first, [])
    other, todo = S.save_snapshot(demo, cfg.with_(mode="category"), root)
    assert todo and S.list_snapshots(spark, root).count() == 3
    gone, todo = S.save_snapshot(demo.where("make <> 'Hyundai'"), cfg, root)
    assert todo == [] or len(todo) == 1
    assert S.load_snapshot(spark, root, gone).where("make = 'Hyundai'").count() == 0


def test_what_has_no_blocks_is_refused(spark, demo, tmp_path):
    for cfg in (MatchConfig(mode="exact-pn"), MatchConfig(same_make=False), MatchConfig(ex_gst=True)):
        with pytest.raises(ValueError):
            S.save_snapshot(demo, cfg, str(tmp_path))
    with pytest.raises(ValueError, match="no snapshot"):
        S.load_snapshot(spark, str(tmp_path), "BENCH-0")
    assert S.list_snapshots(spark, str(tmp_path)).count() == 0
