import random

import pytest
from pyspark.sql import functions as F

from conftest import raw_frame
from pricebench import MatchConfig
from pricebench.functions.similarity import with_name_features
from pricebench.operators import blocking, grouping
from pricebench.operators.clusters import build_clusters, in_cluster_order
from pricebench.operators.enrich import enrich_lines
from pricebench.operators.grouping import assign_clusters
from pricebench.operators.leaders import followers_of, group_by_leader
from sequential import lead, score


def cluster_count(df, cfg):
    got = assign_clusters(df, cfg).groupBy("cluster_id").count()
    rows = got.collect()
    return len(rows), sum(r["count"] > 1 for r in rows), sum(r["count"] for r in rows)


def test_demo_groups(demo):
    assert cluster_count(demo, MatchConfig()) == (108, 10, 118)
    assert cluster_count(demo, MatchConfig(mode="hybrid")) == (118, 0, 118)
    assert cluster_count(demo, MatchConfig(mode="hybrid", bridge=True)) == (108, 10, 118)
    assert cluster_count(demo, MatchConfig(mode="category")) == (61, 27, 118)


def tiny(spark, *names):
    rows = [dict(part_name=n, part_number=f"PN-{i}", qty=1, unit_cost=100 + i, total_cost=100 + i, make="Toyota",
                 doc_type="Tax Invoice", supplier=f"S{i}", bill_no=f"B{i}") for i, n in enumerate(names)]
    return enrich_lines(raw_frame(spark, rows))


def test_positions_split_groups(spark):
    covers = tiny(spark, "BUMPER COVER FR", "BUMPER COVER RR")
    assert cluster_count(covers, MatchConfig())[0] == 2
    assert cluster_count(covers, MatchConfig(mode="hybrid", bridge=True))[0] == 2
    lamps = tiny(spark, "HEADLAMP LH", "HEADLAMP RH")
    assert cluster_count(lamps, MatchConfig())[0] == 1
    assert cluster_count(lamps, MatchConfig(sep_side=True))[0] == 2


def test_names_without_words_stay_apart(spark):
    assert cluster_count(tiny(spark, "ASSY", "ASSY", "FR", ""), MatchConfig())[0] == 4


def test_blank_part_numbers(spark):
    rows = [dict(part_name=f"X{i}", part_number=pn, unit_cost=1, qty=1) for i, pn in enumerate(["", "", "10", "9", "A"])]
    df = enrich_lines(raw_frame(spark, rows))
    exact = in_cluster_order(build_clusters(assign_clusters(df, MatchConfig(mode="exact-pn")))).collect()
    assert [(r.cluster_id, r.n) for r in exact] == [("?", 2), ("9", 1), ("10", 1), ("A", 1)]
    assert cluster_count(df, MatchConfig(mode="hybrid"))[0] == 5


GRADES = ["Unknown", "Unknown", "OES", "Aftermarket"]
ENDS = ["", "", "F", "B"]


def random_vertices(rng, n, words):
    out = []
    for i in range(n):
        name = " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        out.append((i * 3 + 7, rng.choice(["a", "b"]), rng.choice(GRADES), rng.choice(ENDS), name))
    return out


def vertex_frame(spark, rows):
    df = spark.createDataFrame(rows, "ord long, block string, grade string, end string, nn string")
    df = df.withColumn("tk", F.array_distinct(F.split("nn", " ")))
    pos = F.struct(F.lit("").alias("side"), F.col("end").alias("end"), F.lit("").alias("vert"), F.lit("").alias("depth"))
    return df.withColumn("pos", pos).drop("end")


def expected_owners(rows, cfg):
    def compatible(a, b):
        if a[1] != b[1] or (a[3] and b[3] and a[3] != b[3]):
            return False
        if cfg.sep_grade and "Unknown" not in (a[2], b[2]) and a[2] != b[2]:
            return False
        return score(a[4], b[4], cfg.token_weight) >= cfg.threshold

    return {rows[i][0]: rows[o][0] for i, o in enumerate(lead(rows, compatible))}


@pytest.mark.parametrize("weight,threshold,first,budget", [
    (0.6, 0.65, 16_384, 10**9), (0.6, 0.65, 30, 10**9), (0.6, 0.65, 30, 50), (0.8, 0.5, 40, 10**9),
    (0.4, 0.55, 16_384, 10**9), (0.0, 0.7, 16_384, 10**9), (1.0, 0.5, 16_384, 10**9), (0.6, 0.35, 16_384, 10**9),
])
def test_leaders_follow_the_sequential_rule(spark, weight, threshold, first, budget):
    rng = random.Random(int(weight * 100 + threshold * 1000 + first))
    words = ["bumper", "cover", "lamp", "lampe", "head", "heads", "a", "b", "x1", "x2", "clip"]
    rows = random_vertices(rng, 120, words)
    cfg = MatchConfig(token_weight=weight, threshold=threshold)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = group_by_leader(vertex_frame(spark, shuffled).repartition(5), cfg, first, budget).collect()
    assert {r.ord: r.owner for r in got} == expected_owners(rows, cfg)


@pytest.mark.parametrize("weight,threshold,cell", [(0.6, 0.65, 2), (0.4, 0.55, 3), (0.8, 0.5, 5)])
def test_hot_keys_spread_over_cells(spark, weight, threshold, cell):
    rng = random.Random(cell)
    rows = random_vertices(rng, 110, ["bumper", "cover", "lamp", "lampe", "head", "a", "b", "x1", "clip"])
    cfg = MatchConfig(token_weight=weight, threshold=threshold)
    got = group_by_leader(vertex_frame(spark, rows), cfg, 30, cell_rows=cell).collect()
    assert {r.ord: r.owner for r in got} == expected_owners(rows, cfg)


def test_one_word_shared_by_all_names_of_a_block(spark):
    """3,000 names of one block with one word in common: each pair meets once, and no cell holds more than a small share of them."""
    names = spark.range(3000).select(
        F.col("id").alias("ord"), F.lit("a").alias("block"), F.lit("k").alias("_key"), F.lit(2).alias("_a"), F.lit(2).alias("_b"))
    lone = spark.range(5).select((F.col("id") + 9000).alias("ord"), F.lit("b").alias("block"), F.lit("k").alias("_key"), F.lit(2).alias("_a"), F.lit(2).alias("_b"))
    x, y = blocking._in_cells(names.unionByName(lone), names.limit(2000).unionByName(lone), 250)
    pairs = x.alias("x").join(y.alias("y"), ["block", "_key", "_a", "_b", "_c"])
    sizes = pairs.groupBy("block", "_c").count().collect()
    assert sum(r["count"] for r in sizes) == 3000 * 2000 + 25
    assert pairs.select("x.ord", F.col("y.ord").alias("other")).distinct().count() == 3000 * 2000 + 25
    assert max(r["count"] for r in sizes) < 2 * 250 * 250


def test_long_names_use_single_keys(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(16)]
    rows = []
    for i in range(40):
        words = base[:]
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(16)] = f"v{rng.randrange(30)}"
        rows.append((i, "a", "Unknown", "", " ".join(words)))
    cfg = MatchConfig()
    got = group_by_leader(vertex_frame(spark, rows), cfg).collect()
    assert {r.ord: r.owner for r in got} == expected_owners(rows, cfg)


def test_long_chains_settle(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(12)], "hi long, lo long")
    lost = sorted(r.hi for r in followers_of(chain).collect())
    assert lost == [1, 3, 5, 7, 9, 11]


def test_partitioning_does_not_matter(demo):
    cfg = MatchConfig()
    base = {(r.id, r.cluster_id) for r in assign_clusters(demo, cfg).select("id", "cluster_id").collect()}
    moved = demo.repartition(13, "unit").sortWithinPartitions(F.col("id").desc())
    assert base == {(r.id, r.cluster_id) for r in assign_clusters(moved, cfg).select("id", "cluster_id").collect()}


def test_name_features(spark):
    df = with_name_features(spark.createDataFrame([("Head-Lamp ASSY, LH 09 x",)], "part_name string"), "part_name")
    row = df.first()
    assert (row.nn, row.tk, row.pos.side) == ("head lamp x", ["head", "lamp", "x"], "L")


def test_features_are_taken_once_per_spelling(spark, monkeypatch):
    """Lines written alike look up their part; names without a telling word stay alone, line by line."""
    names = ["HEADLAMP UNIT", "HEADLAMP UNITS", "???"] * 20 + [""]
    signed = grouping._signed
    seen = []
    monkeypatch.setattr(grouping, "_signed", lambda rows, cfg: seen.append(rows.count()) or signed(rows, cfg))
    out = {r.seq: r.cluster_id for r in assign_clusters(tiny(spark, *names), MatchConfig()).collect()}
    assert seen == [4]
    assert len(out) == len(names)
    assert all(out[i] == (i if n in ("", "???") else names.index(n)) for i, n in enumerate(names))


def test_lines_with_missing_fields_keep_their_place(spark):
    lines = tiny(spark, "HEADLAMP UNIT", "HEADLAMP UNIT", "HEADLAMP UNIT").withColumn(
        "grade", F.when(F.col("seq") == 1, None).otherwise(F.col("grade")))
    assert assign_clusters(lines, MatchConfig()).count() == 3
