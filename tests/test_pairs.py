import random

import duckdb
from pyspark.sql import functions as F

from conftest import read_fixture, raw_frame
from pricebench import MatchConfig
from pricebench.operators import pairs
from pricebench.operators.blocking import candidate_bound, similar_pairs, with_match_sets
from pricebench.operators.enrich import enrich_lines
from pricebench.functions.similarity import similarity, with_name_features


def test_published_pairs(demo):
    got = pairs.candidate_pairs(demo).collect()
    want = read_fixture("candidate_pairs.csv")
    assert len(got) == len(want) == 138
    for g, w in zip(got, want):
        assert (g.part_name_a, g.part_name_b, g.make, g.category_a, g.category_b, g.label) == (
            w["part_name_a"], w["part_name_b"], w["make"], w["category_a"], w["category_b"], w["label"])
        assert abs(g.similarity - float(w["similarity"])) < 1e-9 and g.pair_id == int(w["pair_id"])


EXPECTED = """
WITH f AS (SELECT *, list_distinct(list_filter(string_split(nn, ' '), lambda t: t <> '')) tk FROM parts),
p AS (SELECT a.i, b.i j, a.pn <> '' AND a.pn = b.pn twin,
    0.6::DOUBLE * coalesce(len(list_intersect(a.tk, b.tk))::DOUBLE / nullif(len(list_distinct(list_concat(a.tk, b.tk))), 0), 0)
    + (1 - 0.6::DOUBLE) * (CASE WHEN a.nn = '' OR b.nn = '' THEN 0.0::DOUBLE ELSE 1 - levenshtein(a.nn, b.nn)::DOUBLE / greatest(length(a.nn), length(b.nn)) END) s
  FROM f a JOIN f b ON a.make = b.make AND a.i < b.i),
low AS (SELECT *, row_number() OVER (ORDER BY i, j) - 1 k, count(*) OVER () // 40 n FROM p WHERE NOT twin AND s < 0.3::DOUBLE),
c AS (SELECT i, j, twin, s, 0 late FROM p WHERE twin OR s >= 0.3::DOUBLE
  UNION ALL SELECT i, j, twin, s, 1 FROM low WHERE k % greatest(n, 1) = 0 AND k // greatest(n, 1) < 40)
SELECT i, j, twin FROM c ORDER BY s DESC, late, i, j LIMIT {}
"""


def expected(rows, names, limit):
    db = duckdb.connect()
    db.execute("CREATE TABLE parts (i INTEGER, make VARCHAR, pn VARCHAR, nn VARCHAR)")
    db.executemany("INSERT INTO parts VALUES (?, ?, ?, ?)", [(i, r["make"], r["part_number"], names[r["part_name"]]) for i, r in enumerate(rows)])
    return db.execute(EXPECTED.format(limit)).fetchall()


def test_small_lists_match_the_definition(spark, monkeypatch):
    rng = random.Random(9)
    words = ["lamp", "head", "cover", "bumper", "arm", "zz", "kk", "clamp"]
    rows = [dict(part_name=" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) if rng.random() < 0.9 else "ASSY",
                 part_number=rng.choice(["", "P1", "P2", "P3", "P4", "P5"]), make=rng.choice(["Kia", "Audi"]), unit_cost=5,
                 supplier=f"S{i}") for i in range(45)]
    lines = enrich_lines(raw_frame(spark, rows)).cache()
    named = with_name_features(lines, "part_name").select("part_name", "nn").distinct().collect()
    feats = {r.part_name: r.nn for r in named}
    for limit in (25, 5000):
        monkeypatch.setattr(pairs, "MAX_PAIRS", limit)
        got = [(int(r.supplier_a[1:]), int(r.supplier_b[1:]), r.label != "") for r in pairs.candidate_pairs(lines).collect()]
        assert got == expected(rows, feats, limit)


def test_running_sum(spark):
    df = spark.createDataFrame([(k, i, (i * 7) % 5) for k in "ab" for i in range(500)], "k string, o long, v long")
    got = pairs.running_sum(df.repartition(5), ["k"], "o", F.col("v"), "s").orderBy("k", "o").collect()
    total = 0
    for r in got:
        total = r.v if r.o == 0 else total + r.v
        assert r.s == total


def test_keys_are_never_collected_for_a_broadcast(spark):
    rows = spark.createDataFrame([("m", "red ring", ["red", "ring"], 1), ("m", "red rings", ["red", "rings"], 2)], "block string, nn string, tk array<string>, n int")
    cfg = MatchConfig(threshold=0.3, token_weight=0.6)
    (sets,) = with_match_sets(rows, cfg)
    found = similar_pairs(sets, sets, cfg, F.col("x.nn") < F.col("y.nn"), [F.col("x.n"), F.col("y.n").alias("m")], 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {(r.n, r.m) for r in found.collect()} == {(1, 2)}


def test_names_that_letters_do_not_tell_apart_meet_once(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(60)]
    texts += [t[:28] + "zzzz" for t in texts[:9]] + [t[3:] for t in texts[9:15]]
    rows = with_name_features(spark.createDataFrame([("m", t) for t in texts], "block string, name string"), "name").drop("pos")
    cfg = MatchConfig(threshold=0.3, token_weight=0.6)
    (sets,) = with_match_sets(rows, cfg)
    assert candidate_bound(sets, cfg) <= len(texts) * len(texts)
    before = F.col("x.nn") < F.col("y.nn")
    got = similar_pairs(sets, sets, cfg, before, [F.col("x.nn").alias("a"), F.col("y.nn").alias("b")], 16)
    x, y = rows.alias("x"), rows.alias("y")
    want = x.join(y, before & (similarity(F.col("x.nn"), F.col("x.tk"), F.col("y.nn"), F.col("y.tk"), 0.6) >= 0.3)).select("x.nn", "y.nn")
    found = [tuple(r)[:2] for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == {tuple(r) for r in want.collect()} and len(found) >= 15
