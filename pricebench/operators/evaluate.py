"""Matcher evaluation: V2, V3, A21, F9, J11."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricebench.functions.numeric import strip, to_fixed
from pricebench.functions.parts import text
from pricebench.functions.similarity import edit_similarity, jaccard, position_conflict, with_name_features

# The grid.
TOKEN_WEIGHTS = (0.4, 0.6, 0.8)
THRESHOLDS = (0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)


def usable_labels(pairs: DataFrame) -> DataFrame:
    """blank and ``?`` labels drop out; ``y…`` is the same part, anything else is not."""
    label = F.lower(strip(text(F.col("label"))))
    return pairs.where((label != "") & ~label.startswith("?")).withColumn("truth", label.startswith("y"))


def sweep(pairs: DataFrame, weights=TOKEN_WEIGHTS, thresholds=THRESHOLDS) -> DataFrame:
    """V2: confusion counts for each token weight and threshold.

    Pairs are scored once and then laid out over the grid, whose size is fixed;
    a position conflict rules a merge out whatever the score.
    """
    scored = with_name_features(with_name_features(usable_labels(pairs), "part_name_a", "a_"), "part_name_b", "b_")
    scored = scored.select(
        "truth", jaccard(F.col("a_tk"), F.col("b_tk")).alias("j"), edit_similarity(F.col("a_nn"), F.col("b_nn")).alias("l"),
        position_conflict(F.col("a_pos"), F.col("b_pos")).alias("veto"),
    )
    grid = F.array(*[F.struct(F.lit(w).alias("token_weight"), F.lit(t).alias("threshold")) for w in weights for t in thresholds])
    w = F.col("token_weight")
    sim = F.when(F.col("veto"), F.lit(-1.0)).otherwise(w * F.col("j") + (F.lit(1.0) - w) * F.col("l"))
    said = sim >= F.col("threshold")
    cells = scored.select("*", F.inline(grid)).groupBy("token_weight", "threshold").agg(
        F.count_if(said & F.col("truth")).alias("tp"), F.count_if(said & ~F.col("truth")).alias("fp"),
        F.count_if(~said & F.col("truth")).alias("fn"), F.count_if(~said & ~F.col("truth")).alias("tn"),
    )
    cells = cells.withColumns({
        "precision": F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).otherwise(1.0),
        "recall": F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).otherwise(0.0),
    })
    p, r = F.col("precision"), F.col("recall")
    return cells.withColumn("f1", F.when(p + r > 0, p * r * 2 / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)).orderBy("token_weight", "threshold")


def printed_sweep(cells: DataFrame) -> DataFrame:
    """The grid with four decimals."""
    return cells.select("token_weight", "threshold", "tp", "fp", "fn", "tn",
                        *[to_fixed(F.col(c), 4).alias(c) for c in ("precision", "recall", "f1")])


def operating_points(cells: DataFrame, precision: float = 0.95) -> DataFrame:
    """V3: best F1, and best recall among cells of at least this precision; the first cell wins ties."""
    by_cell = [F.col("token_weight"), F.col("threshold")]
    best = cells.orderBy(F.col("f1").desc(), *by_cell).limit(1).select(F.lit("best f1").alias("point"), "*")
    strict = cells.where(F.col("precision") >= precision).orderBy(F.col("recall").desc(), *by_cell).limit(1)
    return best.unionByName(strict.select(F.lit(f"precision >= {precision:g}").alias("point"), "*"))
