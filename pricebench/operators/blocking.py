"""Similarity join without comparing everything with everything.

``similarity >= threshold`` forces a minimum overlap of tokens or, when the
token weight is small, of letters.  Two sets of sizes a and b that share at
least o items share l of the first a-o+l (and b-o+l) items when both are sorted
the same way, so joining on l-item keys taken from those prefixes loses nothing.
Items are sorted rarest first, which keeps common words out of the keys.
Where letters tell names apart so little that their keys would bring more pairs
together than a block has, a block is compared as a whole.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F

from pricebench.config import MatchConfig
from pricebench.functions.similarity import edit_similarity, grade_conflict, position_conflict
from pricebench.session import cut_lineage

_EPS = 1e-9
# Frequent items whose order is by frequency; the others sort first, by text.
# Any common order is correct, so this bounds what is sent to the tasks.
FREQUENT_ITEMS = 256
# Two-item keys grow with the square of the prefix; long names use one item.
_PAIR_KEYS_UP_TO = 24
# A key whose two sides make more pairs than this squared is spread over a grid of cells of about so many rows a side.
CELL_ROWS = 4096
# Spread keys up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_HOT = 100_000


def token_overlap_needed(cfg: MatchConfig) -> float:
    """Least jaccard a match can have; 0 or less means tokens need not overlap."""
    w = cfg.token_weight
    return -1.0 if w == 0 else (cfg.threshold - (1.0 - w)) / w - _EPS


def _letters(nn: Column) -> Column:
    """Letters numbered by occurrence, so that a multiset becomes a set."""
    def numbered(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(nn) - F.length(F.replace(nn, c, F.lit("")))), lambda i: F.concat(c, i.cast("string")))

    return F.when(nn == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(F.array_distinct(F.split(nn, "")), numbered)))


def rarest_first(df: DataFrame, items: str):
    """A sort of item arrays, rarest item in ``df`` first, and its frequent items; looks at the data once."""
    top = (
        df.select(F.explode(items).alias("item")).groupBy("item").count()
        .orderBy(F.col("count").desc(), "item").limit(FREQUENT_ITEMS).collect()
    )
    frequent = F.array(*[F.lit(r["item"]) for r in reversed(top)]) if top else F.array().cast("array<string>")

    def sort(array: Column) -> Column:
        keyed = F.transform(array, lambda t: F.struct(F.array_position(frequent, t).alias("p"), t.alias("t")))
        return F.transform(F.array_sort(keyed), lambda s: s.getField("t"))

    return sort, frequent


def _letter_bits(frequent: Column) -> list[Column]:
    """``lt`` as bits, one for each frequent letter: a bit that one of two names lacks stands for at least one letter it lacks."""
    def long(k: int) -> Column:
        def set_bit(bits: Column, i: Column) -> Column:
            at = F.coalesce(F.nullif(F.array_position(frequent, i), F.lit(0)) - 1, F.pmod(F.xxhash64(i), F.lit(FREQUENT_ITEMS)))
            one = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
            return F.when(F.floor(at / 64) == k, bits.bitwiseOR(one)).otherwise(bits)

        return F.aggregate("lt", F.lit(0).cast("long"), set_bit)

    return [long(k).alias(f"_l{k}") for k in range(FREQUENT_ITEMS // 64)]


def with_match_sets(vertices: DataFrame, cfg: MatchConfig, *others: DataFrame) -> tuple[DataFrame, ...]:
    """Put ``tk`` into one shared rarest-first order and add ``lt`` (letters), as a set and as bits, when they are needed.

    Frequencies are those of the first frame.
    """
    frames = (vertices, *others)
    by_token, _ = rarest_first(vertices, "tk")
    frames = tuple(f.withColumn("tk", by_token(F.col("tk"))) for f in frames)
    if token_overlap_needed(cfg) <= 0:
        frames = tuple(f.withColumn("lt", _letters(F.col("nn"))) for f in frames)
        by_letter, frequent = rarest_first(frames[0], "lt")
        frames = tuple(f.withColumn("lt", by_letter(F.col("lt"))).select("*", F.length("nn").alias("_ln"), *_letter_bits(frequent)) for f in frames)
    return frames


def _prefix_keys(items: str, low: Column, high: Column, overlap) -> Column:
    """Array of (own size, partner size, key) for every partner size in low..high."""
    n = F.size(items)

    def keys_for(b: Column) -> Column:
        o = overlap(n, b)
        single = (o < 2) | (n + b > _PAIR_KEYS_UP_TO)
        one = F.slice(F.col(items), F.lit(1), F.greatest(n - o + 1, F.lit(0)))
        p = n - o + 2
        two = F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.greatest(p - 1, F.lit(1))),
                lambda i: F.transform(
                    F.slice(F.col(items), i + 1, F.greatest(p - i, F.lit(0))),
                    lambda second: F.concat(F.element_at(F.col(items), i), F.lit(" "), second),
                ),
            )
        )
        fits = o <= F.least(n, b)
        keys = F.when(~fits, F.array().cast("array<string>")).when(single, one).otherwise(two)
        return F.transform(keys, lambda k: F.struct(n.alias("a"), b.alias("b"), k.alias("key")))

    return F.when((n > 0) & (low <= high), F.flatten(F.transform(F.sequence(low, high), keys_for)))


def _token_keys(t: float) -> Column:
    n = F.size("tk")

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.ceil(F.lit(t / (1 + t)) * (a + b)).cast("int"), F.lit(1))

    low = F.greatest(F.ceil(F.lit(t) * n).cast("int"), F.lit(1))
    return _prefix_keys("tk", low, F.floor(n / F.lit(t)).cast("int"), overlap)


def _letter_keys(t: float) -> Column:
    n = F.size("lt")

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.ceil(F.lit(t) * F.greatest(a, b)).cast("int"), F.lit(1))

    low = F.greatest(F.ceil(F.lit(t) * n).cast("int"), F.lit(1))
    return _prefix_keys("lt", low, F.floor(n / F.lit(t)).cast("int"), overlap)


def _any_token_keys() -> Column:
    return F.transform(F.col("tk"), lambda k: F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), k.alias("key")))


def _whole_block() -> Column:
    """One key for all of a block, of names that have letters."""
    return F.when(F.size("lt") > 0, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit("").alias("key"))))


def _letters_allow(cfg: MatchConfig) -> Column:
    """Whether ``x`` and ``y`` without a common token can be similar: each letter that one name lacks costs an edit of the other."""
    def lacking(a: str, b: str) -> Column:
        bits = [F.bit_count(F.col(f"{a}._l{k}").bitwiseAND(F.bitwise_not(F.col(f"{b}._l{k}")))) for k in range(FREQUENT_ITEMS // 64)]
        return functools.reduce(operator.add, bits)

    unlike = 1.0 - cfg.threshold / (1.0 - cfg.token_weight) + _EPS
    edits = F.lit(unlike) * F.greatest("x._ln", "y._ln")
    return (lacking("x", "y") <= edits) & (lacking("y", "x") <= edits)


def keyings(cfg: MatchConfig) -> list[tuple[str, Column]]:
    """The keyings whose candidates together hold every match."""
    t = token_overlap_needed(cfg)
    if t > 0:
        return [("tk", _token_keys(t))]
    letters = ("lt", _letter_keys(cfg.threshold / (1.0 - cfg.token_weight) - _EPS))
    return [letters] if cfg.token_weight == 0 else [("any", _any_token_keys()), letters]


def _keyed(vertices: DataFrame, keys: Column) -> DataFrame:
    return vertices.withColumn("_k", F.explode(keys)).select(
        *[c for c in vertices.columns if c != "lt"], F.col("_k.a").alias("_a"), F.col("_k.b").alias("_b"), F.col("_k.key").alias("_key")
    )


def candidate_bound(vertices: DataFrame, cfg: MatchConfig) -> int:
    """An upper bound of the pairs a self-join of ``vertices`` looks at, from key counts alone."""
    bound = 0
    for kind, keys in keyings(cfg):
        met = []
        for keyed in (keys, _whole_block()) if kind == "lt" else (keys,):
            sizes = _keyed(vertices, keyed).groupBy("block", "_key", "_a", "_b").agg(F.count(F.lit(1)).alias("c"))
            met.append(sizes.agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("s")).first().s or 0.0)
        bound += int(min(met) / 2)
    return bound


_MEET = ["block", "_key", "_a", "_b"]


def _sizes(x: DataFrame, y: DataFrame) -> DataFrame:
    """Rows of both sides of a key join under each key that both have."""
    as_x = y.select("block", "_key", F.col("_b").alias("_a"), F.col("_a").alias("_b"))
    return x.groupBy(*_MEET).agg(F.count(F.lit(1)).alias("_nx")).join(as_x.groupBy(*_MEET).agg(F.count(F.lit(1)).alias("_ny")), _MEET)


def _fewest_pairs(left: DataFrame, right: DataFrame, keys: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides of the letter join, keyed by letters or, if that looks at no more pairs, by block alone."""
    sides = [(_keyed(left, k), _keyed(right, k)) for k in (_whole_block(), keys)]
    whole, lettered = (_sizes(x, y).agg(F.sum(F.col("_nx").cast("double") * F.col("_ny"))).first()[0] or 0.0 for x, y in sides)
    return sides[0] if whole <= lettered else sides[1]


def _in_cells(x: DataFrame, y: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a key join with a further key ``_c``, so that no group of equal keys holds much more than ``cell`` rows a side.

    A hot key's rows of ``x`` are dealt to the rows of a grid and repeated once per
    column, those of ``y`` the other way round: every pair meets in exactly one
    cell.  Only keys with more than ``cell * cell`` pairs are spread, so of both
    sides together at most one row in ``cell`` is a hot key.
    """
    other = ["block", "_key", F.col("_b").alias("_a"), F.col("_a").alias("_b")]
    hot = cut_lineage(_sizes(x, y).where(F.col("_nx").cast("double") * F.col("_ny") > float(cell) * cell).select(
        *_MEET, F.ceil(F.col("_nx") / cell).cast("int").alias("_sx"), F.ceil(F.col("_ny") / cell).cast("int").alias("_sy")))
    n_hot = hot.count()
    if n_hot == 0:
        return x.withColumn("_c", F.lit(0)), y.withColumn("_c", F.lit(0))

    def dealt(rows: DataFrame, hot: DataFrame, own: str, row_of_grid: bool) -> DataFrame:
        hot = F.broadcast(hot) if n_hot <= BROADCAST_HOT else hot
        at = F.pmod(F.xxhash64(*rows.columns), F.col(own)).cast("int")
        across = F.sequence(F.lit(0), F.col("_sy" if row_of_grid else "_sx") - 1)
        cells = F.transform(across, lambda i: at * F.col("_sy") + i if row_of_grid else i * F.col("_sy") + at)
        return rows.join(hot, _MEET, "left").select(*rows.columns, F.explode(F.coalesce(cells, F.array(F.lit(0)))).alias("_c"))

    return dealt(x, hot, "_sx", True), dealt(y, hot.select(*other, "_sx", "_sy"), "_sy", False)


def _score(cfg: MatchConfig) -> tuple[Column, Column]:
    common = F.array_intersect("x.tk", "y.tk")
    union = F.size("x.tk") + F.size("y.tk") - F.size(common)
    tokens = F.when(union == 0, F.lit(0.0)).otherwise(F.size(common) / F.greatest(union, F.lit(1)))
    w = F.lit(float(cfg.token_weight))
    return common, w * tokens + (F.lit(1.0) - w) * edit_similarity(F.col("x.nn"), F.col("y.nn"))


def similar_pairs(left: DataFrame, right: DataFrame, cfg: MatchConfig, guard: Column, keep: list[Column], cell: int | None = None) -> DataFrame:
    """Pairs of rows ``x`` of ``left`` and ``y`` of ``right`` with similarity at the threshold or above.

    Both sides carry ``block`` (what must be equal), ``nn`` and ``tk`` in a shared order (and ``lt``).
    When tokens need not overlap a pair may come twice.  With ``cell``, keys with
    more than ``cell * cell`` pairs are spread over tasks.
    """
    found = None
    for kind, keys in keyings(cfg):
        x, y = _fewest_pairs(left, right, keys) if kind == "lt" else (_keyed(left, keys), _keyed(right, keys))
        x, y = _in_cells(x, y, cell) if cell else (x.withColumn("_c", F.lit(0)), y.withColumn("_c", F.lit(0)))
        if kind == "lt":
            # Few rows make many pairs here, which the size of a partition does not tell of.
            spark = x.sparkSession
            tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
            x, y = x.repartition(tasks, *_MEET, "_c"), y.repartition(tasks, "block", "_key", "_b", "_a", "_c")
        x, y = x.alias("x"), y.alias("y")
        same = (
            (F.col("x.block") == F.col("y.block"))
            & (F.col("x._key") == F.col("y._key"))
            & (F.col("x._a") == F.col("y._b"))
            & (F.col("x._b") == F.col("y._a"))
            & (F.col("x._c") == F.col("y._c"))
        )
        common, score = _score(cfg)
        accept = guard & _letters_allow(cfg) if kind == "lt" else guard
        if kind == "tk":
            # A pair meets under each key it shares; keep it only under its first.
            first = F.when(F.contains(F.col("x._key"), F.lit(" ")), F.array_join(F.slice(common, 1, 2), " ")).otherwise(
                F.try_element_at(common, F.lit(1))
            )
            accept = accept & (first == F.col("x._key"))
        # Keys are many times the rows that a table's size tells of: left alone, they could be collected for a broadcast.
        pairs = x.join(y.hint("merge"), same & accept & (score >= F.lit(float(cfg.threshold)))).select(*keep, score.alias("score"))
        found = pairs if found is None else found.unionByName(pairs)
    return found


def merge_guard(cfg: MatchConfig) -> Column:
    """Grade and position rules between ``x`` and ``y``."""
    guard = ~position_conflict(F.col("x.pos"), F.col("y.pos"), cfg.sep_side)
    if cfg.sep_grade:
        guard = guard & ~grade_conflict(F.col("x.grade"), F.col("y.grade"))
    return guard


def matches(later: DataFrame, earlier: DataFrame, cfg: MatchConfig, cell: int | None = None) -> DataFrame:
    """Pairs (``hi``, ``lo``) that may merge, ``lo`` being the earlier one in ``ord``."""
    guard = (F.col("y.ord") < F.col("x.ord")) & merge_guard(cfg)
    keep = [F.col("x.ord").alias("hi"), F.col("y.ord").alias("lo")]
    pairs = similar_pairs(later, earlier, cfg, guard, keep, cell).drop("score")
    return pairs if token_overlap_needed(cfg) > 0 else pairs.distinct()
