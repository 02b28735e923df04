"""Lines to parts: the grouping modes C1–C5 and their order C6.

``assign_clusters`` keeps the usable lines (F1) and adds

* ``cluster_id``: the part a line belongs to,
* ``member_rank``: the order of a line within its part,
* ``ord_class``, ``ord_first``: the order in which parts came into being.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F

from pricebench.config import MatchConfig
from pricebench.functions.parts import model_key
from pricebench.functions.similarity import with_name_features
from pricebench.operators.leaders import group_by_leader
from pricebench.operators.ordering import require_order
from pricebench.session import cut_lineage

# Part numbers that are plain integers below this come first, in numeric order.
_INDEX_LIMIT = 4_294_967_295
_ORD_STEP = 10**19
_SEPARATOR = "\u0001"


def usable(lines: DataFrame) -> DataFrame:
    """the lines that feed benchmarks."""
    return lines.where((F.col("ltype") == "Supplier Part") & ~F.col("review"))


def _order_class(key: Column) -> Column:
    number = F.when(key.rlike("^(0|[1-9][0-9]{0,9})$"), key.try_cast("long"))
    return F.when(number < _INDEX_LIMIT, number).otherwise(F.lit(_INDEX_LIMIT + 1)).cast("long")


def _guarded(key: Column, cfg: MatchConfig) -> Column:
    """With ``strict_guards`` grade and basis also split part-number and category groups."""
    if not cfg.strict_guards:
        return key
    return F.concat_ws(_SEPARATOR, key, F.col("grade"), F.col("unit_basis"))


def _plain(lines: DataFrame, key: Column, order_class: Column) -> DataFrame:
    return lines.withColumns(
        {"cluster_id": key, "member_rank": F.col("seq"), "ord_class": order_class, "ord_first": F.col("seq")}
    )


def _part_number_key() -> Column:
    return F.coalesce(F.nullif(F.col("npn"), F.lit("")), F.concat(F.lit("~"), F.col("id")))


def _signature_columns(cfg: MatchConfig) -> dict[str, Column]:
    """What two lines must have in common to be interchangeable for matching."""
    axes = ("side", "end", "vert", "depth") if cfg.sep_side else ("end", "vert", "depth")
    return {
        "block": F.concat_ws(
            _SEPARATOR,
            F.col("unit_basis"),
            F.col("make") if cfg.same_make else F.lit(""),
            model_key(F.col("model")) if cfg.same_model else F.lit(""),
        ),
        "grade": F.col("grade") if cfg.sep_grade else F.lit(""),
        "pos": F.struct(*[(F.col(f"pos.{a}") if a in axes else F.lit("")).alias(a)
                          for a in ("side", "end", "vert", "depth")]),
        # A name without any telling word is like nothing, not even itself.
        "solo": F.when(F.col("nn") == "", F.col("ord").cast("string")).otherwise(""),
    }


def _signed(rows: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Add the signature and what it is made of to rows with ``ord`` and ``part_name``."""
    featured = with_name_features(rows, "part_name")
    cols = _signature_columns(cfg)
    out = featured.withColumns({"_block": cols["block"], "_grade": cols["grade"], "_pos": cols["pos"], "_solo": cols["solo"]})
    sig = F.concat_ws(
        _SEPARATOR, "_block", "_grade", F.col("_pos.side"), F.col("_pos.end"), F.col("_pos.vert"), F.col("_pos.depth"),
        "nn", "_solo",
    )
    return out.withColumn("sig", sig)


def _owners(signed: DataFrame, cfg: MatchConfig) -> DataFrame:
    """``sig`` → ``owner``: the ``ord`` of the row that leads the signature's part."""
    vertices = signed.groupBy(
        "sig", F.col("_block").alias("block"), F.col("_grade").alias("grade"), F.col("_pos").alias("pos"), "nn", "tk"
    ).agg(F.min("ord").alias("ord"))
    vertices = cut_lineage(vertices)
    owners = group_by_leader(vertices.drop("sig"), cfg)
    return vertices.select("sig", "ord").join(owners, "ord").select("sig", "owner")


def _fuzzy(lines: DataFrame, cfg: MatchConfig) -> DataFrame:
    # Lines written alike share a signature: features are taken once per spelling, and lines only look up their part.
    spelling = ["part_name", "make", "grade", "unit_basis"] + (["model"] if cfg.same_model else [])
    spelled = lines.groupBy(*spelling).agg(F.min("seq").alias("ord"))
    if not cfg.same_model:
        spelled = spelled.withColumn("model", F.lit(""))
    # A name without any telling word leads itself, line by line.
    signed = cut_lineage(_signed(spelled, cfg).where(F.col("nn") != ""))
    owned = cut_lineage(signed.join(_owners(signed, cfg), "sig").select(*[F.col(c).alias(f"_s_{c}") for c in spelling], "owner"))
    met = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in spelling])
    return lines.join(owned, met, "left").select(
        *lines.columns,
        F.coalesce("owner", "seq").alias("cluster_id"),
        F.col("seq").alias("member_rank"),
        F.lit(_INDEX_LIMIT + 1).cast("long").alias("ord_class"),
        F.col("seq").alias("ord_first"),
    )


def _bridged(lines: DataFrame, cfg: MatchConfig) -> DataFrame:
    keyed = lines.withColumn("_pn", _guarded(_part_number_key(), cfg))
    keyed = keyed.withColumn("_class", _order_class(F.col("_pn")))
    # The first member of a part-number group stands for it.
    groups = keyed.groupBy("_pn", "_class").agg(
        F.min("seq").alias("_first"),
        F.min_by(F.struct("make", "model", "grade", "unit_basis", "part_name"), "seq").alias("rep"),
    )
    order = F.col("_class").cast("decimal(38,0)") * F.lit(str(_ORD_STEP)).cast("decimal(20,0)") + F.col("_first")
    groups = groups.select("_pn", "_class", "_first", "rep.*", order.cast("decimal(38,0)").alias("ord"))
    signed = _signed(cut_lineage(groups), cfg)
    owner = signed.join(_owners(signed, cfg), "sig").select("_pn", F.col("_first").alias("_gfirst"), "owner")
    step = F.lit(str(_ORD_STEP)).cast("decimal(20,0)")
    return keyed.join(owner, "_pn").select(
        *lines.columns,
        (F.col("owner") % step).cast("long").alias("cluster_id"),
        F.struct(F.col("_class").alias("c"), F.col("_gfirst").alias("g"), F.col("seq").alias("s")).alias("member_rank"),
        F.col("_class").alias("ord_class"),
        F.col("_gfirst").alias("ord_first"),
    )


def assign_clusters(lines: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Usable lines with their part.  Leader modes run jobs; the others are a projection.

    Raises if lines lack a stored order or share a place in it.
    """
    rows = require_order(usable(lines))
    if cfg.mode == "exact-pn":
        key = F.coalesce(F.nullif(F.col("npn"), F.lit("")), F.lit("?"))
        return _plain(rows, _guarded(key, cfg), _order_class(key))
    if cfg.mode == "category":
        key = F.concat(F.col("make"), F.lit(" · "), F.col("cat")) if cfg.same_make else F.col("cat")
        return _plain(rows, _guarded(key, cfg), F.lit(_INDEX_LIMIT + 1).cast("long"))
    if cfg.mode == "fuzzy-name":
        return _fuzzy(rows, cfg)
    if cfg.bridge:
        return _bridged(rows, cfg)
    key = _part_number_key()
    return _plain(rows, _guarded(key, cfg), _order_class(key))


def cluster_members(grouped: DataFrame) -> DataFrame:
    """M4: which line belongs to which part."""
    return grouped.select("id", "seq", "cluster_id", "member_rank")
